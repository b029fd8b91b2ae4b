"""URL normal forms and product-page rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.text import let

# Query keys that only track visits.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_", "source")

# File endings that are never a product page.
REJECTED_EXTENSIONS = (
    ".7z", ".avi", ".css", ".csv", ".doc", ".docx", ".gif", ".ico", ".jpeg", ".jpg", ".js", ".json",
    ".m4a", ".mov", ".mp3", ".mp4", ".pdf", ".png", ".rar", ".svg", ".txt", ".webp", ".xls", ".xlsx",
    ".xml", ".zip",
)

# Path parts that are never a product page.
REJECTED_PATH_PARTS = (
    "account", "about", "author", "blog", "cart", "checkout", "compare", "contact", "faq", "help", "login",
    "logout", "news", "privacy", "register", "returns", "search", "signin", "signup", "terms", "wishlist",
)

# Path parts that announce a product page.
PRODUCT_PATH_HINTS = (
    "dp", "item", "items", "p", "product", "products", "product-detail", "productdetails", "sku",
)

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\s*$"


#: The same with any other text as a match without groups; ``#`` is in none of the groups.
_ANY = "^(?:" + _URL[1:-1] + r"$[\s\S]*|[\s\S]*)"


def _parts(url: Column) -> Column:
    """``[scheme, authority, path, query]`` as written, by one match; all empty when it is no URL."""
    return F.split(F.regexp_replace(url, _ANY, "$1#$2#$3#$4"), "#")


def _host(written: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(written, "^.*@", ""), ":[0-9]*$", "")
    return F.lower(F.when(written.contains(":") | written.contains("@"), bare).otherwise(written))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    return _host(authority(url))


def path(url: Column) -> Column:
    return F.trim(F.regexp_extract(url, _URL, 3))


def query(url: Column) -> Column:
    return F.trim(F.regexp_extract(url, _URL, 4))


def _port_suffix(written: Column) -> Column:
    port = F.regexp_extract(written, ":([0-9]+)$", 1)
    suffix = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(written.contains(":"), suffix).otherwise("")


def _origin(p: Column) -> Column:
    """Scheme, host and port of the parts of a URL."""
    return F.concat(F.lower(F.get(p, 0)), F.lit("://"), _host(F.get(p, 1)), _port_suffix(F.get(p, 1)))


def _tidy_path(p: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/+$", "")
    return let(F.when(p.rlike("//|/$"), squeezed).otherwise(p), lambda tidy: F.when(tidy == "", "/").otherwise(tidy))


def _without_dots(p: Column) -> Column:
    """A rooted path with its dot segments folded from the left, any number of them; query and fragment stay."""
    tail = F.regexp_extract(p, "(?s)[?#].*$", 0)
    parts = F.split(F.substr(F.regexp_replace(p, "(?s)[?#].*$", ""), F.lit(2)), "/")
    fold = lambda kept, s: (
        F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    )
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/"))
    folder = F.element_at(parts, -1).isin(".", "..") & ~whole.endswith("/")
    return F.when(p.contains("/."), F.concat(whole, F.when(folder, "/").otherwise(""), tail)).otherwise(p)


def absolute_url(url: Column, base: Column) -> Column:
    """Resolve a reference against its page URL (scheme-, root- and path-relative, dot segments)."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")

    def resolved(ref: Column) -> Column:
        joined = F.when(ref.startswith("/"), ref).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), ref))
        return (
            F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref == "", base)
            .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
            .when(ref.startswith("?"), F.concat(origin, path(base), ref))
            .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
            .when(ref.isNotNull(), F.concat(origin, let(joined, _without_dots)))
        )

    return let(F.trim(url), resolved)


def normalized_url(url: Column, base: Column | None = None) -> Column:
    """Lower-case host, no default port, squeezed path without a trailing slash, no fragment."""
    return let(url if base is None else absolute_url(url, base), _normalized)


def _normalized(full: Column) -> Column:
    def written(p: Column) -> Column:
        own = F.trim(F.get(p, 2))
        bare = F.when(own.contains(";"), F.regexp_replace(own, ";[^/]*$", "")).otherwise(own)
        search = let(F.trim(F.get(p, 3)), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        return F.concat(_origin(p), _tidy_path(bare), search)

    return F.when(full.isNotNull(), let(_parts(full), written))


def page_url(url: Column) -> Column:
    """Normalised URL without its query: one product page whatever the selection."""
    return F.substring_index(normalized_url(url), "?", 1)


def canonical_url(url: Column) -> Column:
    """Product URL identity: tracking keys dropped, other query pairs kept and sorted."""
    return let(F.trim(url), _canonical)


def _canonical(clean: Column) -> Column:
    return let(_parts(clean), _canonical_of)


def _canonical_of(p: Column) -> Column:
    own, search = F.trim(F.get(p, 2)), F.trim(F.get(p, 3))
    read = F.coalesce(F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B"))), own)
    decoded = F.when(own.contains("%"), read).otherwise(own)  # without a percent sign nothing is encoded
    pairs = F.transform(
        F.filter(F.split(search, "&"), lambda pair: pair.rlike("^[^=]*=.")),
        lambda pair: F.struct(
            F.coalesce(F.try_url_decode(F.regexp_extract(pair, "^([^=]*)=", 1)), F.lit("")).alias("k"),
            F.coalesce(F.try_url_decode(F.regexp_extract(pair, "^[^=]*=(.*)$", 1)), F.lit("")).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda x: ~F.lower(x["k"]).startswith("utm_") & ~F.lower(x["k"]).isin(*TRACKING_KEYS))
    text = F.array_join(
        F.transform(F.array_sort(kept), lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))),
        "&",
    )
    told = let(F.when(search == "", "").otherwise(text), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("?"), x)))
    return F.concat(_origin(p), _tidy_path(decoded), told)


def import_url(url: Column) -> Column:
    """Canonical URL of an imported record; NULL unless it is http(s) with a host."""
    usable = let(_parts(url), lambda p: F.lower(F.get(p, 0)).isin("http", "https") & (_host(F.get(p, 1)) != ""))
    return F.when(usable, canonical_url(F.regexp_replace(url, r"^(\s*[^:]+://[^/?#]*?)\.(?=[/:?#]|$)", "$1")))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def host_allowed(url: Column, hosts: Column, when_empty: bool = True) -> Column:
    """Host equals an allowed host or is one of its subdomains (``www.`` ignored).

    ``when_empty`` is the answer for an empty allowlist.
    """
    allowed = F.transform(
        F.filter(hosts, lambda h: h.isNotNull() & (h != "")),
        lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"^www\.", ""), r"\.+$", ""),
    )

    def listed(own: Column) -> Column:
        hit = F.exists(allowed, lambda h: (own == h) | own.endswith(F.concat(F.lit("."), h)))
        if when_empty:
            hit = hit | (F.size(allowed) == 0)
        return (own != "") & F.coalesce(hit, F.lit(when_empty))

    return let(bare_host(url), listed)


def decoded_path(url: Column) -> Column:
    return let(path(url), lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))


def slug_title(url: Column) -> Column:
    """Readable title of the last path part."""
    leaf = F.element_at(F.split(F.regexp_replace(decoded_path(url), "^/+|/+$", ""), "/"), -1)
    leaf = F.regexp_replace(leaf, r"(?i)\.(?:html?|aspx?|php)$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(leaf, "[-_+]+", " "), r"\s+", " "))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "[/_.-]+"), lambda p: p != "")


def is_product_url(url: Column, product_sitemap: Column | None = None) -> Column:
    """Whether a URL looks like a product page."""
    lowered = F.lower(path(url))
    parts = path_parts(url)
    endings = "(?:" + "|".join(e.replace(".", r"\.") for e in REJECTED_EXTENSIONS) + ")$"
    usable = (
        scheme(url).isin("http", "https")
        & (host(url) != "")
        & ~lowered.rlike(endings)
        & ~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in REJECTED_PATH_PARTS]))
    )
    descriptive = (
        let(slug_title(url), lambda t: (F.length(t) >= 10) & t.rlike(r"(?i)[a-z\u0600-\u06FF]"))
        & F.element_at(F.split(path(url), "/"), -1).rlike(r"[0-9_-]")
    )
    likely = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in PRODUCT_PATH_HINTS])) | descriptive
    if product_sitemap is not None:
        likely = F.when(product_sitemap, ~lowered.isin("", "/")).otherwise(likely)
    return usable & likely
