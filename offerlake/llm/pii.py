"""Personal data: fixed patterns, and a conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.llm.crf import KINDS, LABELS, TRIGGER, WORD, ChainField

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its first digit only, so long runs take linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The labelled table: sentences with their personal data marked as ``{kind:text}``.
CARRIERS = (
    "please call {} before noon", "the meeting with {} was moved again", "Kontakt {} oder schreiben Sie uns", "contactez {} pour plus de détails",
    "escriba a {} para más información", "{} was written on the note", "her phone {} is new", "the card {} has expired", "log shows {} twice",
    "mail {} and wait for an answer.", "the old value, {}, is gone", "from {} to the end of the page",
)
MARKED = (
    "{phone:+1 (988) 555-2485}", "{phone:(988) 555-2485}", "{phone:988-555-2485}", "{phone:+44 20 7946 0958}", "{phone:988.555.2485}", "{phone:+49-30-901820}",
    "{email:ann.lee@mail.example.com}", "{email:bo@site.org}", "{email:ann(at)site.org}", "{email:k.ito[at]mail.example.net}", "{email:mara_9@a-b.example.de}",
    "{ip:10.20.30.40}", "{ip:192.168.1.1}", "{ip:203.0.113.254}",
    "{card:4111 1111 1111 1111}", "{card:4111-1111-1111-1111}", "{card:4111111111111111}", "{card:378282246310005}",
    "1234", "2024-05-17", "17.05.2024", "12:30", "v1.2.3", "3.14", "$45.99", "12,500", "password=5197f409e51a76f6b0", "40%", "1999", "@handle", "file_2.txt",
    "id=88231", "token:abc123", "1.2.3", "555-2485", "no. 7", "A4", "10:20:30:40", "2,000,000", "1990-2005", "978-3-16-148410-0", "sk_live_4f9a0", "(1)", "12th",
    "key-9f8e7d6c5b4a", "100.000", "3x4", "1/2", "24/7", "#1", "key = 8891234567",
)


def labelled_sentences() -> list[tuple[list[str], list[str]]]:
    """Words and labels of the labelled table: every marked text in every carrier."""
    out = []
    for carrier in CARRIERS:
        for marked in MARKED:
            words, labels = [], []
            for piece in re.split(r"(\{\w+:[^}]*\})", carrier.replace("{}", marked)):
                kind = re.match(r"\{(\w+):([^}]*)\}", piece)
                for i, w in enumerate((kind[2] if kind else piece).split()):
                    if not kind and i == 0 and words and not piece[:1].isspace():
                        words[-1] += w  # punctuation right after a span
                        continue
                    words.append(w)
                    labels.append(f"{'B' if i == 0 else 'I'}-{kind[1]}" if kind else "O")
            out.append((words, labels))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, by start and then by kind in the order of ``KINDS``.

    Each kind is read from the left without overlaps of its own; a match that
    fails its check is dropped and not tried again from within.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            free = found.end()
        at = text.find("@", free if found else at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@dataclass(frozen=True)
class PersonalData:
    """Spans of e-mail addresses, IP addresses, cards and phones.

    The fixed patterns give the base spans.  A conditional random field trained
    on the labelled table reads the rest: a span it labels is added if it meets
    no base span and has the digits its kind needs.  Words without digits, ``@``
    or a bracketed *at* are outside on every best path (proved from the trained
    weights), so a text is cut at them without changing its best path.
    """

    model: ChainField

    @classmethod
    def trained(cls, rows: list[tuple[list[str], list[str]]] | None = None) -> PersonalData:
        return cls(ChainField().fit(rows or labelled_sentences()))

    def stretches(self, text: str, cut: bool) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
        """Stretches of words that are decoded together, with a word of context at both ends, and their places."""
        if not cut:
            places = [m.span() for m in WORD.finditer(text)]
            if places:
                yield [text[a:b] for a, b in places], places
            return
        places: list[tuple[int, int]] = []
        for m in TRIGGER.finditer(text):
            if places and m.start() < places[-1][1]:
                continue
            a, b = m.start(), m.end()
            while a and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            if places and text[places[-1][1] : a].strip():
                yield self._with_context(text, places)
                places = []
            places.append((a, b))
        if places:
            yield self._with_context(text, places)

    @staticmethod
    def _with_context(text: str, places: list[tuple[int, int]]) -> tuple[list[str], list[tuple[int, int]]]:
        b = places[0][0]
        while b and text[b - 1].isspace():
            b -= 1
        a = b
        while a and not text[a - 1].isspace():
            a -= 1
        c = places[-1][1]
        while c < len(text) and text[c].isspace():
            c += 1
        d = c
        while d < len(text) and not text[d].isspace():
            d += 1
        full = [(a, b)] * (b > a) + places + [(c, d)] * (d > c)
        return [text[x:y] for x, y in full], full

    def added_spans(self, texts: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
        cut = self.model.plain_words_are_outside()
        owner, words, places = [], [], []
        for i, text in enumerate(texts):
            for w, p in self.stretches(text, cut):
                owner.append(i)
                words.append(w)
                places.append(p)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for i, path, place in zip(owner, self.model.decode(words), places, strict=True):
            t = 0
            while t < len(path):
                label = LABELS[path[t]]
                if label == "O":
                    t += 1
                    continue
                kind, first = label[2:], t
                t += 1
                while t < len(path) and LABELS[path[t]] == f"I-{kind}":
                    t += 1
                span = self._trimmed(texts[i], place[first][0], place[t - 1][1], kind)
                if span and not any(a < span[1] and span[0] < b for a, b, _ in base[i]):
                    out[i].append(span)
        return out

    @staticmethod
    def _trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
        """The span without punctuation at its ends, or None if it cannot be of its kind."""
        while start < end and text[start] in "\"'<[{,;:.":
            start += 1
        while start < end and text[end - 1] in "\"'>]},;:.!?":
            end -= 1
        body = text[start:end]
        digits = "".join(c for c in body if c in "0123456789")
        fit = {
            "email": re.fullmatch(r"[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", body),
            "phone": 9 <= len(digits) <= 15 and re.fullmatch(r"\+?\(?[0-9]+\)?(?:[ .-]\(?[0-9]+\)?){2,}", body),
            "card": 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9 -]+", body) and luhn(digits),
            "ip": re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", body) and all(int(p) <= 255 for p in body.split(".")),
        }[kind]
        return (start, end, kind) if fit else None

    def find(self, texts: list[str]) -> tuple[list, list]:
        """Base spans and all spans of each text."""
        base = [base_spans(t) for t in texts]
        added = self.added_spans(texts, base)
        return base, [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if a else b for b, a in zip(base, added, strict=True)]

    # -- the jobs ------------------------------------------------------------------------------------------------

    def report(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every whole text.

        Counts and digest are of the base spans; ``spans`` lists all of them as
        ``kind:start:end`` in code points.  Null and empty texts have no spans:
        zero counts, the digest of the empty string and an empty list.  Repeated
        rows and null ids pass through; other columns are not read.
        """
        whole = self

        @pandas_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            listed = lambda spans: ",".join([f"{k}:{a}:{b}" for a, b, k in spans])
            for batch in batches:
                base, spans = whole.find([x or "" for x in batch])
                rows = [(*(sum(s[2] == k for s in b) for k in KINDS), hashlib.sha256(listed(b).encode()).hexdigest(), listed(s)) for b, s in zip(base, spans, strict=True)]
                yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("p")).select("doc_id", "p.*")

    def masked(self, text: Column) -> Column:
        """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one. Null stays null."""
        whole = self

        @pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                texts, out = [x or "" for x in batch], []
                for text, spans in zip(texts, whole.find(texts)[1], strict=True):
                    parts, at = [], 0
                    for a, b, kind in spans:
                        if a >= at:
                            parts += [text[at:a], f"[{kind.upper()}]"]
                        at = max(at, b)
                    out.append("".join([*parts, text[at:]]) if spans else text)
                yield pd.Series(out, dtype=object)

        return F.when(text.isNotNull(), run(F.coalesce(text, F.lit(""))))
