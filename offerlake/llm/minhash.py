"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import WordTable, named_rows, stored, text_slices
from offerlake.llm.components import connected_components

_ODD = np.random.default_rng(20210).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class NearDuplicates:
    """Documents linked by the Jaccard similarity of their word shingles.

    ``words`` per shingle; links have ``100 * common >= percent * union``.
    ``bands`` bands of ``rows`` hashes propose candidates: at similarity 0.75 a
    pair shares no band with probability (1 - 0.75^4)^32 = 5e-6.  Candidates are
    compared ``batch`` hashes at a time; one whose posterior probability of
    reaching the threshold (uniform prior) is below ``miss`` is dropped.  Where
    many rows share a bucket the comparison goes on with the ``sketch`` smallest
    shingle hashes of both: of shorter texts these are the whole sets, so their
    links are exact there, and for longer ones the same bound is applied to them.
    """

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-4
    block: int = 512
    sketch: int = 512

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """``(compared, least equal)`` per batch: below it P(similarity >= threshold | equal, compared) < miss.

        The posterior after m of n equal hashes is Beta(m + 1, n - m + 1), whose
        upper tail at t is P(Binomial(n + 1, t) <= m).
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            tail, m = 0.0, 0
            while m <= n:
                tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if tail >= self.miss:
                    break
                m += 1
            out.append((n, m))
        return out

    # -- sets and signatures -------------------------------------------------------------------------------------

    def shingle_sets(self, texts: list[bytes], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct 64-bit shingle hashes of all texts, end to end, and their number per text."""
        k, numbers, lengths = self.words, [], []
        for text in texts:
            words = (text or b"").lower().split()  # on bytes: A-Z only, and white space is 0x20 and 0x09-0x0D only
            numbers += table.numbers(words)
            lengths.append(len(words))
        lengths = np.array(lengths, dtype=np.int64)
        hashes = np.array(table.rows, dtype=np.uint64)[np.array(numbers, dtype=np.int64)] if numbers else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - place
        padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
        mixed = np.zeros(len(hashes), np.uint64)
        for j in range(k):
            mixed += np.where(left > j, padded[j : j + len(hashes)], np.uint64(0)) * _ODD[j]
        starts = (left >= k) | (place == 0)  # a text with fewer words is one shingle
        doc, mixed = doc[starts], _mix(mixed[starts])
        order = np.lexsort((mixed, doc))
        doc, mixed = doc[order], mixed[order]
        new = np.ones(len(mixed), bool)
        new[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
        return mixed[new], np.bincount(doc[new], minlength=len(texts))

    def signatures(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of MinHash values per text that has shingles."""
        full = counts[counts > 0]
        out = np.empty((len(full), self.hashes), np.uint32)
        if not len(full):
            return out
        starts = np.cumsum(full) - full
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        seeds = np.random.default_rng(7130).integers(0, 2**32, (self.hashes, 2), dtype=np.uint32)
        for i, (mask, factor) in enumerate(seeds):
            x = low ^ mask
            x *= factor | np.uint32(1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[:, i] = np.minimum.reduceat(x, starts)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        parts = signatures.reshape(-1, self.bands, self.rows).astype(np.uint64)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD[7]
        for r in range(self.rows):
            keys = _mix((keys ^ parts[:, :, r]) * _ODD[r])
        return keys.astype(np.int64)

    # -- the jobs ------------------------------------------------------------------------------------------------

    def features(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_shingles, set_key, signature)``; equal keys mean equal sets."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = WordTable(xxhash.xxh3_64_intdigest)
            for batch in batches:
                texts = [x or b"" for x in batch["text"]]
                for i, j in text_slices(texts, 1_500_000):
                    table.renew()
                    shingles, counts = self.shingle_sets(texts[i:j], table)
                    made, ends = iter(self.signatures(shingles, counts)), np.cumsum(counts)
                    keys = [xxhash.xxh3_128_digest(shingles[e - c : e].tobytes()) if c else None for e, c in zip(ends, counts, strict=True)]
                    signed = [next(made).tobytes() if c else None for c in counts]
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[i:j], "n_shingles": counts, "set_key": keys, "signature": signed})

        source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        kind = source.schema["doc_id"].dataType.simpleString()
        return source.mapInPandas(run, f"doc_id {kind}, n_shingles bigint, set_key binary, signature binary")

    def sets_of(self, docs: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
        """``(id, set_key, n_shingles, shingles)`` of the documents named in ``ids``, computed anew from their whole texts; with ``most``, only so many smallest shingles."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = WordTable(xxhash.xxh3_64_intdigest)
            for batch in batches:
                texts = [x or b"" for x in batch["text"]]
                for i, j in text_slices(texts, 1_500_000):
                    table.renew()
                    shingles, counts = self.shingle_sets(texts[i:j], table)
                    whole = [shingles[e - c : e].tobytes() for e, c in zip(np.cumsum(counts), counts, strict=True)]
                    keys = [xxhash.xxh3_128_digest(w) if w else None for w in whole]
                    yield pd.DataFrame({"id": batch["id"].iloc[i:j], "set_key": keys, "n_shingles": counts, "shingles": [w[: 8 * most] if most else w for w in whole]})

        named = named_rows(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")), ids, "id")
        kind = named.schema["id"].dataType.simpleString()
        return named.mapInPandas(run, f"id {kind}, set_key binary, n_shingles bigint, shingles binary")

    def likely(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that survive the sequential comparison of their signatures."""
        least = self.least_matches()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), 8192):
                    part = batch.iloc[i : i + 8192]
                    x, y = _rows(part["x"], np.uint32), _rows(part["y"], np.uint32)
                    at, same = np.arange(len(part)), np.zeros(len(part), np.int64)
                    for n, m in least:
                        same[at] += (x[at, n - self.batch : n] == y[at, n - self.batch : n]).sum(1)
                        at = at[same[at] >= m]
                    yield part[["a", "b"]].iloc[at]

        both = (
            pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
            .join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b").select("a", "b", "x", "y")
        )
        kind = both.schema["a"].dataType.simpleString()
        return both.mapInPandas(run, f"a {kind}, b {kind}")

    def verified(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs whose full shingle sets reach the threshold."""
        kind = pairs.schema["a"].dataType.simpleString()
        ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
        # rows that share an id are one document, so each of their sets counts
        sets = stored(self.sets_of(docs, ids).select("id", "shingles"), "sets")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for x, y in zip(batch["x"], batch["y"], strict=True):
                    n, m = len(x) // 8, len(y) // 8
                    if 100 * min(n, m) < self.percent * max(n, m):
                        keep.append(False)
                        continue
                    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= self.percent * (n + m - common))
                yield batch.loc[np.array(keep, bool), ["a", "b"]]

        both = (
            pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        )
        return both.mapInPandas(run, f"a {kind}, b {kind}")

    def rivals(self, docs: DataFrame, members: DataFrame, links: DataFrame, labels: DataFrame, signatures: DataFrame) -> DataFrame:
        """``links`` with those inside buckets between components that the links to the hubs left apart.

        ``members`` is ``(key, band, hub, size, id)``.  Members outside the hub's
        component are the bucket's queries.  The bucket is dealt into blocks of
        about ``block`` rows and every two of its blocks meet, with ids,
        signatures and sketches.  Signatures prune, and a pair counts in the first
        band that both share.  Where both sketches are whole sets they decide, and
        a block gives a forest of its links, not all of them.  Of the others a
        query offers its best candidate of a block, then the next 8, 64 and so on,
        without those that a link has joined with it meanwhile, and full sets
        decide.  It ends when no block has a candidate left.
        """
        label = lambda id_: labels.select(F.col("id").alias(id_), F.col("component").alias(f"{id_}_label"))
        large = members.filter("size > 2")
        named = large.join(label("id"), "id", "left").join(label("hub"), "hub", "left")
        named = named.select("key", "band", "hub", "size", "id", F.coalesce("id_label", "id").alias("label"), F.coalesce("hub_label", "hub").alias("main"))
        open_keys = named.filter("label != main").select("key").distinct()
        rows = named.filter("id != hub").join(open_keys, "key", "left_semi").distinct().join(signatures.select("id", "set_key", "signature"), "id")
        blocks = F.ceil(F.col("size") / self.block).cast("int")
        mine = F.pmod(F.xxhash64("id", "signature"), blocks).cast("int")
        rows = stored(rows.select("key", "band", "id", "set_key", "label", (F.col("label") != F.col("main")).alias("asks"), "signature", blocks.alias("blocks"), mine.alias("mine")), "open")
        ids = stored(rows.select("id").distinct(), "open_ids")
        sketches = stored(self.sets_of(docs, ids, self.sketch).dropDuplicates(["id", "set_key"]).withColumnRenamed("shingles", "sketch"), "sketches")
        kind, start, width, current = members.schema["id"].dataType.simpleString(), 0, 1, labels
        while True:
            now = rows.join(current.select("id", F.col("component").alias("now")), "id", "left").withColumn("now", F.coalesce("now", "id"))
            # block p meets block o in the group (p, o) or (o, p), the smaller number first
            met = now.join(sketches, ["id", "set_key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            met = met.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "band", "id", "label", "now", "asks", "signature", "n_shingles", "sketch")
            found = stored(met.groupBy("key", "low", "high").applyInPandas(self._offering(start, start + width), f"a {kind}, b {kind}, more boolean, exact boolean"), "offers")
            sure = found.filter("exact").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = stored(found.filter("NOT more AND NOT exact").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            verified = self.verified(docs, pairs) if not pairs.isEmpty() else pairs
            links = stored(links.unionByName(sure).unionByName(verified), "links")
            if found.filter("more").isEmpty():
                return links
            current = stored(connected_components(links), "labels")
            start, width = start + width, 8 * width

    def _offering(self, start: int, end: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda rows: self._block_offers(start, end, rows)

    def _block_offers(self, start: int, end: int, rows: pd.DataFrame) -> pd.DataFrame:
        """Two blocks: a forest of their exact links, and of the other candidates of each query those from ``start`` to ``end``, best first; a row with ``more`` says that others follow."""
        out, least, more = [], self.least_matches(), False
        ids, asks, mine = rows["id"].to_numpy(), rows["asks"].to_numpy(bool), rows["mine"].to_numpy()
        m, first, now, band = _rows(rows["signature"], np.uint32), rows["label"].to_numpy(), rows["now"].to_numpy(), rows["band"].iloc[0]
        low, high, size = rows["low"].iloc[0], rows["high"].iloc[0], rows["n_shingles"].to_numpy(np.int64)
        sketch = [np.frombuffer(x, np.uint64) for x in rows["sketch"]]
        whole = size <= self.sketch
        sets: dict[int, set] = {}
        above: dict = {}

        def root(x):
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        def as_set(j: int) -> set:
            if j not in sets:
                sets[j] = set(sketch[j].tolist())
            return sets[j]

        rank = np.empty(len(rows), np.int64)  # an order of the rows that is the same in each pass
        rank[np.lexsort((rows["signature"].to_numpy(), ids))] = np.arange(len(rows))
        for i in np.flatnonzero(asks):
            # two queries meet once, from the one that is first in order
            to = np.flatnonzero((first != first[i]) & ((low == high) | (mine != mine[i])) & (~asks | (rank > rank[i])))
            to = to[100 * np.minimum(size[to], size[i]) >= self.percent * np.maximum(size[to], size[i])]
            same = np.zeros(len(to), np.int64)
            for n, lowest in least:
                same += (m[i, n - self.batch : n] == m[to, n - self.batch : n]).sum(1)
                to, same = to[same >= lowest], same[same >= lowest]
            shared = (m[i].reshape(1, self.bands, self.rows) == m[to].reshape(-1, self.bands, self.rows)).all(2)
            good = shared.any(1) & (shared.argmax(1) == band)
            to = to[good][np.lexsort((rank[to[good]], -same[good]))]
            exact = whole[to] & whole[i]
            for j in to[exact & (now[to] != now[i])]:
                if root(now[i]) != root(now[j]):
                    common = len(as_set(i) & as_set(j))
                    if 100 * common >= self.percent * (size[i] + size[j] - common):
                        above[root(now[i])] = root(now[j])
                        out.append((ids[i], ids[j], False, True))
            to = np.array([j for j in to[~exact] if self._may_reach(sketch[i], sketch[j], whole[i], whole[j])], np.int64)
            offered, later = to[start:end], to[end:]
            more = more or bool((now[later] != now[i]).any())
            out += [(ids[i], ids[j], False, False) for j in offered[now[offered] != now[i]]]
        out += [(ids[0], ids[0], True, False)] * more
        return pd.DataFrame(out, columns=["a", "b", "more", "exact"])

    def _may_reach(self, x: np.ndarray, y: np.ndarray, x_whole: bool, y_whole: bool) -> bool:
        """Whether the smallest hashes of two sets leave the threshold possible at ``miss``: of those up to the shorter sketch's last, the common ones are a sample of the similarity."""
        end = min([np.uint64(2**64 - 1)] + [s[-1] for s, complete in ((x, x_whole), (y, y_whole)) if not complete])
        x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= _least_common(len(x) + len(y) - common, self.percent / 100, self.miss)

    def classes(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

        The component is the smallest id that links reach; ``kept`` marks the
        document of that id.  Documents with equal sets are one node of the
        graph.  Null and empty texts have no shingles and stay alone.  Rows with
        a repeated id are one document: each of its texts can link it.  A null
        id is never linked: its component is null and the row is kept.  Other
        columns of ``docs`` are not read.
        """
        rows = stored(self.features(docs), "features")
        usable = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        first = usable.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").alias("id"), "signature")).alias("first"))
        signatures = stored(first.select("set_key", "first.*"), "signatures")
        heads = signatures.select("set_key", "id")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), 4096):
                    part = batch.iloc[i : i + 4096]
                    keys = self.band_keys(_rows(part["signature"], np.uint32))
                    yield pd.DataFrame({"key": keys.ravel(), "band": np.tile(np.arange(self.bands, dtype=np.int32), len(part)), "id": np.repeat(part["id"].to_numpy(), self.bands)})

        kind = heads.schema["id"].dataType.simpleString()
        banded = signatures.select("id", "signature").mapInPandas(run, f"key bigint, band int, id {kind}")
        hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
        members = stored(banded.join(hubs, "key").select("key", "band", "hub", "size", "id"), "members")
        # equal sets, and the sets of one id, are links without any comparison
        own = usable.select("set_key", "doc_id").join(heads, "set_key").filter("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        stars = members.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        links = stored(self.verified(docs, stored(self.likely(stars, signatures), "pairs")), "links")
        labels = connected_components(links)
        labels = stored(labels, "labels")
        more = self.rivals(docs, members, links, labels, signatures)
        if more is not links:
            links, labels = more, connected_components(more)
        # the label of an id is that of the first id with its set
        roots = own.join(labels.withColumnRenamed("id", "b"), "b", "left").select("a", F.coalesce("component", "b").alias("root"))
        if not usable.groupBy("doc_id").count().filter("count > 1").isEmpty():  # repeated ids: they may join several heads
            known = connected_components(links.unionByName(own))
        else:
            known = labels.unionByName(roots.select(F.col("a").alias("id"), F.col("root").alias("component")))
        known = known.withColumnRenamed("id", "doc_id")
        out = rows.select("doc_id", "n_shingles").join(known, "doc_id", "left")
        out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """``docs`` with one document of each component, all columns as they were."""
        drop = self.classes(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
        return docs.join(drop, docs["doc_id"] == drop["__dropped"], "left_anti")


@functools.cache
def _least_common(n: int, t: float, miss: float) -> int:
    """The least m with P(Binomial(n + 1, t) <= m) >= ``miss``."""
    tail, m, log = 0.0, 0, math.log
    while m <= n:
        tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
        if tail >= miss:
            break
        m += 1
    return m


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rows(cells: pd.Series, kind: type) -> np.ndarray:
    """A column of equally long byte strings as the rows of a matrix."""
    if not len(cells):
        return np.zeros((0, 1), kind)
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)
