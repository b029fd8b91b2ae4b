"""Hard negatives by exact windowed search in a multiway hyperplane tree with sibling ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import stored
from offerlake.llm.topk import LIMIT

Step = tuple[np.ndarray, np.ndarray]  #: the split points of a tree node, and its children: inner nodes from 0, leaves as their complement


def labelled_vectors(table: DataFrame, label: Column, scale: float = 1.0, vector: str = "embedding") -> DataFrame:
    """``(vec_id, label, v)`` with ``v`` the components times ``scale`` as doubles.

    Rows without id or label, null or empty vectors and vectors with null or
    non-finite components take no part; usable vectors of several lengths are an
    error.  Repeated ids are rows of their own; other columns are not read.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = table.select("vec_id", label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = named.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").filter(F.forall("v", finite))
    lengths = rows.select(F.size("v").alias("n")).distinct().orderBy("n").head(2)
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths[0]['n']} and {lengths[1]['n']} components")
    return rows.select("vec_id", "label", F.transform("v", lambda x: x * scale).alias("v"))


@dataclass(frozen=True)
class HyperplaneTree:
    """All rows in the leaves of a tree whose nodes split them by the nearest of ``arity`` split points.

    Scores are inner products.  All rows get one more component that gives them
    the same norm, anchors get 0 there: then the distance of an anchor and a row
    falls as their score rises, and a window of scores is an annulus around
    the anchor.  Split points are far-apart rows of a sample of at most ``sample``
    rows (those with the smallest hash of their id); the tree stops at about
    ``leaf_rows`` rows or ``least`` sample rows a leaf, which bounds what every task
    holds.  All rows are indexed.  Each split point keeps the range of its
    distances to the rows of every sibling subtree.  A search drops a subtree if
    for one split point no distance in its range can meet the annulus; by the
    triangle inequality no row of the window is lost.  Leaves are compared whole
    and exactly, in blocks of at most ``block`` rows.

    Vectors are floored to whole numbers, so scores are exact below 2^53; larger
    ones are an error.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    arity: int = 8
    leaf_rows: int = 2048
    least: int = 32
    sample: int = 16_384
    block: int = 4096
    ask: int = 1024
    seed: int = 5

    # -- the tree ------------------------------------------------------------------------------------------------

    def fitted(self, x: np.ndarray, rows: int) -> list[Step]:
        """Nodes in breadth-first order; the leaves are numbered as they come."""
        rng, steps, todo, leaves = np.random.default_rng(self.seed), [], [np.arange(len(x))], 0
        least = max(self.least, int(self.leaf_rows * len(x) / max(1, rows)))
        waiting: list[tuple[int, int] | None] = [None]
        while todo:
            mine, place = todo.pop(0), waiting.pop(0)
            points = self._split_points(x[mine], rng) if len(mine) > least or not steps else x[:0]
            if len(points) < 2 and steps:
                steps[place[0]][1][place[1]] = ~leaves
                leaves += 1
                continue
            if len(points) == 0:
                points = x[mine[:1]]
            near = distances(x[mine], points).argmin(1)
            steps.append((points, np.zeros(len(points), np.int64)))
            if place:
                steps[place[0]][1][place[1]] = len(steps) - 1
            for i in range(len(points)):
                if len(points) == 1:
                    steps[-1][1][0] = ~leaves
                    leaves += 1
                else:
                    todo.append(mine[near == i])
                    waiting.append((len(steps) - 1, i))
        return steps

    def _split_points(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Up to ``arity`` different rows, each the farthest of some random ones from those before."""
        some = x[rng.choice(len(x), min(len(x), 6 * self.arity), replace=False)]
        picked, far = [0], distances(some, some[:1])[:, 0]
        while len(picked) < self.arity and far.max() > self.slack(some):
            picked.append(int(far.argmax()))
            far = np.minimum(far, distances(some, some[picked[-1:]])[:, 0])
        return some[picked]

    @staticmethod
    def slack(x: np.ndarray) -> float:
        """Far above the rounding of a distance, far below a difference of whole numbers."""
        return 1e-5 * float(np.sqrt((x * x).sum(1).max(initial=0.0))) + 1e-12

    @staticmethod
    def leaves_of(steps: list[Step], x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root to the child of the nearest split point."""
        at = np.zeros(len(x), np.int64)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                mine = np.flatnonzero(at == node)
                at[mine] = steps[node][1][distances(x[mine], steps[node][0]).argmin(1)]
        return ~at

    def survivors(self, steps: list[Step], ranges: list[np.ndarray], q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf, anchors)`` that the annuli ``inner[q, j] .. outer[q, j]`` may reach; NaN marks an annulus that is not asked."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, mine = todo.pop()
            if node < 0:
                yield ~node, mine
                continue
            points, children = steps[node]
            d, slack = distances(q[mine], points), self.slack(points) + self.slack(q)
            for j, child in enumerate(children):
                low, high = ranges[node][:, j, 0] - slack, ranges[node][:, j, 1] + slack
                if low[0] > high[0]:
                    continue  # no row
                nearest = np.maximum(np.maximum(d - high, low - d), 0).max(1)
                farthest = (d + high).min(1)
                meets = ((nearest[:, None] <= outer[mine] + slack) & (farthest[:, None] >= inner[mine] - slack)).any(1)
                if meets.any():
                    todo.append((int(child), mine[meets]))

    # -- jobs ----------------------------------------------------------------------------------------------------

    def mined(self, rows: DataFrame, anchors: Column) -> DataFrame:
        """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the rows ``(vec_id, label, v)``.

        An anchor's positives are its ``positives`` best other rows of the same
        label.  Its negatives for a positive are the ``negatives`` best rows of
        other labels whose score is from ``low`` to ``high`` percent of the
        positive's.  Ties go to the smaller id.  Pairs without negatives have no
        rows, and so has an empty table; rows that share an id are told apart,
        so a repeated anchor asks once for each of its rows and meets its copies.
        """
        spark = rows.sparkSession
        square = F.aggregate(F.transform("v", lambda x: F.floor(x).cast("double")), F.lit(0.0), lambda a, x: a + x * x)
        size = rows.agg(F.max(square).alias("top"), F.count("*").alias("n")).first()
        shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        if not size["n"]:
            return spark.createDataFrame([], shape)
        top = size["top"] * (1 + 1e-12)
        if top >= LIMIT:
            raise ValueError("a score may exceed 2^53")
        x = np.floor(np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.sample).select("v").collect()], np.float64))
        steps = self.fitted(lifted(x, top), size["n"])

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                v = np.floor(np.stack(batch["v"].to_numpy()))
                yield pd.DataFrame({"row": batch["row"], "vec_id": batch["vec_id"], "label": batch["label"], "leaf": self.leaves_of(steps, lifted(v, top)).astype(np.int32), "v": list(v)})

        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v")
        placed = stored(numbered.mapInPandas(place, "row bigint, vec_id bigint, label bigint, leaf int, v array<double>"), "tree_rows")
        counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row per leaf of the fitted tree
        leaves = max(-int(children.min()) for _, children in steps)
        slices = np.array([-(-counts.get(i, 0) // self.block) for i in range(leaves)])
        blocks = stored(self._blocks(placed, slices, steps, top), "tree_blocks")
        ranges = self._ranges(blocks, steps)
        asking = placed.filter(anchors)
        asking = stored(asking.repartition(max(1, asking.count() // (4 * self.ask)), "leaf"), "anchors")

        bounds = self._first_bounds(asking, blocks)
        windows = asking.join(bounds, "row", "left").select("row", "vec_id", "label", "v", F.array(F.coalesce("bound", F.lit(float("-inf")))).alias("scores"))
        near = self._met(windows, blocks, slices, steps, ranges, top, self._same_label, lambda s: (np.full(s.shape, -np.inf), s))
        best = near.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other"))).filter(F.col("n") <= self.positives)
        positives = stored(best.select("row", "n", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

        wanted = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "positive_score"))).alias("p"))  # at most `positives` of them
        windows = asking.join(wanted, "row").select("row", "vec_id", "label", "v", F.transform("p", lambda p: p["positive_score"].cast("double")).alias("scores"))
        inside = lambda s: (s * self.low / 100, np.where(s >= 0, s * self.high / 100, np.nan))
        hard = self._met(windows, blocks, slices, steps, ranges, top, self._in_windows, lambda s: (inside(s)[1], inside(s)[0]))
        rank = F.row_number().over(Window.partitionBy("row", "n").orderBy(F.desc("score"), "vec_id", "other"))
        chosen = hard.withColumn("rank", rank).filter(F.col("rank") <= self.negatives)
        named = chosen.join(positives, ["row", "n"]).join(asking.select("row", F.col("vec_id").alias("anchor_id")), "row")
        return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    def _blocks(self, placed: DataFrame, slices: np.ndarray, steps: list[Step], top: float) -> DataFrame:
        """``(leaf, slice, ids, rows, labels, matrix, ranges)``: parts of leaves, by id, with their distances to the split points above as ``(node, point, child, low, high)``."""
        paths: dict[int, list[tuple[int, int]]] = {}
        above: dict[int, tuple[int, int]] = {int(c): (node, j) for node, (_, children) in enumerate(steps) for j, c in enumerate(children)}
        for leaf in range(len(slices)):
            path, at = [], ~leaf
            while at in above:
                path.append(above[at])
                at = above[at][0] or "root"
            paths[leaf] = path

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["vec_id", "row"])
            x = np.stack(part["v"].to_numpy())
            leaf, ranges = int(part["leaf"].iloc[0]), []
            for node, child in paths[leaf]:
                d = distances(lifted(x, top), steps[node][0])
                ranges += [{"node": node, "point": i, "child": child, "low": d[:, i].min(), "high": d[:, i].max()} for i in range(d.shape[1])]
            cells = [leaf, part["slice"].iloc[0], *[part[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row", "label")], *packed(x), ranges]
            return pd.DataFrame([cells], columns=["leaf", "slice", "ids", "rows", "labels", "kind", "matrix", "ranges"])

        parts = F.element_at(F.array(*[F.lit(int(max(1, s))) for s in slices]), F.col("leaf") + 1)
        dealt = placed.withColumn("slice", F.pmod(F.xxhash64("row"), parts).cast("int"))
        shape = "leaf int, slice int, ids binary, rows binary, labels binary, kind string, matrix binary, ranges array<struct<node int, point int, child int, low double, high double>>"
        return dealt.groupBy("leaf", "slice").applyInPandas(pack, shape)

    def _ranges(self, blocks: DataFrame, steps: list[Step]) -> list[np.ndarray]:
        """Per node ``[point, child] -> (low, high)``; as many numbers as the fitted tree has pairs of siblings."""
        out = [np.tile([np.inf, -np.inf], (len(p), len(p), 1)) for p, _ in steps]
        each = blocks.select(F.inline("ranges")).groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        for r in each.collect():
            out[r["node"]][r["point"], r["child"]] = r["low"], r["high"]
        return out

    def _first_bounds(self, asking: DataFrame, blocks: DataFrame) -> DataFrame:
        """``(row, bound)``: the score of the last of an anchor's positives in the first block of its own leaf, if that holds enough."""
        first = blocks.filter("slice = 0").select("leaf", "ids", "rows", "labels", "kind", "matrix")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    block = Block(r)
                    rows, labels, q = np.frombuffer(r.q_rows, np.int64), np.frombuffer(r.q_labels, np.int64), unpacked(r.q_kind, r.q_matrix, len(r.q_rows) // 8)
                    scores = block.scores(q)
                    scores[(labels[:, None] != block.labels[None, :]) | (rows[:, None] == block.rows[None, :])] = -np.inf
                    if scores.shape[1] >= self.positives:
                        yield pd.DataFrame({"row": rows, "bound": np.partition(scores, -self.positives, axis=1)[:, -self.positives]})

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for leaf, part in batch.groupby("leaf"):
                    for i in range(0, len(part), self.ask):
                        some = part.iloc[i : i + self.ask]
                        kind, matrix = packed(np.stack(some["v"].to_numpy()))
                        yield pd.DataFrame({"leaf": [leaf], "q_rows": [some["row"].to_numpy(np.int64).tobytes()], "q_labels": [some["label"].to_numpy(np.int64).tobytes()], "q_kind": [kind], "q_matrix": [matrix]})

        asks = asking.select("leaf", "row", "label", "v").mapInPandas(pack, "leaf int, q_rows binary, q_labels binary, q_kind string, q_matrix binary")
        return asks.join(first, "leaf").mapInPandas(run, "row bigint, bound double")

    def _met(self, windows: DataFrame, blocks: DataFrame, slices: np.ndarray, steps: list[Step], ranges: list[np.ndarray], top: float, pick: Callable, span: Callable) -> DataFrame:
        """What ``pick`` finds for the anchors ``(row, label, v, scores)`` in the blocks that the annuli of ``span(scores)``, highest and lowest score, reach.

        Anchors travel in packets to the leaves that they survive for; a group is
        one block and at most 64 packets of ``ask`` anchors.
        """
        width = self.positives

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, here = 0, TaskContext.get().partitionId()
            for batch in batches:
                for i in range(0, len(batch), self.ask):
                    part = batch.iloc[i : i + self.ask]
                    q, rows, labels = np.stack(part["v"].to_numpy()), part["row"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
                    scores = np.full((len(part), width), np.nan)
                    for n, s in enumerate(part["scores"]):
                        scores[n, : len(s)] = s
                    highest, lowest = span(scores)
                    base = (q * q).sum(1)[:, None] + top
                    inner = np.where(np.isinf(highest), 0, np.sqrt(np.maximum(base - 2 * np.where(np.isinf(highest), 0, highest), 0)))
                    outer = np.where(np.isinf(lowest), np.inf, np.sqrt(np.maximum(base - 2 * np.where(np.isinf(lowest), 0, lowest), 0)))
                    lift, out = np.hstack([q, np.zeros((len(q), 1))]), []
                    for leaf, mine in self.survivors(steps, ranges, lift, inner, outer):
                        for s in range(slices[leaf]):
                            out.append((leaf, s, here * 2**20 + number // 64, rows[mine].tobytes(), labels[mine].tobytes(), *packed(q[mine]), scores[mine].tobytes()))
                    number += 1
                    yield pd.DataFrame(out, columns=["leaf", "slice", "part", "q_rows", "q_labels", "q_kind", "q_matrix", "q_scores"])

        def meet(key: tuple, asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"row": [], "n": [], "score": [], "vec_id": [], "other": []})]
            for r in block.itertuples():
                whole = Block(r)
                for a in asks.itertuples():
                    count = len(a.q_rows) // 8
                    q, scores = unpacked(a.q_kind, a.q_matrix, count), np.frombuffer(a.q_scores).reshape(count, width)
                    rows, labels = np.frombuffer(a.q_rows, np.int64), np.frombuffer(a.q_labels, np.int64)
                    for i in range(0, count, 128):
                        found = whole.scores(q[i : i + 128])
                        same = labels[i : i + 128, None] == whole.labels[None, :]
                        for n, keep in pick(found, same, rows[i : i + 128, None] == whole.rows[None, :], scores[i : i + 128]):
                            at, column = first_of(found, keep, self.positives if n == 0 else self.negatives)
                            out.append(pd.DataFrame({"row": rows[i + at], "n": n, "score": found[at, column].astype(np.int64), "vec_id": whole.ids[column], "other": whole.rows[column]}))
            return pd.concat(out)

        asks = stored(windows.mapInPandas(visit, "leaf int, slice int, part bigint, q_rows binary, q_labels binary, q_kind string, q_matrix binary, q_scores binary"), "visits")
        copies = blocks.drop("ranges").join(asks.select("leaf", "slice", "part").distinct(), ["leaf", "slice"])
        copies = copies.select(*[F.col(c).alias(f"b_{c}") for c in ("leaf", "slice", "part")], "ids", "rows", "labels", "kind", "matrix")
        shape = "row bigint, n int, score bigint, vec_id bigint, other bigint"
        return asks.groupBy("leaf", "slice", "part").cogroup(copies.groupBy("b_leaf", "b_slice", "b_part")).applyInPandas(meet, shape)

    @staticmethod
    def _same_label(found: np.ndarray, same: np.ndarray, itself: np.ndarray, scores: np.ndarray):
        yield 0, same & ~itself & (found >= scores[:, :1])

    def _in_windows(self, found: np.ndarray, same: np.ndarray, itself: np.ndarray, scores: np.ndarray):
        for n in range(scores.shape[1]):
            p = scores[:, n : n + 1]
            yield n + 1, ~same & (self.low * p <= 100 * found) & (100 * found <= self.high * p)


class Block:
    """A block of a leaf as arrays."""

    def __init__(self, row):
        self.ids, self.rows, self.labels = (np.frombuffer(c, np.int64) for c in (row.ids, row.rows, row.labels))
        self.x = unpacked(row.kind, row.matrix, len(self.ids))

    def scores(self, q: np.ndarray) -> np.ndarray:
        if len(q) and np.abs(q).max() * np.abs(self.x).max() * q.shape[1] >= LIMIT:
            raise ValueError("a score may exceed 2^53")
        return q @ self.x.T


def first_of(scores: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest kept scores of each row, ties to the earlier column."""
    masked = np.where(keep, scores, -np.inf)
    if masked.shape[1] > k:
        keep = keep & (masked >= np.partition(masked, -k, axis=1)[:, -k :][:, :1])
    r, c = np.nonzero(keep)
    order = np.lexsort((c, -masked[r, c], r))
    r, c = r[order], c[order]
    best = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[best], c[best]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * x @ points.T, 0))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with one more component, which brings their squared norm to ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, cell: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(cell, kind).reshape(rows, -1).astype(np.float64)
