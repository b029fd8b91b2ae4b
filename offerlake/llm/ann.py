"""Approximate nearest neighbours: balanced posting lists around centroids that an in-memory graph searches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import stored
from offerlake.llm.vectors import best_of


@dataclass(frozen=True)
class PostingLists:
    """Lists of vectors around centroids, of nearly equal sizes.

    Centroids are fitted on at most ``sample`` rows (those with the smallest hash
    of their id), about ``list_rows`` rows each and at most ``lists`` of them,
    which bounds what every task holds.  All rows are indexed: a vector goes to
    its nearest centroid and to others not farther than ``1 + near`` times that,
    up to ``copies`` lists.  A list longer than ``block`` rows, such as one
    of equal vectors, is kept in several blocks.  A query takes the lists whose
    centroids are within ``1 + reach`` times its nearest one, and more until
    they hold ``spare`` times k rows.
    """

    sample: int = 32_768
    lists: int = 1024
    list_rows: int = 400
    near: float = 0.05
    copies: int = 2
    reach: float = 0.15
    spare: int = 32
    block: int = 4096
    degree: int = 16
    beam: int = 192
    starts: int = 16
    rounds: int = 10
    seed: int = 7

    # -- the index -----------------------------------------------------------------------------------------------

    def centroids(self, rows: DataFrame) -> np.ndarray:
        """Balanced k-means: a centroid's distances grow with the rows it already has."""
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.sample).select("v").collect()
        x = np.array([r["v"] for r in picked], dtype=np.float64)
        if not len(x):
            return np.zeros((0, 1))
        different = np.unique(x, axis=0)
        k = int(np.clip(rows.count() // self.list_rows, 1, min(self.lists, len(different))))
        rng = np.random.default_rng(self.seed)
        c = different[rng.choice(len(different), k, replace=False)]
        weight = np.zeros(k)
        for _ in range(self.rounds):
            square = _squares(x, c)
            scale = np.median(square.min(1))
            mine = (square + weight[None, :] * scale).argmin(1)
            counts = np.bincount(mine, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, mine, x)
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
            weight += 0.1 * (counts * k / len(x) - 1)
            weight -= weight.min()
        return c

    def graph(self, c: np.ndarray) -> np.ndarray:
        """Neighbours of each centroid: near ones in different directions, and a ring that keeps the graph in one piece."""
        k, degree = len(c), min(self.degree, max(1, len(c) - 1))
        square = _squares(c, c)
        out = np.empty((k, degree + 2), np.int64)
        for i in range(k):
            near = [int(j) for j in np.argsort(square[i], kind="stable")[: 4 * degree + 1] if j != i]
            kept: list[int] = []
            for j in near:
                if len(kept) < degree and all(square[i, j] < square[j, o] for o in kept):
                    kept.append(j)
            kept += [j for j in near if j not in kept][: degree - len(kept)]
            kept += [i] * (degree - len(kept))
            out[i] = [*kept, (i + 1) % k, (i - 1) % k]
        return out

    def nearest_lists(self, q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of the graph for all queries at once: ``beam`` centroids per query and their distances, nearest first."""
        beam, rows = min(beam, len(c)), np.arange(len(q))[:, None]
        start = np.unique(np.linspace(0, len(c) - 1, min(len(c), self.starts)).astype(np.int64))
        seen, opened = np.zeros((len(q), len(c)), bool), np.zeros((len(q), len(c)), bool)
        far = np.full((len(q), len(c)), np.inf)
        far[:, start], seen[:, start] = _squares(q, c[start]), True
        while True:
            best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            todo = np.where(opened[rows, best], np.inf, far[rows, best])
            pick = np.argsort(todo, axis=1)[:, :4]
            live = np.isfinite(np.take_along_axis(todo, pick, 1))
            if not live.any():
                break
            node = np.take_along_axis(best, pick, 1)
            r, s = np.nonzero(live)
            opened[r, node[r, s]] = True
            r, n = np.repeat(r, graph.shape[1]), graph[node[r, s]].ravel()
            new = ~seen[r, n]
            r, n = r[new], n[new]
            seen[r, n] = True
            far[r, n] = ((q[r] - c[n]) ** 2).sum(1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        return order, np.sqrt(far[rows, order])

    def postings(self, rows: DataFrame, c: np.ndarray) -> DataFrame:
        """``(list, vec_id, v, own)``: every row in its lists; ``own`` marks the nearest one."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), 2048):
                    part = batch.iloc[i : i + 2048]
                    far = np.sqrt(_squares(np.stack(part["v"].to_numpy()), c))
                    near = np.argsort(far, axis=1, kind="stable")[:, : self.copies]
                    d = np.take_along_axis(far, near, 1)
                    keep = d <= (1 + self.near) * d[:, :1]
                    r, s = np.nonzero(keep)
                    yield pd.DataFrame({"list": near[r, s].astype(np.int32), "vec_id": part["vec_id"].to_numpy()[r], "v": part["v"].to_numpy()[r], "own": s == 0})

        return rows.mapInPandas(run, "list int, vec_id bigint, v array<double>, own boolean")

    # -- the search ----------------------------------------------------------------------------------------------

    def search(self, rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, rank, vec_id, score)``: the ``k`` nearest found rows of each query by Euclidean distance.

        Ties go to the smaller ``vec_id``; a query does not meet rows with its
        own id.  An empty table gives an empty result, and with few rows all are
        candidates.  Of repeated queries the smallest vector asks.
        """
        c = self.centroids(rows)
        if not len(c):
            return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        posted = stored(self.postings(rows, c), "postings")
        counts = {r["list"]: (r["n"], r["own"]) for r in posted.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect()}
        sizes = np.array([counts.get(i, (0, 0)) for i in range(len(c))])  # one row per list, at most `lists`
        parts, graph = np.maximum(1, -(-sizes[:, 0] // self.block)), self.graph(c)

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), 1024):
                    part = batch.iloc[i : i + 1024]
                    lists, far = self.nearest_lists(np.stack(part["v"].to_numpy()), c, graph, self.beam)
                    before = np.cumsum(sizes[lists, 1], axis=1) - sizes[lists, 1]
                    take = (far <= (1 + self.reach) * far[:, :1]) | (before < self.spare * (k + 1))
                    r, s = np.nonzero(take)
                    yield pd.DataFrame({"asked": lists[r, s].astype(np.int32), "query_id": part["vec_id"].to_numpy()[r], "q": part["v"].to_numpy()[r], "parts": parts[lists[r, s]].astype(np.int32)})

        asks = queries.groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(choose, "asked int, query_id bigint, q array<double>, parts int")
        asks = asks.select("asked", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "query_id", "q")
        known = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
        placed = posted.select("list", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), known).cast("int").alias("part"), "vec_id", "v")

        def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            ids, x, out = right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), []
            asking, q = left["query_id"].to_numpy(), np.stack(left["q"].to_numpy())
            first = k * int(np.unique(ids, return_counts=True)[1].max())  # rows that share an id count once
            for i in range(0, len(q), 256):
                near = _squares(q[i : i + 256], x)
                near[asking[i : i + 256, None] == ids[None, :]] = np.inf
                edge = np.partition(near, first - 1, axis=1)[:, first - 1] if len(ids) > first else np.full(len(near), np.inf)
                slack = 1e-9 * ((q[i : i + 256] ** 2).sum(1) + (x * x).sum(1).max())  # far above the rounding of the products
                r, s = np.nonzero(np.isfinite(near) & (near <= (edge + slack)[:, None]))
                score = np.sqrt(((x[s] - q[i + r]) ** 2).sum(1))
                order = np.lexsort((score, ids[s], r))
                r, s, score = r[order], s[order], score[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (ids[s[1:]] != ids[s[:-1]])
                r, s, score = r[new], s[new], score[new]
                order = np.lexsort((ids[s], score, r))
                r, s, score = r[order], s[order], score[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append(pd.DataFrame({"query_id": asking[i + r[best]], "vec_id": ids[s[best]], "score": score[best]}))
            return pd.concat(out)

        found = asks.groupBy("asked", "slice").cogroup(placed.groupBy("list", "part")).applyInPandas(measure, "query_id bigint, vec_id bigint, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # copies of a row in several lists
        return best_of(once, k, F.asc("score"), F.asc("vec_id")).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)
