"""Exact top-k by inner product: three phases with one uniform threshold per query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import stored
from offerlake.llm.vectors import best_of, blocks, ids_of, matrix_of

LIMIT = 2.0**53  #: integers below it are exact in float64


@dataclass(frozen=True)
class ThresholdTopK:
    """The ``k`` best rows of each query, where each of ``nodes`` lists holds a part of every score.

    The components are dealt to the nodes, so a node knows one summand of each
    inner product.  Summands are counted from the node's least one for the
    query, which makes them non-negative and moves all sums of a query alike.
    Phase 1: each node lists its ``depth`` * k best summands, looks up the sums
    of those rows and sends the k highest; the k-th best sum of all lists is a
    safe cutoff, since k rows reach it.  Phase 2: a
    row whose every summand is below cutoff / nodes cannot reach the cutoff, so
    each node sends the summands from that threshold on.  Phase 3: of these
    rows, those whose upper bound reaches the k-th best lower bound of their
    block get their missing summands exactly.

    Queries and rows meet block by block: every query against all rows.
    """

    k: int = 20
    nodes: int = 2
    depth: int = 5
    block_rows: int = 16384
    query_rows: int = 2048
    step: int = 128
    tasks: int = 96  #: pairs of a block and a group of chunks, if there are as many

    def search(self, rows: DataFrame, queries: DataFrame) -> DataFrame:
        """``(query_id, rank, vec_id, score)`` for integer vectors ``(vec_id, v)``.

        Ties go to the smaller ``vec_id``.  A query does not meet rows with its
        own id.  With fewer than k other rows all are returned, with none
        nothing.  Sums must stay below 2^53 in absolute value; others are an error.
        Repeated ids are rows of their own; of repeated queries the smallest vector asks.
        """
        queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
        data, asked = stored(blocks(rows, self.block_rows, "block"), "blocks"), stored(blocks(queries, self.query_rows, "chunk"), "chunks")
        n, m = data.count(), asked.count()
        # The chunks repeat for every block and the blocks for every group of chunks, so neither side is small: both are
        # sorted and merged, since a broadcast would collect all tiles on the driver.  A block is read once per group.
        groups = max(1, min(m, -(-self.tasks // max(n, 1))))
        held = data.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("block", "group", "ids", "matrix")
        asks = asked.withColumns({"group": F.col("chunk") % groups, "block": F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))})
        asks = asks.select("block", "group", "chunk", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        tiles = asks.join(held.hint("merge"), ["block", "group"]).withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(self.nodes - 1))))

        lists = tiles.mapInPandas(self._local_lists, "query_id bigint, node int, low double, row bigint, sum double")
        cutoffs = stored(self._cutoffs(lists), "cutoffs")
        # the cutoffs of a chunk's queries, in the order of its matrix
        by_chunk = asked.mapInPandas(_positions, "chunk int, query_id bigint, place int").join(cutoffs, "query_id")
        packed = by_chunk.groupBy("chunk").applyInPandas(lambda part: self._pack_cutoffs(part), "chunk int, lows binary, cuts binary")
        sent = tiles.join(packed, "chunk").mapInPandas(self._sufficient, "block int, chunk int, node int, ids binary, matrix binary, q_ids binary, q_matrix binary, lows binary, cuts binary, rows binary, columns binary, parts binary")
        found = sent.groupBy("block", "chunk").applyInPandas(lambda part: self._resolve(part), "query_id bigint, vec_id bigint, score bigint")
        best = best_of(found, self.k, F.desc("score"), F.asc("vec_id"))
        return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    def _columns(self, width: int, node: int) -> slice:
        return slice(width * node // self.nodes, width * (node + 1) // self.nodes)

    def _tile(self, row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, q_ids = ids_of(row.ids), ids_of(row.q_ids)
        x, q = matrix_of(row.matrix, len(ids)), matrix_of(row.q_matrix, len(q_ids))
        if len(ids) and len(q_ids) and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= LIMIT:
            raise ValueError("a score may exceed 2^53")
        return ids, q_ids, x, q

    def _local_lists(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phase 1 of one node and block: each query's least summand and, of the rows with its best summands, the k highest sums."""
        for batch in batches:
            for row in batch.itertuples():
                ids, q_ids, x, q = self._tile(row)
                at = self._columns(x.shape[1], row.node)
                for i in range(0, len(q_ids), self.step):
                    parts = q[i : i + self.step, at] @ x[:, at].T
                    low = parts.min(1)
                    parts[q_ids[i : i + self.step, None] == ids[None, :]] = -np.inf
                    size = min(len(ids), self.depth * self.k)
                    best = np.argpartition(parts, len(ids) - size, axis=1)[:, len(ids) - size :]
                    values = np.einsum("ijk,ik->ij", x[best], q[i : i + self.step])
                    values[np.isneginf(np.take_along_axis(parts, best, 1))] = -np.inf
                    if size > self.k:
                        top = np.argpartition(values, size - self.k, axis=1)[:, size - self.k :]
                        best, values = np.take_along_axis(best, top, 1), np.take_along_axis(values, top, 1)
                    good = np.isfinite(values)
                    count = best.shape[1]
                    out = pd.DataFrame({"query_id": np.repeat(q_ids[i : i + self.step], count), "node": np.int32(row.node), "low": np.repeat(low, count), "row": (row.block * 2**32 + best).ravel(), "sum": values.ravel()})
                    yield out[good.ravel()]

    def _cutoffs(self, lists: DataFrame) -> DataFrame:
        """``(query_id, lows, cut)``: the least summand per node, and the k-th best sum of the lists."""
        lows = lists.groupBy("query_id", "node").agg(F.min("low").alias("low"))
        sums = lists.groupBy("query_id", "row").agg(F.max("sum").alias("sum"))  # the nodes agree on a row's sum
        last = best_of(sums, self.k, F.desc("sum"), F.asc("row")).filter(F.col("rank") == self.k).select("query_id", "sum")
        nodes = lows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("node", "low"))).alias("lows"), F.sum("low").alias("least"))
        return nodes.join(last, "query_id", "left").select("query_id", "lows.low", F.coalesce(F.col("sum") - F.col("least"), F.lit(0.0)).alias("cut"))

    def _pack_cutoffs(self, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        lows = np.full((part["place"].max() + 1, self.nodes), np.nan)
        cuts = np.full(len(lows), np.nan)
        lows[part["place"]], cuts[part["place"]] = np.stack(part["low"].to_numpy()), part["cut"]
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "lows": [lows.tobytes()], "cuts": [cuts.tobytes()]})

    def _sufficient(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phase 2 of one node and block: its own components and all summands from the uniform threshold on."""
        for batch in batches:
            for row in batch.itertuples():
                ids, q_ids, x, q = self._tile(row)
                lows, cuts = np.frombuffer(row.lows).reshape(-1, self.nodes), np.frombuffer(row.cuts)
                at, found = self._columns(x.shape[1], row.node), []
                for i in range(0, len(cuts), self.step):
                    parts = q[i : min(i + self.step, len(cuts)), at] @ x[:, at].T - lows[i : i + self.step, row.node, None]
                    good = parts * self.nodes >= cuts[i : i + self.step, None]
                    r, c = np.nonzero(good)
                    found.append((r + i, c, parts[r, c]))
                r, c, p = (np.concatenate(z) if found else np.zeros(0) for z in (zip(*found, strict=True) if found else [(), (), ()]))
                own = {"matrix": [x[:, at].tobytes()], "q_matrix": [q[:, at].tobytes()]}
                yield pd.DataFrame({name: [getattr(row, name)] for name in ("block", "chunk", "node", "ids", "q_ids", "lows", "cuts")} | own | {"rows": [r.astype(np.int32).tobytes()], "columns": [c.astype(np.int32).tobytes()], "parts": [p.tobytes()]})

    def _resolve(self, part: pd.DataFrame) -> pd.DataFrame:
        """Phase 3 of one block: bounds from what the nodes sent, then the missing summands of those within them."""
        part = part.sort_values("node")
        row = next(part.itertuples())
        ids, q_ids = ids_of(row.ids), ids_of(row.q_ids)
        x = np.hstack([matrix_of(s.matrix, len(ids)) for s in part.itertuples()])
        q = np.hstack([matrix_of(s.q_matrix, len(q_ids)) for s in part.itertuples()])
        lows, cuts = np.frombuffer(row.lows).reshape(-1, self.nodes), np.frombuffer(row.cuts)
        sent = []
        for s in part.itertuples():
            r, c, p = np.frombuffer(s.rows, np.int32), np.frombuffer(s.columns, np.int32), np.frombuffer(s.parts)
            sent.append((s.node, r, c, p))
        out = []
        for i in range(0, len(cuts), self.step):
            n = min(self.step, len(cuts) - i)
            known, seen = np.zeros((n, len(ids))), np.zeros((n, len(ids)), np.int8)
            has = np.zeros((self.nodes, n, len(ids)), bool)
            for node, r, c, p in sent:
                a, b = np.searchsorted(r, [i, i + n])
                known[r[a:b] - i, c[a:b]] += p[a:b]
                seen[r[a:b] - i, c[a:b]] += 1
                has[node, r[a:b] - i, c[a:b]] = True
            own = q_ids[i : i + n, None] == ids[None, :]
            seen[own], known[own] = 0, 0
            floor = np.partition(known, -self.k, axis=1)[:, -self.k] if len(ids) >= self.k else np.zeros(n)
            bound = known + (self.nodes - seen) * (cuts[i : i + n, None] / self.nodes)
            r, c = np.nonzero((seen > 0) & (bound >= np.maximum(floor, cuts[i : i + n])[:, None] - 1e-6))
            total = known[r, c]
            for node in range(self.nodes):
                at = self._columns(x.shape[1], node)
                for j in range(0, len(r), 65536):
                    rr, cc = r[j : j + 65536], c[j : j + 65536]
                    miss = np.flatnonzero(~has[node, rr, cc])
                    total[j + miss] += np.einsum("ij,ij->i", q[i + rr[miss], at], x[cc[miss], at]) - lows[i + rr[miss], node]
            score = np.rint(total + lows[i + r].sum(1)).astype(np.int64)
            order = np.lexsort((ids[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < self.k
            out.append(pd.DataFrame({"query_id": q_ids[i + r[keep]], "vec_id": ids[c[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            ids = ids_of(row.ids)
            yield pd.DataFrame({"chunk": np.full(len(ids), row.chunk, np.int32), "query_id": ids, "place": np.arange(len(ids), dtype=np.int32)})
