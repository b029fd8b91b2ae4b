"""The prefix trie of conversations, its totals rolled up by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import checksum, stored

NODE = ["conv_id", "depth"]


@dataclass(frozen=True)
class PrefixTrie:
    """Conversations as paths of a trie: one node for each distinct sequence of first turns.

    A node is named by its smallest member and its depth.  Prefixes are told
    apart by their length and the sum of two 60-bit numbers from the SHA-256 of
    each position's role and text, which running sums over the slices of a
    conversation give however long it is.

    Totals over subtrees are rolled up by centroid decomposition of the forest
    of parent edges.  The weight of a node is the number of conversation turns
    at or below it, known from grouping alone.  In a component, the nodes that
    hold more than half of its weight are one path from its top down to its
    centroid.  The centroid's total in the component is added to each node of
    that path; then the centroid's subtree is cut off, the centroid itself is
    done, its children's subtrees and the rest above go on as components of
    their own.  The weight of a component halves in each round, so the rounds
    grow with the logarithm of the turns, not with the depth of the trie.
    Components of at most ``small`` nodes are split further within one task.

    Rows without conversation id take no part; null turns come first, equal
    turn numbers are ordered by role and text; null role and text are empty;
    repeated rows are turns of their own.  An empty table has no trie, not
    even a root.  Other columns are not read.
    """

    small: int = 4096
    chunk: int = 4096

    # -- conversations as rows -----------------------------------------------------------------------------------

    def numbered(self, conversations: DataFrame) -> DataFrame:
        """``(conv, i, part, a, b, bytes)``: turn ``i`` of a conversation from 1, what it says as two numbers, and the slice that holds it.

        Rows are dealt out by range and numbered in their order; a conversation
        that spans slices gets its earlier slices' counts added.
        """
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
        rows = conversations.filter("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("bigint").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("copy")
        )
        digest = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv", F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")
        )
        placed = stored(placed.withColumn("part", F.shiftright("at", 33).cast("int")), "turns")
        first = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = first.select("conv", "part", (F.col("first") - earlier - 1).alias("shift"))
        return placed.join(starts, ["conv", "part"]).select("conv", (F.col("at") - F.col("shift")).alias("i"), "part", "digest", "bytes")

    def shared_starts(self, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The conversations of the dealt workload as ``(conv, d, part, digest, bytes)``, and all ids: a shared start, then a conversation's own turns after it."""
        ids = turns.groupBy("conv").agg(F.count("*").alias("n"))
        plan = ids.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), (checksum("conv") % 9).alias("h"))
        bases = ids.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
        plan = plan.join(bases, "base", "left").withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0))))
        starts = turns.filter("i <= 8").select(F.col("conv").alias("base"), "i", "digest", "bytes")
        shared = starts.join(plan.select("base", "conv", "h"), "base").filter("i <= h").select("conv", F.col("i").alias("d"), F.lit(-1).alias("part"), "digest", "bytes")
        own = turns.join(plan.select("conv", "h", "kept"), "conv").filter("i > h").select("conv", (F.col("i") - F.col("h") + F.col("kept")).alias("d"), "part", "digest", "bytes")
        size = (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")
        return shared.unionByName(own), plan.select("conv", size)

    def paths(self, turns: DataFrame, sizes: DataFrame) -> DataFrame:
        """``(conv, d, a, b, pa, pb, bytes, size)``: each turn with the keys of the prefix that it ends and of the one before."""
        number = lambda at: F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("d").cast("string"), "digest"), 256), at, 15), 16, 10).cast("decimal(38,0)")
        rows = stored(turns.select("conv", F.col("d").cast("bigint").alias("d"), "part", "bytes", number(1).alias("x"), number(16).alias("y")), "positions")
        slices = rows.groupBy("conv", "part").agg(F.sum("x").cast("decimal(38,0)").alias("sx"), F.sum("y").cast("decimal(38,0)").alias("sy"))
        before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select("conv", "part", *[F.coalesce(F.sum(s).over(before), F.lit(0)).cast("decimal(38,0)").alias(s) for s in ("sx", "sy")])
        upto = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        summed = rows.join(carried, ["conv", "part"])
        for s, x, end, start in (("sx", "x", "a", "pa"), ("sy", "y", "b", "pb")):
            summed = summed.withColumn(end, (F.col(s) + F.sum(x).over(upto)).cast("decimal(38,0)")).withColumn(start, (F.col(end) - F.col(x)).cast("decimal(38,0)"))
        return summed.join(sizes, "conv").select("conv", "d", "a", "b", "pa", "pb", "bytes", "size")

    # -- the trie ------------------------------------------------------------------------------------------------

    def nodes(self, turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes ``(conv_id, depth, parent, n_convs, ends, weight, saved)`` and, for every conversation and depth, the node on its path: ``(conv, d, node, ends)``."""
        zero, nothing = F.lit(0).cast("decimal(38,0)"), F.lit(None).cast("decimal(38,0)")
        roots = sizes.select("conv", F.lit(0).cast("bigint").alias("d"), zero.alias("a"), zero.alias("b"), nothing.alias("pa"), nothing.alias("pb"), F.lit(0).cast("bigint").alias("bytes"), "size")
        rows = stored(self.paths(turns, sizes).unionByName(roots), "paths")
        grouped = rows.groupBy("d", "a", "b").agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("size") == F.col("d")).cast("bigint")).alias("ends"),
            F.sum(F.col("size") - F.col("d") + 1).alias("weight"), F.max("bytes").alias("bytes"),
        )
        grouped = stored(grouped, "nodes")
        # one large group meets one node here: a skewed join on equality, which is split at run time
        walked = rows.join(grouped.select("d", "a", "b", F.col("conv_id").alias("node")), ["d", "a", "b"])
        walked = stored(walked.select("conv", "d", "node", (F.col("size") == F.col("d")).alias("ends")), "walks")
        above = walked.select(F.col("conv").alias("conv_id"), (F.col("d") + 1).alias("depth"), F.col("node").alias("parent"))
        nodes = grouped.withColumnRenamed("d", "depth").join(above, NODE, "left")
        return nodes.select(*NODE, "parent", "n_convs", "ends", "weight", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), walked

    def rolled_up(self, nodes: DataFrame, walked: DataFrame) -> DataFrame:
        """``(conv_id, depth, n_leaves, saved_tokens)``, summed over each node's subtree."""
        start = nodes.select(*NODE, "parent", "weight", F.col("leaf").cast("bigint").alias("n_leaves"), "saved")
        # the whole trie is the first component; later ones are named by their top, which is never the root
        open_rows = start.withColumns({"top": F.lit(0).cast("bigint"), "top_depth": F.lit(0).cast("bigint")})
        part, added, solved = ["top", "top_depth"], [], []
        while True:
            sizes = open_rows.groupBy(*part).agg(F.count("*").alias("k"), F.max("weight").alias("total"))
            sized = stored(open_rows.join(sizes, part), "components")
            solved.append(sized.filter(F.col("k") <= self.small))
            large = sized.filter(F.col("k") > self.small)
            if large.isEmpty():
                break
            cut = self._cut(large, walked)
            added.append(cut.filter("sum_leaves IS NOT NULL").select(*NODE, F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved")))
            open_rows = cut.filter("NOT done").select(*NODE, "parent", F.col("rest").alias("weight"), "n_leaves", "saved", F.col("next").alias("top"), F.col("next_depth").alias("top_depth"))
        inside = [self._inside(s) for s in solved]
        totals = inside[0]
        for more in inside[1:] + added:
            totals = totals.unionByName(more)
        return totals.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    def _cut(self, large: DataFrame, walked: DataFrame) -> DataFrame:
        """One round on large components: centroid, its total for the path above it, and the components that are left."""
        part = ["top", "top_depth"]
        heavy = large.filter("2 * weight > total").groupBy(*part).agg(F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("g"))
        centroids = heavy.select(*part, F.col("g.conv_id").alias("g_conv"), F.col("g.depth").alias("g_depth"), F.col("g.weight").alias("g_weight"))
        placed = large.join(centroids, part)
        # which child of the centroid a deeper node lies under: the node that its smallest member passes one below the centroid
        salt = F.floor(F.col("depth") / self.small)
        key = ["conv_id", "g_conv", "g_depth", "salt"]
        placed = placed.withColumn("salt", salt)
        asked = placed.filter("depth > g_depth").select(*key, (F.col("g_depth") + 1).alias("g_below")).distinct()
        below = walked.select(F.col("conv").alias("conv_id"), F.col("d").alias("g_below"), F.col("node").alias("child"))
        passing = walked.select(F.col("conv").alias("conv_id"), F.col("d").alias("g_depth"), F.col("node").alias("g_conv"))
        under = asked.join(below, ["conv_id", "g_below"]).join(passing, ["conv_id", "g_depth", "g_conv"]).select(*key, "child")
        marked = placed.join(under, key, "left").withColumn("child", F.when(F.col("depth") > F.col("g_depth"), F.col("child")))
        itself = (F.col("conv_id") == F.col("g_conv")) & (F.col("depth") == F.col("g_depth"))
        marked = stored(marked.withColumn("done", itself), "cuts")
        below = marked.filter("done OR child IS NOT NULL").groupBy(*part).agg(F.sum("n_leaves").alias("sum_leaves"), F.sum("saved").alias("sum_saved"))
        on_path = 2 * F.col("weight") > F.col("total")
        out = marked.join(below, part)
        return out.select(
            *NODE, "parent", "n_leaves", "saved", "done", *[F.when(on_path, F.col(c)).alias(c) for c in ("sum_leaves", "sum_saved")],
            (F.col("weight") - F.when(on_path & ~F.col("done"), F.col("g_weight")).otherwise(0)).alias("rest"),
            F.coalesce("child", "top").alias("next"), F.when(F.col("child").isNotNull(), F.col("g_depth") + 1).otherwise(F.col("top_depth")).alias("next_depth"),
        )

    def _inside(self, rows: DataFrame) -> DataFrame:
        """The same decomposition of small components, whole ones in a task; a task holds one batch and one component at a time."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left = None
            for batch in batches:
                batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
                key = batch[["top", "top_depth"]].to_numpy(np.int64)
                last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key != key[-1]).any() else 0
                left = batch.iloc[last:]
                if last:
                    yield _decomposed(batch.iloc[:last])
            if left is not None and len(left):
                yield _decomposed(left)

        order = ["top", "top_depth", "depth", "conv_id"]
        ready = rows.select(*order, F.coalesce("parent", F.lit(0)).alias("parent"), "weight", "n_leaves", "saved").repartition("top", "top_depth").sortWithinPartitions(*order)
        return ready.mapInPandas(run, "conv_id bigint, depth bigint, n_leaves bigint, saved bigint")

    # -- whole answers -------------------------------------------------------------------------------------------

    def end_hashes(self, walked: DataFrame) -> DataFrame:
        """``(conv_id, depth, ends_sha256)`` of the nodes at which conversations end: SHA-256 of the sorted ids.

        The ids of a node are put together in chunks of ``chunk`` consecutive
        numbers first.  A node of several chunks is hashed as its chunks stream
        by in order, never held as a whole.
        """
        chunk = F.expr(f"conv - pmod(conv, {self.chunk}L)").alias("chunk")
        ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
        chunks = stored(walked.filter("ends").groupBy(F.col("node").alias("conv_id"), F.col("d").alias("depth"), chunk).agg(ids), "ends")
        several = chunks.groupBy(*NODE).count().filter("count > 1").select(*NODE)
        alone = chunks.join(several, NODE, "left_anti").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, None
            for batch in batches:
                out = []
                for conv, depth, ids in zip(batch["conv_id"], batch["depth"], batch["ids"], strict=True):
                    if (conv, depth) != now:
                        if now:
                            out.append((*now, state.hexdigest()))
                        now, state = (conv, depth), hashlib.sha256(ids.encode())
                    else:
                        state.update(f",{ids}".encode())
                yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
            if now:
                yield pd.DataFrame([(*now, state.hexdigest())], columns=[*NODE, "ends_sha256"])

        joined = chunks.join(several, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
        return alone.unionByName(joined.select(*NODE, "ids").mapInPandas(run, "conv_id bigint, depth bigint, ends_sha256 string"))

    def summary(self, turns: DataFrame, sizes: DataFrame) -> DataFrame:
        """All nodes of the trie of ``(conv, d, part, digest, bytes)`` and of the conversations ``(conv, size)``, turnless ones included."""
        nodes, walked = self.nodes(turns, sizes)
        nodes = stored(nodes.withColumn("leaf", F.col("ends") == F.col("n_convs")), "trie")
        children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        out = nodes.join(self.rolled_up(nodes, walked), NODE).join(children, NODE, "left").join(self.end_hashes(walked), NODE, "left")
        return out.select(
            *NODE, F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )

    def of_conversations(self, conversations: DataFrame) -> DataFrame:
        """The trie of conversations as they are."""
        turns = self.numbered(conversations)
        return self.summary(turns.withColumnRenamed("i", "d"), turns.groupBy("conv").agg(F.count("*").alias("size")))

    def with_shared_starts(self, conversations: DataFrame) -> DataFrame:
        """The trie of the conversations that :meth:`shared_starts` makes of them."""
        return self.summary(*self.shared_starts(stored(self.numbered(conversations), "numbered")))


def _decomposed(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals inside whole components (rows ordered by component and depth)."""
    key = rows[["top", "top_depth"]].to_numpy(np.int64)
    borders = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(rows)]
    conv, depth = rows["conv_id"].to_numpy(np.int64), rows["depth"].to_numpy(np.int64)
    parent, weight = rows["parent"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64).copy()
    values = rows[["n_leaves", "saved"]].to_numpy(np.int64)
    totals = np.zeros_like(values)
    for i, j in zip(borders, borders[1:], strict=False):
        if j - i == 1:
            totals[i] = values[i]
        else:
            _centroids(conv[i:j].tolist(), depth[i:j].tolist(), parent[i:j].tolist(), weight[i:j], values[i:j], totals[i:j])
    return pd.DataFrame({"conv_id": conv, "depth": depth, "n_leaves": totals[:, 0], "saved": totals[:, 1]})


def _centroids(conv: list, depth: list, parent: list, weight: np.ndarray, values: np.ndarray, totals: np.ndarray) -> None:
    """One component: nodes in preorder, so that a subtree is an interval of every component it is in."""
    at = {(c, d): n for n, (c, d) in enumerate(zip(conv, depth, strict=True))}
    children: list[list[int]] = [[] for _ in conv]
    for n in range(1, len(conv)):
        children[at[parent[n], depth[n] - 1]].append(n)
    order, end, stack = [], np.zeros(len(conv), np.int64), [0]
    while stack:
        n = stack.pop()
        if n < 0:
            end[~n] = len(order)
            continue
        order.append(n)
        stack.append(~n)
        stack.extend(children[n])
    order = np.array(order)
    weight, values, last = weight[order], values[order], end[order]
    out = np.zeros_like(values)
    components = [np.arange(len(order))]
    while components:
        nodes = components.pop()
        if len(nodes) == 1:
            out[nodes] += values[nodes]
            continue
        path = nodes[2 * weight[nodes] > weight[nodes[0]]]
        g = path[-1]
        i, j = np.searchsorted(nodes, [g, last[g]])
        out[path] += values[nodes[i:j]].sum(0)
        weight[path[:-1]] -= weight[g]
        if i or j < len(nodes):
            components.append(np.concatenate([nodes[:i], nodes[j:]]))
        i += 1
        while i < j:
            n = int(np.searchsorted(nodes, last[nodes[i]]))
            components.append(nodes[i:n])
            i = n
    totals[order] = out
