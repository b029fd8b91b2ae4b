"""Hard negatives against brute force: hot vectors, one leaf, many leaves, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import queries
from offerlake.llm.hard_negatives import HyperplaneTree, distances, labelled_vectors, lifted
from tests.llm.conftest import SMALL
from verify_checks import compare, database


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 5)) * 2
    x = (centers[rng.integers(6, size=600)] + rng.normal(size=(600, 5)) * 0.4).round(2)
    x[100:300] = x[100]  # a hot vector
    x[300:310] = 0
    rows = [(i, v.tolist(), int(rng.integers(3)), "e") for i, v in enumerate(x)]
    rows += [(0, x[7].tolist(), 1, "again"), (20, x[20].tolist(), rows[20][2], "again"), (5, x[9].tolist(), 2, "again")]
    rows += [(700, None, 1, "n"), (701, [], 1, "n"), (702, [1.0, None, 0.0, 0.0, 0.0], 1, "n"), (703, [float("nan")] * 5, 1, "n"), (704, [float("-inf")] * 5, 2, "n")]
    rows += [(705, [1.0] * 5, None, "n"), (None, [1.0] * 5, 1, "n")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, source string")
    for name in ("row", "leaf", "slice", "part", "n", "rank", "score", "v"):
        frame = frame.selectExpr("*", f"concat('{name}', vec_id) AS `{name}`")
    return frame


def brute(rows: list, anchors, positives=5, negatives=5):
    """Each row is a candidate of its own; ties of equal ids by position."""
    x = np.floor(np.array([r.v for r in rows]))
    out = []
    for i, a in enumerate(rows):
        if not anchors(a.vec_id):
            continue
        scores = (x @ x[i]).astype(int)
        same = sorted((-scores[j], r.vec_id, j) for j, r in enumerate(rows) if j != i and r.label == a.label)[:positives]
        for p, pid, _ in same:
            hard = sorted((-scores[j], r.vec_id, j) for j, r in enumerate(rows) if r.label != a.label and 80 * -p <= 100 * scores[j] <= 100 * -p)[:negatives]
            out += [(a.vec_id, pid, n, nid, -p, -s) for n, (s, nid, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("operator", [HyperplaneTree(), HyperplaneTree(arity=3, leaf_rows=20, least=4, block=16, ask=3), HyperplaneTree(arity=4, leaf_rows=10, least=2, sample=50, block=7, positives=3, negatives=2)])
def test_equals_brute_force(vectors, operator):
    rows = labelled_vectors(vectors, F.col("label"), 16.0)
    got = sorted(tuple(r) for r in operator.mined(rows, F.col("vec_id") % 20 == 0).collect())
    want = brute(rows.collect(), lambda i: i % 20 == 0, operator.positives, operator.negatives)
    assert got == want and len(got) > 100


def test_ranges_drop_leaves_and_no_row():
    rng = np.random.default_rng(6)
    x = np.floor(np.vstack([rng.normal(c, 3, size=(200, 4)) for c in rng.normal(0, 60, size=(20, 4))]))
    tree, top = HyperplaneTree(arity=4, leaf_rows=50, least=20), float((x * x).sum(1).max())
    y = lifted(x, top)
    steps = tree.fitted(y, len(x))
    leaf, ranges = tree.leaves_of(steps, y), [np.tile([np.inf, -np.inf], (len(p), len(p), 1)) for p, _ in steps]
    for i in range(len(x)):
        at = 0
        while at >= 0:
            d = distances(y[i : i + 1], steps[at][0])[0]
            j = int(d.argmin())
            ranges[at][:, j, 0], ranges[at][:, j, 1] = np.minimum(ranges[at][:, j, 0], d), np.maximum(ranges[at][:, j, 1], d)
            at = int(steps[at][1][j])
    q, scores, visited = x[::40], x[::40] @ x.T, 0
    best = np.sort(scores, axis=1)[:, -6]
    base = (q * q).sum(1) + top
    inner, outer = np.sqrt(base - 2 * best)[:, None], np.sqrt(base - 1.6 * best)[:, None]
    reached = {(int(a), l) for l, mine in tree.survivors(steps, ranges, np.hstack([q, np.zeros((len(q), 1))]), inner, outer) for a in mine}
    for a in range(len(q)):
        wanted = np.flatnonzero((scores[a] <= best[a]) & (scores[a] >= 0.8 * best[a]))
        assert {(a, int(leaf[i])) for i in wanted} <= reached
    assert len(reached) < 0.7 * len(q) * (leaf.max() + 1)


def test_odd_tables(spark, vectors):
    tree = HyperplaneTree()
    assert tree.mined(labelled_vectors(vectors.limit(0), F.col("label")), F.lit(True)).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], "vec_id bigint, embedding array<double>, label int")
    assert tree.mined(labelled_vectors(one, F.col("label")), F.lit(True)).collect() == []
    equal = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(9)], "vec_id bigint, embedding array<double>, label int")
    rows = labelled_vectors(equal, F.col("label"))
    assert sorted(tuple(r) for r in tree.mined(rows, F.lit(True)).collect()) == brute(rows.collect(), lambda i: True)
    with pytest.raises(ValueError, match="several lengths"):
        labelled_vectors(one.union(spark.createDataFrame([(1, [1.0], 1)], one.schema)), F.col("label"))
    with pytest.raises(ValueError, match="2\\^53"):
        tree.mined(labelled_vectors(one, F.col("label"), 1e9), F.lit(True))


def test_query_equals_sql(spark):
    name = "op11_hyperplane_negatives"
    assert compare(queries.QUERIES[name](spark, SMALL), database(SMALL), queries.ORACLES[name]).startswith("ok")
