"""Vector searches and web archives against brute force, and on odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerlake.llm import queries
from offerlake.llm.ann import PostingLists
from offerlake.llm.components import connected_components
from offerlake.llm.topk import ThresholdTopK
from offerlake.llm.vectors import usable
from offerlake.llm.warc import Archives, merged
from tests.llm.conftest import SMALL
from verify_checks import compare, database


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6)).round(3)
    x[50:150] = x[50]  # a hot vector
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(400, None, "n"), (401, [], "n"), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], "n"), (403, [float("nan")] * 6, "n"), (404, [float("inf")] * 6, "n")]
    rows += [(405, [0.0] * 6, "z"), (406, [1.0, 2.0], "s"), (None, [1.0] * 6, "n")]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, block string")


@pytest.mark.parametrize("operator", [ThresholdTopK(k=5), ThresholdTopK(k=5, nodes=3, block_rows=40, query_rows=7, step=3), ThresholdTopK(k=1000)])
def test_threshold_top_k(vectors, operator):
    rows = usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(64 * x).cast("double")).alias("v"))
    table = {r.vec_id: np.array(r.v) for r in rows.collect()}
    assert set(table) == {*range(300), 405}
    got = operator.search(rows, rows.filter("vec_id % 20 = 0")).collect()
    want = set()
    for q in (i for i in table if i % 20 == 0):
        best = sorted((-int(table[q] @ v), i) for i, v in table.items() if i != q)[: operator.k]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert operator.search(rows.limit(0), rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_threshold_top_k", "op7_posting_list_search"])
def test_vectors_of_several_lengths_are_an_error(vectors, spark, tmp_path, name):
    from offerlake.llm.queries import QUERIES

    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(ValueError, match="several lengths"):
        QUERIES[name](spark, str(tmp_path))


def test_top_k_with_repeated_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [3.0, 1.0]), (20, [3.0, 1.0])], "vec_id bigint, v array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in ThresholdTopK(k=3).search(rows, rows.filter("vec_id = 20")).collect()]
    assert got == [(20, 1, 5), (20, 1, 5)]


def test_posting_lists(vectors, spark):
    rows = usable(vectors, zero=False)
    table = {r.vec_id: np.array(r.v) for r in rows.collect()}
    assert set(table) == set(range(300))
    operator = PostingLists(list_rows=20, block=30)
    got = operator.search(rows, rows.filter("vec_id % 10 = 0"), k=5).collect()
    hits = 0
    for q in range(0, 300, 10):
        best = [i for _, i in sorted((float(np.sqrt(((table[q] - v) ** 2).sum())), i) for i, v in table.items() if i != q)[:5]]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - np.sqrt(((table[q] - table[r.vec_id]) ** 2).sum())) < 1e-12 for r in mine)
        hits += len(set(best) & {r.vec_id for r in mine})
    assert hits >= 0.9 * 150
    assert operator.search(rows.limit(0), rows.limit(0)).count() == 0
    few = rows.filter("vec_id < 4")
    assert operator.search(few, few, k=5).count() == 12


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    c, q, operator = rng.normal(size=(200, 8)), rng.normal(size=(40, 8)), PostingLists()
    lists, far = operator.nearest_lists(q, c, operator.graph(c), 20)
    exact = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(lists, np.argsort(exact, 1)[:, :20], strict=True)]) > 0.95
    assert (np.diff(far) >= 0).all()


def test_loser_tree():
    rng = random.Random(5)
    for k in range(12):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 8))) for _ in range(k)]
        got = [(runs[r][i], r, i) for r, i in merged(runs)]
        assert got == sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://www.b.example.org/x", "same"), (2, "https://a.example.org/y#z", "same"), (3, None, None), (4, "http://a.example.org/y", ""), (5, "http://h.example/1", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0"),
        (6, "http://h.example/\r\n2", "é" * 100000), (7, "http://h.example/3", "other"), (7, "http://h.example/3", "other"), (None, "http://n.example/", "same"), (None, None, "alone"),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "'y' AS kind", "1 AS size")


def test_archives(pages, tmp_path, spark):
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Archives(records=3).captured(pages).collect())
    rows, want = [(r.page_id, (r.html or "").encode()) for r in pages.collect()], Counter()
    for page, body in rows:
        last = max((p for p, b in rows if b == body and p is not None), default=None)
        want[page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if page == last else "revisit", None if page == last else last] += 1
    assert got == want
    assert Archives().captured(pages.limit(0)).count() == 0
    Archives().write(pages, str(tmp_path / "w"))
    content = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "w").glob("*.gz")))
    assert content.startswith(b"WARC/1.0\r\nWARC-Type: re") and content.endswith(b"\r\n\r\n")


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    sizes = [0, 3, 90, 110, 500, 700, 3900, 4000, 4001, 9000] * 3
    rows = [(i, f"https://a.test/{i}", None if not n else chr(97 + i % 26) * (n - 1) + str(i // 26), "x") for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2)
    archives = Archives(records=40, payload=4000)
    assert archives.size_limits() == [100, 800, 4000]
    archives.write(pages, str(tmp_path / "w"))
    got = archives.read(spark, str(tmp_path / "w")).select("run", "page_id", "payload_bytes", "record_type").collect()
    assert sorted(r.page_id for r in got) == list(range(len(sizes)))
    files = {}
    for r in got:
        files.setdefault(r.run, []).append(r.payload_bytes)
    assert all(len(f) <= 40 and (sum(f) <= 4000 or len(f) == 1) for f in files.values())
    assert any(len(f) > 2 for f in files.values())


def test_histories_are_in_global_order(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = Archives(records=20).captured(pages.repartition(5)).select("url_key", "captured_at", "page_id").collect()
    assert [tuple(r) for r in rows] == sorted(map(tuple, rows)) and len(rows) == pages.count()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = compare(queries.QUERIES[name](spark, SMALL), database(SMALL), queries.ORACLES[name])
    assert got.startswith("ok"), got


def test_all_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_equals_its_stages_by_hand(spark):
    """Filters by the queries' scores, one document per class, masked texts, and pieces that cover exactly what is left."""
    from collections import defaultdict

    from offerlake.llm.minhash import NearDuplicates
    from offerlake.llm.pii import PersonalData
    from offerlake.llm.packing import CuttingStock

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    bad = {r.doc_id for r in queries.QUERIES["op6_passage_attention"](spark, SMALL).collect() if r.predicted == 0}
    toxic = {r.doc_id for r in queries.QUERIES["op9_factorization_machine"](spark, SMALL).collect() if r.predicted == 1}
    left = spark.createDataFrame([(i, t) for i, t in docs.items() if i not in bad | toxic], "doc_id bigint, text string")
    kept = {r.doc_id for r in NearDuplicates().classes(left).collect() if r.kept}
    finder = PersonalData.trained()
    masked = spark.createDataFrame([(r.doc_id, r.text) for r in left.filter(F.col("doc_id").isin(kept)).select("doc_id", finder.masked(F.col("text")).alias("text")).collect()], "doc_id bigint, text string")
    want = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in CuttingStock(corpus_pipeline.TOKENIZER).pieces(masked).collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]


def test_stages_on_odd_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SMALL)
            assert out.columns == table.columns, name
            assert out.count() <= table.count()
