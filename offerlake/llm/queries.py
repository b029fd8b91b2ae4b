"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.ann import PostingLists
from offerlake.llm.byte_pairs import TreeBytePairs
from offerlake.llm.common import checksum, load
from offerlake.llm.hard_negatives import HyperplaneTree, labelled_vectors
from offerlake.llm.minhash import NearDuplicates
from offerlake.llm.packing import CuttingStock
from offerlake.llm.pieces import ChunkedPieces
from offerlake.llm.pii import PersonalData
from offerlake.llm.prefix_trie import PrefixTrie
from offerlake.llm.quality import PassageAttention
from offerlake.llm.sharding import sharded_documents, text_bytes
from offerlake.llm.topk import ThresholdTopK
from offerlake.llm.toxicity import FactorizationMachine
from offerlake.llm.vectors import usable
from offerlake.llm.warc import Archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op1_minhash_near_dedup",
    """
    WITH RECURSIVE worded AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
    shingled AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
    sized AS (SELECT doc_id, len(s) AS n FROM shingled),
    flat AS (SELECT doc_id, hash(unnest(s)) AS g FROM shingled),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    near AS (SELECT a, b FROM common JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
    links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT z.doc_id, z.n AS n_shingles, m.component_id, z.doc_id = m.component_id AS kept
    FROM sized z JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
    """,
)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates().classes(load(spark, folder, "documents"))


@query("op2_external_shuffle")
def external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharded_documents(load(spark, folder, "documents"))
    return shards.select(
        "doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op3_threshold_top_k",
    """
    WITH valid AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
               FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def threshold_top_k(spark: SparkSession, folder: str) -> DataFrame:
    whole = usable(load(spark, folder, "embeddings"), strict=True).select("vec_id", F.transform("v", lambda x: F.floor(64 * x).cast("double")).alias("v"))
    return ThresholdTopK(k=20).search(whole, whole.filter("vec_id % 20 = 0"))


@query(
    "op4_warc_index_merge",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x FROM p),
    b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 40), lambda i: right('000' || bin(CAST('0x' || substr(x, CAST(i AS INTEGER) + 1, 1) AS INTEGER)), 4)), 'string_agg', '') AS bits FROM h),
    d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
          + 16 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 2, 1) AS INTEGER)
          + 4 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i AS INTEGER) + 4, 1) AS INTEGER)
          + CAST(substr(bits, CAST(5 * i AS INTEGER) + 5, 1) AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM b)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
    """,
)
def warc_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    return Archives().captured(load(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_sentencepiece_chunks")
def sentencepiece_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return ChunkedPieces(public_tokenizers.path("piece_bpe_32k.model")).digests(load(spark, folder, "documents"))


@query("op8_cutting_stock_packing")
def cutting_stock_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = CuttingStock(public_tokenizers.path("word_bpe_49k.json")).packed(load(spark, folder, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_posting_list_search")
def posting_list_search(spark: SparkSession, folder: str) -> DataFrame:
    whole = usable(load(spark, folder, "embeddings"), zero=False, strict=True)
    return PostingLists().search(whole, whole.filter("vec_id % 100 = 0"), k=10)


@query("op5_crf_personal_data")
def crf_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return PersonalData.trained().report(load(spark, folder, "documents"))


@query("op6_passage_attention")
def passage_attention(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = load(spark, folder, "documents"), checksum("doc_id") % 5 == 0
    model = PassageAttention().fitted(docs, load(spark, folder, "labels"), "quality", ~held)
    scored = docs.select("doc_id", held.alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op9_factorization_machine")
def factorization_machine(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = load(spark, folder, "documents"), checksum("doc_id") % 3 == 1
    model = FactorizationMachine().fitted(docs, load(spark, folder, "labels"), "toxic", ~held)
    scored = docs.select("doc_id", held.alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op13_tree_byte_pairs")
def tree_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return TreeBytePairs(public_tokenizers.path("byte_bpe_50k.json")).digests(load(spark, folder, "documents"))


@query(
    "op12_prefix_trie",
    """
    WITH t AS (
        SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
    crc AS (SELECT c, n, c - c % 5 AS b, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
                lambda a, z: list_reduce(list_prepend(xor(a, z), range(8)), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, CAST(3988292384 AS BIGINT)) ELSE s >> 1 END)),
                CAST(4294967295 AS BIGINT)) % 9 AS h FROM ids),
    plan AS (SELECT crc.*, least(h, coalesce(o.n, 0)) AS kept FROM crc LEFT JOIN ids o ON o.c = crc.b),
    rebuilt AS (
        SELECT p.c, t.i AS d, r, x FROM plan p JOIN t ON t.c = p.b AND t.i <= p.h
        UNION ALL SELECT p.c, t.i - p.h + p.kept, r, x FROM plan p JOIN t ON t.c = p.c AND t.i > p.h),
    sized AS (SELECT p.c, count(r.d) AS size FROM plan p LEFT JOIN rebuilt r ON r.c = p.c GROUP BY 1),
    prefixed AS (
        SELECT c, d, x, string_agg(md5(concat(strlen(r), ':', r, x)), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS k FROM rebuilt
        UNION ALL SELECT c, 0, '', '' FROM sized),
    walked AS (SELECT p.*, size, min(c) OVER (PARTITION BY d, k) AS m FROM prefixed p JOIN sized USING (c)),
    stepped AS (SELECT *, lag(m) OVER (PARTITION BY c ORDER BY d) AS up FROM walked),
    node AS (SELECT m, d, max(CASE WHEN c = m THEN up END) AS up, count(*) AS n, (count(*) - 1) * strlen(any_value(x)) AS saved,
                    CAST(count(*) FILTER (d = size) = count(*) AS BIGINT) AS leaf, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size), '') AS ends FROM stepped GROUP BY 1, 2),
    tails AS (SELECT s.c, s.d, s.m, sum(CASE WHEN s.c = s.m THEN leaf ELSE 0 END) OVER w AS leaves, sum(CASE WHEN s.c = s.m THEN saved ELSE 0 END) OVER w AS saved
              FROM stepped s JOIN node USING (m, d) WINDOW w AS (PARTITION BY s.c ORDER BY s.d DESC)),
    totals AS (SELECT m, d, sum(leaves) AS leaves, sum(saved) AS saved FROM tails GROUP BY 1, 2),
    children AS (SELECT up AS m, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2)
    SELECT m AS conv_id, d AS depth, up AS parent_conv_id, node.n AS n_convs, coalesce(children.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
           CAST(totals.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
    FROM node JOIN totals USING (m, d) LEFT JOIN children USING (m, d)
    """,
)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return PrefixTrie().with_shared_starts(load(spark, folder, "conversations"))


@query(
    "op11_hyperplane_negatives",
    """
    WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS s
               FROM valid a JOIN valid c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    positive AS (SELECT a, c AS p, s AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5),
    hard AS (SELECT x.a, x.p, x.ps, n.c, n.s, CAST(row_number() OVER (PARTITION BY x.a, x.p ORDER BY n.s DESC, n.c) AS INTEGER) AS rank
             FROM positive x JOIN scored n ON n.a = x.a AND NOT n.same AND 80 * x.ps <= 100 * n.s AND 100 * n.s <= 100 * x.ps)
    SELECT a AS anchor_id, p AS positive_id, rank, c AS negative_id, ps AS positive_score, s AS negative_score FROM hard WHERE rank <= 5
    """,
)
def hyperplane_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return HyperplaneTree().mined(labelled_vectors(load(spark, folder, "embeddings"), label, 256.0), F.col("vec_id") % 100 == 0)
