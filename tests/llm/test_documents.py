"""Operators on documents against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from offerlake.llm.common import WordTable, checksum
from offerlake.llm.crf import LABELS, ChainField
from offerlake.llm.minhash import NearDuplicates
from offerlake.llm.packing import CuttingStock
from offerlake.llm.pieces import ChunkedPieces
from offerlake.llm.pii import KINDS, PersonalData, base_spans, labelled_sentences, luhn
from offerlake.llm.quality import PassageAttention
from offerlake.llm.sharding import ShuffledShards, sharded_documents
from offerlake.llm.toxicity import FactorizationMachine

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets:
        for j, t in sets:
            if s and t and None not in (i, j) and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_equal_brute_force(spark, real, block):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    # chains and rivals: documents that link to each other but not to the first of their bucket
    words = [f"w{i}" for i in range(60)]
    rows += [(10_000 + k, " ".join(words[k : k + 40])) for k in range(0, 20, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, NearDuplicates(block=block).classes(docs).collect())) == brute_classes(rows)


def test_hot_bucket_of_unlinked_documents_is_dealt_in_blocks(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    def bounded(kind):
        plain = kind.applyInPandas

        def run(self, func, schema):
            def one(x):
                assert len(x) <= 64
                return func(x)

            def two(x, y):
                assert len(x) <= 64 and len(y) <= 64
                return func(x, y)

            return plain(self, two if kind is PandasCogroupedOps else one, schema)

        monkeypatch.setattr(kind, "applyInPandas", run)

    bounded(PandasCogroupedOps)
    bounded(PandasGroupedOpsMixin)
    # a shared template and own words: similarity about 0.65, so members of a key are seldom linked; some have a true twin
    template, rows = [f"t{i}" for i in range(90)], []
    for k in range(150):
        rows.append((k, " ".join([*template, *(f"own{k}x{i}" for i in range(20))])))
    rows += [(1000 + k, rows[k][1] + " more") for k in range(60, 150, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, NearDuplicates(block=16).classes(docs).collect())) == brute_classes(rows)


def test_near_duplicates_of_odd_rows(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = NearDuplicates().classes(docs)
    assert Counter(map(tuple, out.collect())) == brute_classes(rows)
    assert NearDuplicates().classes(no_docs).count() == 0
    kept = NearDuplicates().deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 9, 10, 10, 11, 12, None, None])


def test_pruning_bound():
    from math import comb

    for n, m in NearDuplicates().least_matches():
        tail = lambda k: sum(comb(n + 1, i) * 0.75**i * 0.25 ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-4 and (m == 0 or tail(m - 1) < 1e-4)


def test_shards(spark, docs, no_docs, tmp_path):
    out = sharded_documents(docs, ShuffledShards(bucket_bytes=50_000)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharded_documents(no_docs).count() == 0
    again = sharded_documents(docs, ShuffledShards(bucket_bytes=50_000)).collect()
    assert sorted((r.shard, r.slot, r.text or "") for r in again) == sorted((r.shard, r.slot, r.text or "") for r in out)


def brute_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        out += [(m.start(), m.end(), "card")] * (12 <= len(digits) <= 19 and luhn(digits))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_spans_equal_plain_patterns(real):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("a1.@+- ()b9é"), n)) for n in rng.integers(0, 60, 4000)] + [r.text or "" for r in real.collect()]
    assert all(base_spans(t) == brute_spans(t) for t in texts)


def test_personal_data(docs, no_docs, spark):
    finder = PersonalData.trained()
    rows = {r.doc_id: r for r in finder.report(docs).collect()}
    assert (rows[10].n_email, rows[10].n_ip, rows[10].n_card, rows[10].n_phone) == (1, 1, 1, 1)
    assert rows[4].spans == rows[5].spans == "" and rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert finder.report(docs).count() == docs.count() and finder.report(no_docs).count() == 0
    more = ["call (988) 555-2485 now", "write to bob(at)site.org, ok", "serial 1234567890 of 2024-05-17", "plain words only"]
    assert [s for s in finder.find(more)[1]] == [[(5, 19, "phone")], [(9, 24, "email")], [], []]
    masked = docs.select("doc_id", finder.masked(F.col("text")).alias("t")).filter("doc_id = 10 OR doc_id = 4").collect()
    assert {r.t for r in masked} == {None, "Écrivez à [EMAIL] ou [PHONE], carte [CARD], hôte [IP] ▁ <|endoftext|>"}


def test_cut_at_plain_words_is_exact(monkeypatch):
    finder = PersonalData.trained()
    assert finder.model.plain_words_are_outside()
    texts = [" ".join(w) for w, _ in labelled_sentences()] + ["12 ab 34 @ x (at) 5 5 5"]
    cut = finder.find(texts)[1]
    monkeypatch.setattr(ChainField, "plain_words_are_outside", lambda self: False)
    assert finder.find(texts)[1] == cut


def test_viterbi_is_the_best_path():
    import itertools

    from offerlake.llm.crf import features

    model = PersonalData.trained().model
    words = ["call", "+1", "(988)"]
    score = np.array([model.emit[ids].sum(0) for ids in features(words, model.size)])
    best = max(itertools.product(range(len(LABELS)), repeat=3), key=lambda p: sum(score[t, y] for t, y in enumerate(p)) + sum(model.step[p[t], p[t + 1]] for t in range(2)))
    assert model.decode([words]) == [list(best)]


def test_sentence_pieces(docs, no_docs, real):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = docs.select("doc_id", "text").union(real.select("doc_id", "text"))
    want = Counter()
    for r in table.collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    operator = ChunkedPieces(PIECES, most=50)
    assert Counter(map(tuple, operator.digests(table).collect())) == want
    assert operator.digests(no_docs).count() == 0
    assert [r.e for r in docs.select(operator.encoded(F.col("text")).alias("e")).collect()] == [sp.encode(r.text or "") for r in docs.collect()]


def test_packing(docs, no_docs, real):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    table = docs.select("doc_id", "text").union(real.select("doc_id", "text")).filter("doc_id IS NOT NULL").dropDuplicates().withColumn("doc_id", F.xxhash64("doc_id", "text"))
    out = CuttingStock(WORDS).packed(table).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d in table.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[d.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert sum(r.length for r in out) / 4096 / len(sequences) > 0.97
    assert CuttingStock(WORDS).packed(no_docs).count() == 0
    assert CuttingStock(WORDS).packed(docs).count() >= docs.count()


def test_tokens_of_odd_texts_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    alphabet = [*map(chr, range(128)), *"ÀÉÎõßẞİıŸſǅÿ×÷²½ªµ΄Σςа́", "'s", "'LL", " 're", "<|endoftext|>", "\x85", "\u2028", "\u200b"]
    texts = ["".join(rng.choice(alphabet[: 128 if i % 2 else None], rng.integers(0, 60)).tolist()) for i in range(2000)]
    texts += ["".join(rng.choice([*"abé 's!1"], 5000).tolist()), "!" * 3000 + "7" * 3000, "it'S we'LL I'd 'Tis", "\x1c\x1fa\x00b"]
    tokenizer = Tokenizer.from_file(WORDS)
    found = CuttingStock(WORDS, capacity=1 << 20, most=300).pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    held = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in found.collect()}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert held[i] == (len(ids), zlib.crc32(ids.tobytes())), text


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(1)
    demand = dict(enumerate(rng.integers(0, 50, 128).tolist(), 1))
    plan = CuttingStock(WORDS).patterns(demand)
    held = Counter()
    for pattern, times in plan:
        assert sum(c * n for c, n in pattern.items()) <= 512
        for c, n in pattern.items():
            held[c] += n * times
    assert held == Counter({c: n for c, n in demand.items() if n})
    assert sum(t for _, t in plan) <= 1.02 * sum(c * n for c, n in demand.items()) / 512 + 2
    assert CuttingStock(WORDS).patterns({}) == []


def labelled(spark, n=900):
    rng = np.random.default_rng(2)
    words = ["river", "stone", "cloud", "paper", "green", "table", "music", "window"]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, 150))
        bad, toxic = i % 3 == 0, i % 4 == 0
        if bad:
            text[50:90] = ["SPAM!!"] * 40
        if i % 4 in (0, 1):
            text[10] = "insult"
        if i % 4 in (0, 2):
            text[20] = "group"
        rows.append((i, " ".join(text), int(not bad), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")


def test_quality_on_held_out_rows(spark, docs, no_docs):
    texts, labels = labelled(spark)
    held = checksum("doc_id") % 5 == 0
    model = PassageAttention(rounds=20).fitted(texts, labels, "quality", ~held)
    rows = texts.join(labels, "doc_id").filter(held).select(model.score(F.col("text")).alias("score"), "quality").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.97
    scores = [r.s for r in docs.select(model.score(F.col("text")).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(scores) == docs.count()
    untrained = PassageAttention().fitted(no_docs, labels.limit(0), "quality", ~held)
    assert min(r.s for r in docs.select(untrained.score(F.col("text")).alias("s")).collect()) > 0.99


def test_pairs_of_terms_make_toxicity(spark, docs, no_docs):
    texts, labels = labelled(spark)
    held = checksum("doc_id") % 3 == 1
    model = FactorizationMachine(screen=10.0, rounds=150).fitted(texts, labels, "toxic", ~held)
    rows = texts.join(labels, "doc_id").filter(held).select(model.score(F.col("text")).alias("score"), "toxic").collect()
    assert np.mean([(r.score >= 0.7) == r.toxic for r in rows]) > 0.97
    assert all(0 <= r.s <= 1 for r in docs.select(model.score(F.col("text")).alias("s")).collect())
    untrained = FactorizationMachine().fitted(no_docs, labels.limit(0), "toxic", ~held)
    assert max(r.s for r in docs.select(untrained.score(F.col("text")).alias("s")).collect()) < 0.01


def test_rare_toxic_words_with_default_training():
    rng = np.random.default_rng(8)
    usual = [f"w{i}" for i in range(2000)]
    texts, y = [], []
    for i in range(900):
        words = list(rng.choice(usual, 30))
        if i % 9 == 0:
            words[7] = f"slur{i // 9 % 10}"  # each word in six or seven labelled documents, all of them toxic
        texts.append(" ".join(words))
        y.append(float(i % 9 == 0))
    model, table = FactorizationMachine(beginnings=()), WordTable(FactorizationMachine(beginnings=()).of_word)
    sets, y = [model.terms(t, table) for t in texts], np.array(y)
    score = model.fit(sets[:600], y[:600]).probabilities(sets[600:])
    pairs = score[y[600:] == 1][:, None] > score[y[600:] == 0][None, :]
    assert pairs.mean() > 0.99  # held-out AUC


def test_pair_of_terms_neutral_alone_with_default_training():
    rng = np.random.default_rng(9)
    usual = ["river", "stone", "cloud", "paper", "green", "table", "music", "window"]
    texts = [" ".join([*rng.choice(usual, 30), *["left"] * (i % 4 in (0, 1)), *["right"] * (i % 4 in (0, 2))]) for i in range(900)]
    y = np.array([float(i % 4 in (0, 3)) for i in range(900)])  # toxic with both words or with none
    model, table = FactorizationMachine(), WordTable(FactorizationMachine().of_word)
    sets = [model.terms(t, table) for t in texts]
    score = model.fit(sets[:600], y[:600]).probabilities(sets[600:])
    assert np.mean((score >= 0.7) == y[600:]) > 0.97


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    model = PassageAttention(words=20, shapes=6, width=4, gate=3)
    p = {"W": rng.normal(size=(20, 4)), "S": rng.normal(size=(6, 4)), "T": rng.normal(size=(9, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "d": rng.normal(size=1)}
    counts, per_text, y = np.array([3, 2, 0, 4]), np.array([2, 2]), np.array([1.0, 0.0])
    words, shapes, stats = rng.integers(0, 20, 9), rng.integers(0, 6, 9), rng.normal(size=(4, 9))

    def loss():
        mean = np.zeros((4, 4))
        at = 0
        for i, n in enumerate(counts):
            mean[i] = (p["W"][words[at : at + n]] + p["S"][shapes[at : at + n]]).sum(0) / max(n, 1)
            at += n
        score = model._attention(p, mean, stats, per_text)[-1]
        return float(np.mean(np.log1p(np.exp(score)) - y * score))

    grads = model._gradients(p, words, shapes, counts, per_text, stats, y)
    for name, x in p.items():
        i = np.unravel_index(np.abs(grads[name]).argmax(), x.shape)
        x[i] += 1e-5
        up = loss()
        x[i] -= 2e-5
        down = loss()
        x[i] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-6, name
