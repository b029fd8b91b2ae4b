"""Tree concatenation against the tokenizers library, text by text."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from offerlake.llm import queries
from offerlake.llm.byte_pairs import TreeBytePairs
from tests.llm.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text: str):
    from tokenizers import Tokenizer

    global _LIBRARY
    if "_LIBRARY" not in globals():
        _LIBRARY = Tokenizer.from_file(PATH)
    ids = _LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, _LIBRARY.decode(ids, skip_special_tokens=False)


def digest(text: str | None):
    ids, decoded = library(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.fixture(scope="module")
def stretches(spark):
    """Long unsplit texts whose joins agree late, early and never, with added tokens and white space between."""
    rng = random.Random(4)
    runs = ["a" * 5001, "ab" * 3000 + "c", " " * 3000 + "x", "\n" * 777, "é" * 2500, "汉字" * 900, "1" * 4097, "=-" * 2000, "　" * 900, "x" * 64 + "<|endoftext|>" + "y" * 500]
    runs += ["".join(rng.choice("abcdeinorstu") for _ in range(3000)), "".join(rng.choice("aA ") for _ in range(4000)), "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000))]
    texts = runs + [f"plain words, then {a}{b} and more <|endoftext|>{a}" for a, b in zip(runs, runs[3:], strict=False)]
    return spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id int, text string")


@pytest.mark.parametrize("operator", [TreeBytePairs(PATH), TreeBytePairs(PATH, leaf=64, window=1), TreeBytePairs(PATH, leaf=5, window=3)])
def test_long_stretches(stretches, operator):
    want = sorted((r.doc_id, *digest(r.text)) for r in stretches.collect())
    assert sorted(map(tuple, operator.digests(stretches).collect())) == want
    coded = operator.encoded(stretches)
    assert sorted((r.doc_id, tuple(r.ids)) for r in coded.collect()) == sorted((r.doc_id, tuple(library(r.text)[0])) for r in stretches.collect())
    assert sorted(map(tuple, operator.decoded(coded).collect())) == sorted(map(tuple, stretches.collect()))


def test_odd_rows(docs, no_docs):
    rows = docs.collect()
    got = TreeBytePairs(PATH).digests(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, *digest(r.text))) for r in rows)
    assert TreeBytePairs(PATH).digests(no_docs).collect() == []
    assert TreeBytePairs(PATH).encoded(docs.filter("text IS NULL")).select(F.size("ids")).distinct().collect()[0][0] == 0


def test_query_equals_the_library(spark, real):
    got = queries.QUERIES["op13_tree_byte_pairs"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *digest(r.text)) for r in real.collect())


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        TreeBytePairs(public_tokenizers.path("word_bpe_49k.json")).refuse_unfit()
