from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, base, "en"), (2, base.upper(), "en"), (3, base + " more", "en"), (4, None, None), (5, "", "de"), (6, "  \n\t ", "de"), (7, "one two", "fr"), (8, "One\x0btwo", None),
        (9, "word " * 30000, "en"), (10, "Écrivez à bo@site.example.org ou +1 (988) 555-2485, carte 4111 1111 1111 1111, hôte 10.0.0.7 ▁ <|endoftext|>", "fr"),
        (10, "Écrivez à bo@site.example.org ou +1 (988) 555-2485, carte 4111 1111 1111 1111, hôte 10.0.0.7 ▁ <|endoftext|>", "fr"),
        (None, base, "en"), (None, None, None), (11, "x" * 200000, "en"), (12, "a  b \n c", "en"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for name in ("shard", "slot", "number", "key", "component", "rank", "class", "kept", "score", "id", "label"):
        frame = frame.selectExpr("*", f"concat('{name}', doc_id) AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
