"""What the training-data operators share: tables, shared scratch space, word lists and labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.session import checkpoint_folder
from offerlake.sources.tables import load

__all__ = ["RecentTable", "WordTable", "checksum", "labelled_texts", "load", "named_rows", "runs_of", "scratch", "stored", "text_slices"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and independent of its executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checksum(key: str | Column) -> Column:
    """CRC-32 of a key as text, as the folds of the labelled rows use it."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: int) -> DataFrame:
    """``(text, label)`` of at most ``most`` labelled documents outside the held-out ``fold``.

    The sample is the rows with the smallest hash of their id, so it depends on
    the data alone.  It has at most ``most`` rows, which bounds the broadcast side.
    """
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    sample = named.filter(fold).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")


def named_rows(df: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the stored table ``ids``: broadcast up to ``most`` ids, else a shuffled semi-join."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, "left_semi")


def text_slices(texts: list, most: int = 2_000_000):
    """Slices of a list of texts (or bytes) with about ``most`` characters each, so that work arrays stay bounded."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def runs_of(counts: np.ndarray) -> np.ndarray:
    """Position of each element in its run, for runs of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class WordTable(dict):
    """Distinct words of a task, numbered as they come; ``describe`` gives each new word its row of numbers.

    The table starts anew when it holds ``most`` words, so a task's memory is
    bounded whatever its vocabulary; results do not depend on it.
    """

    def __init__(self, describe: Callable[[object], object], most: int = 400_000):
        super().__init__()
        self.describe, self.most, self.rows = describe, most, []

    def __missing__(self, word):
        at = self[word] = len(self.rows)
        self.rows.append(self.describe(word))
        return at

    def numbers(self, words: list) -> list[int]:
        return [self[w] for w in words]

    def renew(self) -> bool:
        """Empty the table if it is full; row numbers given before are then void."""
        if len(self.rows) < self.most:
            return False
        self.clear()
        self.rows = []
        return True


class RecentTable(dict):
    """Values of the words that a worker met lately, in two generations of at most ``most`` words each.

    When the young one is full it becomes the old one; words that come up again
    move over, so frequent words are described once and rare ones go.  Words
    longer than ``length`` stay for one filling only, which bounds the memory.
    """

    def __init__(self, describe: Callable[[list], list], most: int = 200_000, length: int = 256):
        super().__init__()
        self.describe, self.most, self.length, self.old, self.brief = describe, most, length, {}, []

    def fill(self, words: set) -> None:
        """Afterwards every one of ``words`` has its value."""
        for w in self.brief:
            self.pop(w, None)
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.old = dict(self)
            self.clear()
            new = list(words)
        known = [w for w in new if w in self.old]
        self.update(zip(known, map(self.old.__getitem__, known), strict=True))
        rest = [w for w in new if w not in self.old]
        self.update(zip(rest, self.describe(rest), strict=True))
        self.brief = [w for w in rest if len(w[0] if isinstance(w, tuple) else w) > self.length]
