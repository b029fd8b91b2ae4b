"""Token sequences packed by cutting-stock column generation."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import RecentTable, stored, text_slices

# Letters whose class, lower case and composition are the same in every Unicode version; others take the slower way.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ɏ]*").fullmatch
# The units that the tokenizer sees in a lower-cased text; each of them ends its own last token.
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\t-\r a-zß-öø-ɏ0-9]+").findall
_UNIT_END = "</w>"


@dataclass(frozen=True)
class CuttingStock:
    """Documents as tokens in sequences of at most ``capacity``.

    A document is cut into whole sequences and one rest.  Rests fall into length
    classes of ``unit`` tokens.  A linear program over the class histogram finds
    how often each pattern (a multiset of classes that fits a sequence) is used:
    it starts with one pattern per class, and a knapsack dynamic program over
    the dual prices adds the best new pattern until none can save more than
    ``tolerance`` of all sequences.  Pattern counts are rounded down and what is
    left is packed first-fit; documents of a class, in rank order, then take the
    places of the patterns.  The plan has at most ``capacity / unit`` classes, so
    it and its program stay the same size however many documents there are.
    """

    path: str
    capacity: int = 4096
    end: int = 2
    unit: int = 8
    tolerance: float = 5e-4
    steps: int = 4000
    most: int = 100_000

    # -- tokens --------------------------------------------------------------------------------------------------

    def pieces(self, docs: DataFrame, ids: bool = False) -> DataFrame:
        """``(doc_id, start, length, ids_crc32, doc_tokens)``, with ``ids`` also the ids of the piece.

        Tokens never cross the units that a text falls into (letter runs, digits,
        runs of signs), so each distinct unit is encoded once per task and table
        of recent units (two generations of ``most``) and the ids of a text are
        those of its units in order, then the end id.  A text with letters
        beyond extended Latin or with a special token falls into words at white
        space instead.
        """
        capacity, end = self.capacity, np.array([self.end], "<u4").tobytes()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)
            last = np.zeros(tokenizer.get_vocab_size(), bool)
            last[[i for token, i in tokenizer.get_vocab().items() if token.endswith(_UNIT_END)]] = True
            tables = RecentTable(lambda new: _encoded(tokenizer, new), self.most), RecentTable(lambda new: _encoded_units(tokenizer, new, last), self.most)
            for batch in batches:
                texts = [x or "" for x in batch["text"]]
                for i, j in text_slices(texts, 1_000_000):
                    plain = [_PLAIN(t) is not None and "<|" not in t for t in texts[i:j]]
                    parts = [_UNITS(t.lower()) if p else _spaced(t).split(" ") for t, p in zip(texts[i:j], plain, strict=True)]
                    for kind in (False, True):
                        tables[kind].fill(set().union(*(found for found, p in zip(parts, plain, strict=True) if p is kind)))
                    out = []
                    for doc, found, p in zip(batch["doc_id"].iloc[i:j], parts, plain, strict=True):
                        whole = b"".join(map(tables[p].__getitem__, found)) + end
                        for at in range(0, len(whole), 4 * capacity):
                            part = whole[at : at + 4 * capacity]
                            out.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(whole) // 4) + ((np.frombuffer(part, "<u4").astype(np.int32),) if ids else ()))
                    yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids]).astype({"doc_id": batch["doc_id"].dtype})

        source = docs.select("doc_id", "text")
        kind = source.schema["doc_id"].dataType.simpleString()
        return source.mapInPandas(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * ids)

    # -- the plan ------------------------------------------------------------------------------------------------

    def patterns(self, demand: dict[int, int]) -> list[tuple[dict[int, int], int]]:
        """``(class: pieces, times)`` that together hold each class as often as ``demand`` says."""
        sizes = np.array(sorted(c for c, n in demand.items() if n > 0), dtype=np.int64)
        if not len(sizes):
            return []
        room, want = self.capacity // self.unit, np.array([demand[int(c)] for c in sizes], float)
        basis = np.diag((room // sizes).astype(float))
        inverse, amount = np.diag(1 / (room // sizes)), want / (room // sizes)
        for _ in range(self.steps):
            prices = inverse.sum(0)
            value, column = self._knapsack(sizes, prices, room)
            if value <= 1 + self.tolerance:
                break
            change = inverse @ column
            ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
            out = int(ratio.argmin())
            amount = np.maximum(amount - ratio[out] * change, 0)
            amount[out] = ratio[out]
            inverse[out] /= change[out]
            others = np.arange(len(sizes)) != out
            inverse[others] -= np.outer(change[others], inverse[out])
            basis[:, out] = column
        times = np.floor(amount + 1e-6).astype(np.int64)
        left = (want - basis @ times).astype(np.int64)
        while (left < 0).any():  # a rounding error in the amounts
            uses = (basis[left < 0] > 0).any(0)
            times[int(np.where(uses, times, -1).argmax())] -= 1
            left = (want - basis @ times).astype(np.int64)
        plan = [({int(sizes[r]): int(basis[r, p]) for r in np.flatnonzero(basis[:, p])}, int(times[p])) for p in np.flatnonzero(times)]
        free: list[int] = []
        bins: list[dict[int, int]] = []
        for r in range(len(sizes) - 1, -1, -1):
            for _ in range(left[r]):
                at = next((i for i, f in enumerate(free) if f >= sizes[r]), None)
                if at is None:
                    at = len(free)
                    free.append(room)
                    bins.append({})
                free[at] -= sizes[r]
                bins[at][int(sizes[r])] = bins[at].get(int(sizes[r]), 0) + 1
        return plan + [(b, 1) for b in bins]

    @staticmethod
    def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
        """The pattern of the highest price: best value for each room, then the pieces read back."""
        best, taken = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(int(sizes[0]), room + 1):
            fit = np.searchsorted(sizes, c, "right")
            value = best[c - sizes[:fit]] + prices[:fit]
            at = value.argmax()
            if value[at] > best[c - 1] + 1e-12:
                best[c], taken[c] = value[at], at
            else:
                best[c] = best[c - 1]
        column, c = np.zeros(len(sizes)), room
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                column[taken[c]] += 1
                c -= int(sizes[taken[c]])
        return best[room], column

    def places(self, plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
        """Per class the rows ``(first rank, first sequence, pieces per sequence)`` of its patterns."""
        out: dict[int, list] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for pattern, times in plan:
            for size, count in pattern.items():
                out.setdefault(size, []).append((ranks.get(size, 0), sequence, count))
                ranks[size] = ranks.get(size, 0) + count * times
            sequence += times
        return {c: np.array(rows, np.int64) for c, rows in out.items()}

    # -- the jobs ------------------------------------------------------------------------------------------------

    def packed(self, docs: DataFrame) -> DataFrame:
        """Pieces with ``sequence_id`` and ``offset``; one row per piece.

        Null and empty texts are the end id alone.  Repeated rows and null ids
        are packed like others.  An empty table gives an empty result.  Ranks
        are counted per class and salt and then added up, so that a class that
        holds most documents is not ranked in one task.
        """
        unit, rows = self.unit, stored(self.pieces(docs), "pieces")
        size = F.expr(f"CAST((length + {unit - 1}) DIV {unit} AS INT)").alias("class")
        demand = {r["class"]: r["n"] for r in rows.groupBy(size).agg(F.count("*").alias("n")).collect()}  # at most capacity / unit rows
        places = self.places(self.patterns(demand))
        salts = max(1, sum(demand.values()) // 20_000)
        salted = rows.withColumn("class", size).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
        totals = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
        before = totals.select("class", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        inner = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
        ranked = salted.withColumn("rank", F.row_number().over(inner) - 1).join(before, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
        ranked = ranked.drop("salt", "before")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sequence = np.empty(len(batch), np.int64)
                for c, at in batch.groupby("class").indices.items():
                    first, base, count = places[c].T
                    rank = batch["rank"].to_numpy()[at]
                    row = np.searchsorted(first, rank, "right") - 1
                    sequence[at] = base[row] + (rank - first[row]) // count[row]
                batch["sequence_id"] = sequence
                yield batch.drop(columns=["class", "rank"])

        names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + ["sequence_id bigint"]
        placed = ranked.select(*rows.columns, "class", "rank").mapInPandas(place, ", ".join(names))
        order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
        return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))

    def sequences(self, docs: DataFrame) -> DataFrame:
        """``(sequence_id, ids)``: the packed ids themselves, unpadded."""
        placed = self.packed(docs).select("doc_id", "start", "ids_crc32", "sequence_id", "offset")
        pieces = self.pieces(docs, ids=True).join(placed, ["doc_id", "start", "ids_crc32"])
        ordered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        return ordered.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def _spaced(text: str) -> str:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text


def _encoded(tokenizer, words: list[str], group: int = 256) -> list[bytes]:
    """Ids of each word as little-endian bytes; words go through the tokenizer many at a time, with a space between."""
    parts = [words[i : i + group] for i in range(0, len(words), group)]
    out: list[bytes] = []
    for part, found in zip(parts, tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
        ends = np.cumsum([len(w) + 1 for w in part])
        begins = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        cuts = np.searchsorted(begins, ends) * 4
        ids = np.array(found.ids, "<u4").tobytes()
        out += [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
    return out


def _encoded_units(tokenizer, units: list[str], last: np.ndarray, group: int = 512) -> list[bytes]:
    """Ids of each unit; a unit is over where a token is one of ``last``."""
    parts = [units[i : i + group] for i in range(0, len(units), group)]
    out: list[bytes] = []
    for part, found in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
        ids = np.array(found.ids, "<u4")
        whole, cuts = ids.tobytes(), ((np.flatnonzero(last[ids]) + 1) * 4).tolist()
        out += [whole[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        if len(cuts) != len(part):
            raise ValueError("the tokenizer does not end its units with the expected mark")
    return out
