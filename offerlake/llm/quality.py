"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.llm.common import WordTable, labelled_texts, runs_of, text_slices

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")
STATS = 9


def word_shape(word: str) -> str:
    """Letters as ``X``, ``Xx`` or ``x`` by case, digits as ``0``, other signs as they are, at most 12 signs."""
    letters = lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x"
    return _DIGITS.sub("0", _LETTERS.sub(letters, word[:60]))[:12]


@dataclass(frozen=True)
class PassageAttention:
    """P(good) of a document from the weighted mean of its encoded passages.

    A passage is ``passage`` consecutive words, the last one what is left.  Its
    code is a layer over the mean of its words' embeddings (hashed word and
    hashed shape) and nine statistics: share of capitals, of other signs, of
    digits, of distinct words, of repeats of the word before and of two before,
    word length, passage length, and the share of distinct words in the whole
    text.  Gated attention gives each passage its weight; the score is a
    logistic function of the weighted code.  Trained from document labels alone,
    on at most ``sample`` documents.
    """

    passage: int = 64
    words: int = 4096
    shapes: int = 512
    width: int = 16
    gate: int = 8
    sample: int = 5000
    rounds: int = 12
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-5
    seed: int = 3
    params: dict | None = None

    def describe(self, word: str) -> tuple:
        n = len(word)
        upper = sum(map(str.isupper, word))
        alpha = sum(map(str.isalpha, word))
        digit = sum(map(str.isdigit, word))
        return xxhash.xxh32_intdigest(word.lower()) % self.words, xxhash.xxh32_intdigest(word_shape(word), 1) % self.shapes, n, upper, n - alpha - digit, digit

    def bags(self, texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts end to end, words per passage, passages per text, and the statistics per passage."""
        numbers, lengths = [], []
        for text in texts:
            at = table.numbers(text.split())
            numbers += at
            lengths.append(len(at))
        numbers, lengths = np.array(numbers, dtype=np.int64), np.array(lengths, dtype=np.int64)
        per_text = np.maximum(1, -(-lengths // self.passage))  # an empty text has one empty passage
        place = runs_of(per_text)
        counts = np.clip(np.repeat(lengths, per_text) - place * self.passage, 0, self.passage)
        owner = np.repeat(np.arange(len(counts)), counts)
        info = np.array(table.rows, dtype=np.float64).reshape(-1, 6)[:, 2:]
        sums = np.stack([np.bincount(owner, info[numbers, k], len(counts)) for k in range(4)], 1)
        repeat = np.zeros((len(counts), 2))
        for back in (1, 2):
            if len(numbers) > back:
                same = (numbers[back:] == numbers[:-back]) & (owner[back:] == owner[:-back])
                repeat[:, back - 1] = np.bincount(owner[back:], same, len(counts))
        key = np.sort(owner * len(table.rows) + numbers)
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key // max(len(table.rows), 1))[first].astype(np.int64), minlength=len(counts)) if len(key) else np.zeros(len(counts))
        text_of = np.repeat(np.arange(len(texts)), lengths)
        whole = np.sort(text_of * len(table.rows) + numbers)
        first = np.ones(len(whole), bool)
        first[1:] = whole[1:] != whole[:-1]
        kinds = np.bincount((whole // max(len(table.rows), 1))[first].astype(np.int64), minlength=len(texts)) if len(whole) else np.zeros(len(texts))
        signs, n = np.maximum(sums[:, 0], 1), np.maximum(counts, 1)
        variety = np.repeat(kinds / np.maximum(lengths, 1) ** 0.8, per_text)
        stats = np.stack([sums[:, 1] / signs, sums[:, 2] / signs, sums[:, 3] / signs, distinct / n, repeat[:, 0] / n, repeat[:, 1] / n, sums[:, 0] / n / 10, counts / self.passage, variety], 1)
        return numbers, counts, per_text, stats

    # -- training ------------------------------------------------------------------------------------------------

    def fitted(self, docs: DataFrame, labels: DataFrame, label: str, fold: Column) -> PassageAttention:
        """The model of the labelled documents outside the held-out fold; without any, one that finds every text good."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = WordTable(self.describe)
            for batch in batches:
                out = []
                for text in batch["text"]:
                    table.renew()
                    numbers, counts, _, stats = self.bags([text], table)
                    info = np.array([table.rows[i][:2] for i in numbers], dtype=np.int32).reshape(-1, 2)
                    out.append((info[:, 0].tobytes(), info[:, 1].tobytes(), counts.tobytes(), stats.tobytes()))
                frame = pd.DataFrame(out, columns=["words", "shapes", "counts", "stats"])
                yield pd.concat([batch[["doc_id", "label"]].reset_index(drop=True), frame], axis=1)

        rows = labelled_texts(docs, labels, label, fold, self.sample).mapInPandas(run, "doc_id long, label int, words binary, shapes binary, counts binary, stats binary").collect()
        rows.sort(key=lambda r: (r["doc_id"], bytes(r["words"])))
        read = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        return self.fit(read("words", np.int32), read("shapes", np.int32), read("counts", np.int64), [s.reshape(-1, STATS) for s in read("stats", np.float64)], np.array([r["label"] for r in rows], float))

    def fit(self, words: list, shapes: list, counts: list, stats: list, y: np.ndarray) -> PassageAttention:
        rng, h, g = np.random.default_rng(self.seed), self.width, self.gate
        p = {
            "W": rng.normal(0, 0.1, (self.words, h)), "S": rng.normal(0, 0.3, (self.shapes, h)), "T": rng.normal(0, 0.3, (STATS, h)), "b": np.zeros(h),
            "V": rng.normal(0, 0.3, (h, g)), "U": rng.normal(0, 0.3, (h, g)), "a": rng.normal(0, 0.3, g), "c": rng.normal(0, 0.3, h), "d": np.zeros(1),
        }
        if not len(y):
            p["d"][:] = 10.0
            return replace(self, params={k: v * (k == "d") for k, v in p.items()})
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        p["d"][:] = np.log(share / (1 - share))
        moments, turn = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}, 0
        for _ in range(self.rounds):
            order = rng.permutation(len(y))
            for i in range(0, len(y), self.batch):
                part, turn = order[i : i + self.batch], turn + 1
                cat = lambda x: np.concatenate([x[j] for j in part])  # noqa: E731, B023
                grads = self._gradients(p, cat(words), cat(shapes), cat(counts), np.array([len(counts[j]) for j in part]), cat(stats), y[part])
                for k, x in p.items():
                    m, s = moments[k]
                    grad = grads[k] + self.decay * x
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad * grad - s)
                    x -= self.rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)
        return replace(self, params={k: v.astype(np.float32) for k, v in p.items()})

    @staticmethod
    def _attention(p: dict, mean: np.ndarray, stats: np.ndarray, per_text: np.ndarray) -> tuple:
        code = np.tanh(mean + stats @ p["T"] + p["b"])
        left, right = np.tanh(code @ p["V"]), 1 / (1 + np.exp(-(code @ p["U"])))
        energy = (left * right) @ p["a"]
        starts = np.cumsum(per_text) - per_text
        weight = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), per_text))
        weight /= np.repeat(np.add.reduceat(weight, starts), per_text)
        pooled = np.add.reduceat(weight[:, None] * code, starts)
        return code, left, right, weight, pooled, np.clip(pooled @ p["c"] + p["d"][0], -30, 30)

    def _gradients(self, p: dict, words, shapes, counts, per_text, stats, y) -> dict:
        owner, n = np.repeat(np.arange(len(counts)), counts), np.maximum(counts, 1)[:, None]
        mean = np.zeros((len(counts), self.width))
        filled = np.flatnonzero(counts)
        if len(filled):
            mean[filled] = np.add.reduceat(p["W"][words] + p["S"][shapes], (np.cumsum(counts) - counts)[filled])
        code, left, right, weight, pooled, score = self._attention(p, mean / n, stats, per_text)
        text = np.repeat(np.arange(len(per_text)), per_text)
        gap = (1 / (1 + np.exp(-score)) - y) / len(y)
        to_pooled = gap[:, None] * p["c"]
        to_weight = (to_pooled[text] * code).sum(1)
        to_energy = weight * (to_weight - np.bincount(text, weight * to_weight, len(per_text))[text])
        to_left = to_energy[:, None] * p["a"] * right * (1 - left**2)
        to_right = to_energy[:, None] * p["a"] * left * right * (1 - right)
        to_code = (to_pooled[text] * weight[:, None] + to_left @ p["V"].T + to_right @ p["U"].T) * (1 - code**2)
        per_word = (to_code / n)[owner]
        spread = lambda at, size: np.stack([np.bincount(at, per_word[:, k], size) for k in range(self.width)], 1)
        return {
            "W": spread(words, self.words), "S": spread(shapes, self.shapes), "T": stats.T @ to_code, "b": to_code.sum(0), "V": code.T @ to_left, "U": code.T @ to_right,
            "a": (left * right).T @ to_energy, "c": pooled.T @ gap, "d": np.array([gap.sum()]),
        }

    # -- scoring -------------------------------------------------------------------------------------------------

    def probabilities(self, texts: list[str], table: WordTable) -> np.ndarray:
        numbers, counts, per_text, stats = self.bags(texts, table)
        info = np.array([r[:2] for r in table.rows], dtype=np.int64).reshape(-1, 2)
        codes = self.params["W"][info[:, 0]] + self.params["S"][info[:, 1]]
        mean, filled = np.zeros((len(counts), self.width), np.float32), np.flatnonzero(counts)
        if len(filled):
            mean[filled] = np.add.reduceat(codes[numbers], (np.cumsum(counts) - counts)[filled])
        return 1 / (1 + np.exp(-self._attention(self.params, mean / np.maximum(counts, 1)[:, None], stats, per_text)[-1].astype(np.float64)))

    def score(self, text: Column) -> Column:
        """P(good) of a whole text; a null text is an empty one, which is one passage without words."""
        whole = self

        @pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = WordTable(whole.describe, 100_000)
            for batch in batches:
                texts, out = [x or "" for x in batch], []
                for i, j in text_slices(texts):
                    table.renew()
                    out.append(whole.probabilities(texts[i:j], table))
                yield pd.Series(np.concatenate(out) if out else np.zeros(0))

        return run(F.coalesce(text, F.lit("")))
