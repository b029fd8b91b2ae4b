"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.llm.common import WordTable, labelled_texts, runs_of, text_slices

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”„’‘…"


@dataclass(frozen=True)
class FactorizationMachine:
    """P(toxic) of the set of terms of a text: a bias, a weight per term, and a learned weight per pair of terms.

    Pair weights are products of ``rank`` factors per term, so the model sees
    that two terms stand together, and a pair costs nothing unless both of its
    terms have factors.  Terms are lower-cased words without punctuation at
    their ends, and the beginnings of words, hashed into ``buckets``.  Training
    uses at most ``sample`` labelled documents and every term of them: evidence
    sets how far a term may move against its shrinkage, never whether it takes
    part.  ``mass`` is what the terms of an average text count together without
    any evidence of their own; that share lets terms that are neutral alone
    learn in pairs.  ``turns`` is the least number of steps, for small tables.
    ``screen`` leaves out terms below that chi-square; it is off unless asked for.
    """

    buckets: int = 1 << 17
    beginnings: tuple[int, ...] = (4, 5, 6)
    rank: int = 4
    sample: int = 12000
    rounds: int = 40
    screen: float = 0.0
    mass: float = 1.0
    turns: int = 400
    batch: int = 256
    rate: float = 0.03
    shrink: float = 1e-4
    seed: int = 5
    bias: float = 0.0
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None

    def of_word(self, word: str) -> tuple[int, ...]:
        """Buckets of the terms of a word: itself and its beginnings, which inflected forms share."""
        term = word.strip(_EDGES).lower()
        forms = [term, *(f"{term[:n]}-" for n in self.beginnings if len(term) > n)] if term else []
        return tuple(xxhash.xxh32_intdigest(f) % self.buckets for f in forms)

    @staticmethod
    def terms(text: str, table: WordTable) -> np.ndarray:
        """Sorted distinct buckets of a text."""
        found = {b for i in table.numbers(list(set(text.split()))) for b in table.rows[i]}
        return np.array(sorted(found), dtype=np.int32)

    def fitted(self, docs: DataFrame, labels: DataFrame, label: str, fold: Column) -> FactorizationMachine:
        """The model of the labelled documents outside the held-out fold; without any, one that finds nothing toxic."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = WordTable(self.of_word)
            for batch in batches:
                out = []
                for text in batch["text"]:
                    table.renew()
                    out.append(self.terms(text, table).tobytes())
                yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": out})

        rows = labelled_texts(docs, labels, label, fold, self.sample).mapInPandas(run, "doc_id long, label int, terms binary").collect()
        rows.sort(key=lambda r: (r["doc_id"], bytes(r["terms"])))
        y, lengths = np.array([r["label"] for r in rows], float), np.array([len(r["terms"]) // 4 for r in rows], np.int64)
        flat = np.frombuffer(b"".join([r["terms"] for r in rows]), np.int32)
        del rows
        return self._fit(flat, lengths, y)

    def fit(self, sets: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
        flat = np.concatenate([np.asarray(s, np.int32) for s in sets]) if len(sets) else np.zeros(0, np.int32)
        return self._fit(flat, np.array([len(s) for s in sets], np.int64), y)

    def _fit(self, flat: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> FactorizationMachine:
        """Fitted to the terms of all texts in one row of 32-bit numbers, which is the only array as long as the texts together."""
        rng = np.random.default_rng(self.seed)
        empty = np.zeros(self.buckets), np.zeros((self.buckets, self.rank))
        if not len(y):
            return self._with(-10.0, *empty)
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        b = float(np.log(share / (1 - share)))
        # evidence of a term: chi-square of its presence and the label, against somewhat more than the largest that chance gives among so many terms
        ends = np.cumsum(lengths)
        starts = ends - lengths
        held, bad = np.zeros(self.buckets), np.zeros(self.buckets)
        for i in range(0, len(y), 1000):
            part = slice(i, min(i + 1000, len(y)))
            terms = flat[starts[part.start] : ends[part.stop - 1]]
            held += np.bincount(terms, minlength=self.buckets)
            bad += np.bincount(terms, np.repeat(y[part], lengths[part]), self.buckets)
        expected = held * y.mean()
        spread = expected * (1 - y.mean()) * (1 - held / len(y))
        chi = (bad - expected) ** 2 / np.maximum(spread, 1e-9)
        chosen = np.flatnonzero((held > 0) & (chi >= self.screen))
        chance = 2.6 * np.log(max(len(chosen), 2))
        reach = min(1.0, self.mass / max(lengths.mean(), 1)) + chi[chosen] ** 4 / (chi[chosen] ** 4 + chance**4)
        reach = reach[:, None].astype(np.float32)
        number = np.full(self.buckets, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        at = number[flat]
        del flat, held, bad, expected, spread, chi
        if (at < 0).any():
            lengths = np.array([np.count_nonzero(at[i:j] >= 0) for i, j in zip(starts, ends, strict=True)], np.int64)
            starts, at = np.cumsum(lengths) - lengths, at[at >= 0]
        # column 0 holds the weights, the others the factors; reach scales the steps, and shrinkage works on all terms alike
        p = (np.sqrt(reach) * np.pad(rng.normal(0, 0.05, (len(chosen), self.rank)), ((0, 0), (1, 0)))).astype(np.float32)
        moment, size, turn = np.zeros_like(p), np.zeros(2), 0
        for _ in range(max(self.rounds, -(-self.turns // -(-len(y) // self.batch)))):
            order = rng.permutation(len(y))
            for i in range(0, len(y), self.batch):
                part, turn = order[i : i + self.batch], turn + 1
                here = at[np.repeat(starts[part], lengths[part]) + runs_of(lengths[part])]
                row = np.repeat(np.arange(len(part)), lengths[part])
                score, sums = self._scores(here, row, len(part), b, p[:, 0], p[:, 1:])
                gap = (1 / (1 + np.exp(-score)) - y[part]) / len(part)
                b -= self.rate * gap.sum()
                linear = np.bincount(here, gap[row], len(p)).astype(np.float32)
                slope = np.empty_like(p)
                slope[:, 0] = linear
                for f in range(self.rank):
                    slope[:, f + 1] = np.bincount(here, (gap * sums[:, f])[row], len(p))
                slope[:, 1:] -= p[:, 1:] * linear[:, None]
                slope *= reach
                slope += np.float32(self.shrink) * p
                moment += np.float32(0.1) * (slope - moment)
                # one step size for all weights and one for all factors: steps of each term's own size would make all terms equal
                steep = slope**2 / np.maximum(reach, 1e-9)
                size += 0.01 * (np.array([steep[:, 0].max(initial=0), steep[:, 1:].max(initial=0)]) - size)
                step = self.rate / (1 - 0.9**turn) / (np.sqrt(size / (1 - 0.99**turn)) + 1e-6)
                p[:, 0] -= np.float32(step[0]) * moment[:, 0]
                p[:, 1:] -= np.float32(step[1]) * moment[:, 1:]
        empty[0][chosen], empty[1][chosen] = p[:, 0], p[:, 1:]
        return self._with(b, *empty)

    def _with(self, bias: float, weights: np.ndarray, factors: np.ndarray) -> FactorizationMachine:
        from dataclasses import replace

        return replace(self, bias=float(bias), weights=weights.astype(np.float32), factors=factors.astype(np.float32))

    @staticmethod
    def _scores(at: np.ndarray, doc: np.ndarray, n: int, b: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        linear, here = np.bincount(doc, w[at], n), v[at]
        sums = np.stack([np.bincount(doc, here[:, f], n) for f in range(v.shape[1])], 1)
        squares = np.bincount(doc, (here**2).sum(1), n)
        return np.clip(b + linear + 0.5 * ((sums**2).sum(1) - squares), -30, 30), sums

    def probabilities(self, sets: list[np.ndarray]) -> np.ndarray:
        at = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return 1 / (1 + np.exp(-self._scores(at, doc, len(sets), self.bias, self.weights, self.factors)[0]))

    def score(self, text: Column) -> Column:
        """P(toxic) of a whole text; null and empty texts score by the bias alone."""
        whole, live = self, (self.weights != 0) | (self.factors != 0).any(1)

        def known(word: str) -> tuple[int, ...]:
            return tuple(b for b in self.of_word(word) if live[b])  # terms without weight change nothing

        @pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = WordTable(known)
            for batch in batches:
                texts, out = [x or "" for x in batch], []
                for i, j in text_slices(texts):
                    table.renew()
                    out.append(whole.probabilities([whole.terms(t, table) for t in texts[i:j]]))
                yield pd.Series(np.concatenate(out) if out else np.zeros(0))

        return run(F.coalesce(text, F.lit("")))
