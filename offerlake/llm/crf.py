"""A linear-chain conditional random field over word shapes, trained and decoded in numpy batches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WORD = re.compile(r"\S+")
TRIGGER = re.compile(r"[0-9@]|\[at\]|\(at\)")
CUES = {
    **dict.fromkeys(("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"), "phone"),
    **dict.fromkeys(("card", "visa", "mastercard", "karte", "carte", "tarjeta"), "card"),
    **dict.fromkeys(("mail", "email", "e-mail", "contact", "write"), "email"),
    **dict.fromkeys(("ip", "host", "server", "address"), "ip"),
}
_RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"[0-9]+"), lambda m: "d" * min(len(m[0]), 17)))


def shape(word: str) -> str:
    """Letters as one ``a``, digits as up to 17 ``d``, everything else as it is, at most 40 signs (the features of a word)."""
    for pattern, to in _RUNS:
        word = pattern.sub(to, word[:400])
    return word[:40]


def features(words: list[str], size: int) -> list[list[int]]:
    """Hashed features of each word: its shape, parts of it, and the cue word before it."""
    import zlib

    out = []
    for i, w in enumerate(words):
        cue = CUES.get(words[i - 1].strip(":.,;").lower(), "-") if i else "-"
        if not TRIGGER.search(w):
            out.append([0, 1 + ("-", *KINDS).index(cue)])  # a plain word: these two features only
            continue
        s = shape(w).rstrip(".,;:!?")
        digits = sum(c.isdigit() for c in w)
        names = (f"s={s}", f"c={re.sub('d+', 'd', s)}", f"n={min(digits, 20)}", f"f={s[:1]}", f"l={s[-1:]}", f"q={cue}", f"qs={cue}|{re.sub('d+', 'd', s)}", f"at={'@' in w or 'at' in w}", f"dots={s.count('.')}")
        out.append([16 + zlib.crc32(n.encode()) % (size - 16) for n in names])
    return out


@dataclass
class ChainField:
    """Weights per hashed feature and label, and per label pair; label 0 is ``O``."""

    size: int = 4096
    emit: np.ndarray = field(default=None)
    step: np.ndarray = field(default=None)

    def fit(self, rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.1, decay: float = 2e-3) -> ChainField:
        """Maximum likelihood with L2, all rows at once: forward and backward passes run over padded batches."""
        n, k, longest = len(rows), len(LABELS), max(len(w) for w, _ in rows)
        self.emit, self.step = np.zeros((self.size, k)), np.zeros((k, k))
        where, which = [], []
        gold = np.zeros((n, longest), np.int64)
        length = np.array([len(w) for w, _ in rows])
        for i, (words, labels) in enumerate(rows):
            gold[i, : len(labels)] = [LABELS.index(x) for x in labels]
            for t, ids in enumerate(features(words, self.size)):
                where += [i * longest + t] * len(ids)
                which += ids
        where, which = np.array(where), np.array(which)
        held = np.where(np.arange(self.size) < 16, decay / 50, decay)[:, None]  # plain words are common and certain: hardly shrunk
        live = np.arange(longest)[None, :] < length[:, None]
        hot = np.eye(k)[gold] * live[:, :, None]
        gold_steps = np.zeros((k, k))
        np.add.at(gold_steps, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
        moments = [np.zeros_like(x) for x in (self.emit, self.emit, self.step, self.step)]
        for turn in range(1, rounds + 1):
            score = np.zeros((n * longest, k))
            np.add.at(score, where, self.emit[which])
            score = score.reshape(n, longest, k)
            unary, pair = self._marginals(score, live)
            gap = (unary - hot).reshape(-1, k)
            grad = np.zeros_like(self.emit)
            np.add.at(grad, which, gap[where])
            for j, (w, g) in enumerate(((self.emit, grad / n + held * self.emit), (self.step, (pair - gold_steps) / n + 10 * decay * self.step))):
                a, b = moments[2 * j], moments[2 * j + 1]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)
        return self

    def _marginals(self, score: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, longest, k = score.shape
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + self.step[None], 1) + score[:, t]
        last = live.sum(1) - 1
        total = _log_sum(ahead[np.arange(n), last], 1)
        for t in range(longest - 2, -1, -1):
            following = _log_sum(self.step[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], following, 0)
        unary = np.exp(ahead + back - total[:, None, None]) * live[:, :, None]
        pair = np.zeros((k, k))
        for t in range(longest - 1):
            p = np.exp(ahead[:, t, :, None] + self.step[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :] - total[:, None, None])
            pair += (p * live[:, t + 1, None, None]).sum(0)
        return unary, pair

    def plain_words_are_outside(self) -> bool:
        """Whether a plain word is ``O`` on every best path, whatever stands around it.

        Changing its label y to ``O`` gains the margin of its features and loses
        at most the best step into y and the best step out of it, each against ``O``.
        """
        plain = self.emit[0] + self.emit[1 : 2 + len(KINDS)]
        margin = (plain[:, 0, None] - plain[:, 1:]).min(0)
        into, out = (self.step - self.step[:, :1]).max(0)[1:], (self.step - self.step[:1, :]).max(1)[1:]
        return bool((margin > into + out).all())

    def decode(self, sentences: list[list[str]]) -> list[list[int]]:
        """Best label paths (Viterbi), in batches of equally long sentences."""
        out: list = [[] for _ in sentences]
        by_length: dict[int, list[int]] = {}
        for i, words in enumerate(sentences):
            by_length.setdefault(len(words), []).append(i)
        for length, members in by_length.items():
            room = max(1, 200_000 // max(length, 1))
            for j in range(0, len(members) if length else 0, room):
                part = members[j : j + room]
                score = np.array([[self.emit[ids].sum(0) for ids in features(sentences[i], self.size)] for i in part])
                best, back = score[:, 0], np.zeros((len(part), length, len(LABELS)), np.int8)
                for t in range(1, length):
                    options = best[:, :, None] + self.step[None]
                    back[:, t] = options.argmax(1)
                    best = options.max(1) + score[:, t]
                path = np.empty((len(part), length), np.int64)
                path[:, -1] = best.argmax(1)
                for t in range(length - 1, 0, -1):
                    path[:, t - 1] = back[np.arange(len(part)), t, path[:, t]]
                for i, p in zip(part, path.tolist(), strict=True):
                    out[i] = p
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
