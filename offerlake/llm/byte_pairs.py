"""Byte-pair encoding and decoding, long unsplit text by tree concatenation."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import RecentTable, stored, text_slices


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary: itself where it is printable Latin-1, else the next character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _loaded(path: str):
    """A file's tokenizer and the bytes of its tokens, once in a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    added = {i: t.content.encode() for i, t in out.get_added_tokens_decoder().items()}
    alphabet = byte_alphabet()
    tokens = {i: t for t, i in out.get_vocab(with_added_tokens=False).items() if i not in added}
    return out, {i: bytes([alphabet[c] for c in t]) if set(t) <= alphabet.keys() else t.encode() for i, t in tokens.items()} | added


@dataclass(frozen=True)
class TreeBytePairs:
    """A byte-level BPE file of the tokenizers library, applied to texts of any length.

    Text is always split before a space that something visible follows, so the
    words between such spaces are encoded once per worker and table of recent
    words, by the library.  A text
    with an unsplit stretch (a word or a run of white space) of ``leaf``
    characters or more is cut up: its ordinary words stay together, a stretch
    is halved until its pieces have at most ``leaf`` bytes.  The pieces of all
    such texts are spread over the tasks and encoded apart; the pieces of one
    text are then joined in pairs, pairs of pairs, and so on.

    A join encodes a window around the border anew, first ``window`` tokens of
    either side.  It ends when the first and the last token of the window come
    out as they were; else the side that differs is doubled.  That is exact: a
    sequence of tokens is the encoding of its bytes if and only if every two
    neighbours are the encoding of theirs, because merges go by rank and, at the
    same rank, from the left.  Neighbours inside the two halves and inside the
    window are good, and those at the ends of the window are neighbours that a
    half had already.

    Files with another pre-tokenizer, a normalizer, dropout, a post-processor or
    added tokens that take white space with them are refused.
    """

    path: str
    leaf: int = 2048
    window: int = 8

    # -- the tokenizer -------------------------------------------------------------------------------------------

    def tokenizer(self):
        return _loaded(self.path)[0]

    def refuse_unfit(self) -> None:
        file = json.loads(self.tokenizer().to_str())
        words = file["pre_tokenizer"] or {}
        fit = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space") and not file["normalizer"] and not file["post_processor"]
        model = file["model"]
        fit = fit and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not fit or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError(f"not a plain byte-level BPE: {self.path}")

    def added_texts(self) -> list[str]:
        return sorted((t.content for t in self.tokenizer().get_added_tokens_decoder().values()), key=len, reverse=True)

    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of every token; an added token stands for its own text."""
        return _loaded(self.path)[1]

    # -- pieces and joins ----------------------------------------------------------------------------------------

    def pieces(self, tokenizer, added: re.Pattern | None, text: str) -> Iterator[tuple[str, bool, bool]]:
        """``(piece, unsplit, joined)``: ordinary text, or byte characters of an unsplit stretch and whether they go on with the piece before."""
        for part in added.split(text) if added else [text]:
            if added and added.fullmatch(part):
                yield part, False, False
                continue
            start = 0
            words = tokenizer.pre_tokenizer.pre_tokenize_str(part) if part else []
            for word, (i, j) in words:
                if len(word) > self.leaf:
                    if i > start:
                        yield part[start:i], False, False
                    start = j
                    size = len(word)
                    while size > self.leaf:
                        size = -(-size // 2)
                    for at in range(0, len(word), size):
                        yield word[at : at + size], True, at > 0
                elif j - start > 16 * self.leaf:
                    yield part[start:j], False, False
                    start = j
            if start < len(part):
                yield part[start:], False, False

    def joined(self, left: list[int], right: list[int], encode: Callable[[list[int]], list[int]]) -> list[int]:
        """The encoding of two neighbouring halves, from those of each; ``encode`` gives the ids of the bytes of a few tokens."""
        a = b = self.window
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            head, tail = left[len(left) - a :], right[:b]
            new = encode(head + tail)
            agree_left, agree_right = a == len(left) or new[0] == head[0], b == len(right) or new[-1] == tail[-1]
            if agree_left and agree_right:
                return left[: len(left) - a] + new + right[b:]
            a, b = a if agree_left else 2 * a, b if agree_right else 2 * b

    def tree(self, halves: list[list[int]], encode: Callable[[list[int]], list[int]]) -> list[int]:
        while len(halves) > 1:
            pairs = [self.joined(x, y, encode) for x, y in zip(halves[::2], halves[1::2], strict=False)]
            halves = pairs + halves[len(halves) // 2 * 2 :]
        return halves[0]

    # -- jobs ----------------------------------------------------------------------------------------------------

    def _words(self, tokenizer, table: dict[int, bytes]) -> RecentTable:
        """Ids and bytes of words: of a text's later ones with the space before them, of a tuple's as they are; None if the space may stay with what is before it."""

        def describe(words: list) -> list:
            texts = [w[0] if isinstance(w, tuple) else " " + w for w in words]
            found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            out = [(np.array(ids, "<u4").tobytes(), b"".join([table[i] for i in ids])) for ids in found]
            return [None if isinstance(w, str) and not visible(w) else o for w, o in zip(words, out, strict=True)]

        return RecentTable(describe)

    def _run(self, docs: DataFrame, columns: str, finish: Callable[[bytes, bytes], tuple]) -> DataFrame:
        """``doc_id`` and ``finish(ids, bytes of their tokens)`` of every row, as ``columns``."""
        self.refuse_unfit()
        source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        kind, names = source.schema["doc_id"].dataType.simpleString(), [c.strip().split()[0] for c in columns.split(",")]
        short = self.leaf // 4  # a character has at most four bytes
        long = re.compile(rf"\S{{{short}}}|\s{{{short}}}")

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokenizer, table, special = self.tokenizer(), self.token_bytes(), self.added_texts()
            added, words = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None, self._words(tokenizer, table)
            for batch in batches:
                texts = list(batch["text"])
                for i, j in text_slices(texts, 1_000_000):
                    rows, split = [], {}
                    for at in range(i, j):
                        text = texts[at]
                        if len(text) >= short and long.search(text):
                            rows += [(at, n, *p, *[None] * len(names)) for n, p in enumerate(self.pieces(tokenizer, added, text))]
                        elif any(s in text for s in special):
                            ids = tokenizer.encode(text, add_special_tokens=False).ids
                            rows.append((at, None, None, None, None, *finish(np.array(ids, "<u4").tobytes(), b"".join([table[n] for n in ids]))))
                        else:
                            head, *rest = text.split(" ")
                            split[at] = [(head,), *rest]
                    words.fill(set().union(*split.values()))
                    odd = {at: whole_words(texts[at]) for at, parts in split.items() if None in [words[w] for w in parts]}
                    split |= odd
                    words.fill(set().union(*split.values()))
                    for at, parts in split.items():
                        found = [words[w] for w in parts]
                        rows.append((at, None, None, None, None, *finish(b"".join([f[0] for f in found]), b"".join([f[1] for f in found]))))
                    out = pd.DataFrame(rows, columns=["at", "part", "piece", "unsplit", "joined", *names], dtype=object)
                    where = out.pop("at").astype(int).to_numpy()
                    yield pd.concat([batch[["row", "doc_id"]].iloc[where].reset_index(drop=True), out], axis=1)

        def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokenizer = self.tokenizer()
            for batch in batches:
                ids = []
                for piece, unsplit in zip(batch["piece"], batch["unsplit"], strict=True):
                    found = [t.id for t in tokenizer.model.tokenize(piece)] if unsplit else tokenizer.encode(piece, add_special_tokens=False).ids
                    ids.append(np.array(found, "<u4").tobytes())
                yield batch[["row", "doc_id", "part", "joined"]].assign(ids=ids)

        def put_together(parts: pd.DataFrame) -> pd.DataFrame:
            tokenizer, table, letters = self.tokenizer(), self.token_bytes(), {b: c for c, b in byte_alphabet().items()}
            encode = lambda ids: [t.id for t in tokenizer.model.tokenize("".join([letters[b] for i in ids for b in table[i]]))]
            parts = parts.sort_values("part")
            stretches: list[list[list[int]]] = []
            for ids, on in zip(parts["ids"], parts["joined"], strict=True):
                found = np.frombuffer(ids, "<u4").tolist()
                if on:
                    stretches[-1].append(found)
                else:
                    stretches.append([found])
            whole = [i for halves in stretches for i in self.tree(halves, encode)]
            done = finish(np.array(whole, "<u4").tobytes(), b"".join([table[i] for i in whole]))
            return pd.DataFrame([(parts["doc_id"].iloc[0], *done)], columns=["doc_id", *names], dtype=object)

        shape = f"row bigint, doc_id {kind}, part int, piece string, unsplit boolean, joined boolean, {columns}"
        begun = stored(source.mapInPandas(first, shape), "byte_pairs")
        pieces = begun.filter("part IS NOT NULL").select("row", "doc_id", "part", "piece", "unsplit", "joined")
        dealt = pieces.repartition("row", "part").mapInPandas(encoded, f"row bigint, doc_id {kind}, part int, joined boolean, ids binary")
        long_texts = dealt.groupBy("row").applyInPandas(put_together, f"doc_id {kind}, {columns}")
        return begun.filter("part IS NULL").select("doc_id", *names).unionByName(long_texts)

    def encoded(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, ids)`` of every whole text.

        Null and empty texts have no ids.  Every row is encoded by itself, so
        repeated rows, equal and null document ids are kept; an empty table gives
        an empty one, and other columns are not read.  A document's ids are held
        by one task, as its text is by one cell.
        """
        return self._run(docs, "ids array<int>", lambda ids, _: (np.frombuffer(ids, "<u4").astype(np.int32),))

    def decoded(self, coded: DataFrame) -> DataFrame:
        """``(doc_id, text)`` from ``(doc_id, ids)``: the bytes of the tokens in order, bytes that are no UTF-8 as the replacement character; null ids give a null text."""
        kind = coded.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = self.token_bytes()
            for batch in batches:
                yield batch[["doc_id"]].assign(text=[None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in batch["ids"]])

        return coded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")

    def digests(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, rows as in :meth:`encoded`; the ids are decoded again for the last."""

        def finish(ids: bytes, tokens: bytes) -> tuple[int, str, str]:
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tokens.decode("utf-8", "replace").encode()).hexdigest()

        return self._run(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", finish)


def visible(word: str) -> bool:
    """Whether a word surely starts with no white space, so that the space before it is its own."""
    return bool(word) and not word[0].isspace() and word[0] not in "\u180e\u200b\u2060\ufeff"


def whole_words(text: str) -> list[tuple[str]]:
    """A text cut before the spaces that something visible follows, and nowhere else."""
    head, *rest = text.split(" ")
    parts, now = [], [head]
    for word in rest:
        if visible(word):
            parts.append(" ".join(now))
            now = ["", word]
        else:
            now.append(word)
    return [(p,) for p in [*parts, " ".join(now)]]
