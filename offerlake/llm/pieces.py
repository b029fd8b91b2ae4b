"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.llm.common import WordTable, text_slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


@dataclass(frozen=True)
class ChunkedPieces:
    """A SentencePiece model whose pieces never cross into the next white-space mark.

    A chunk is a run of marks and what follows up to the next mark.  Since no
    piece holds a mark after another character, no merge spans two chunks, so
    each distinct chunk is segmented once per task and the ids of a text are
    those of its chunks in order.  The model must put one mark before the text,
    keep white space as it is and normalise nothing; others are refused.  A
    task's table holds at most ``most`` chunks and then starts anew.
    """

    path: str
    most: int = 200_000

    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def refuse_unfit(self) -> None:
        sp = self.processor()
        crossing = next((p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)), None)
        probe = " A  é́ ﬁ "
        if crossing or sp.decode(sp.encode(probe)) != probe:
            raise ValueError(f"pieces cross white-space marks or text is normalised: {crossing!r}")

    def table(self, sp) -> WordTable:
        """Rows ``(ids, ids as text, decoded)`` per chunk, numbered as the chunks come."""

        def describe(chunk: str) -> tuple[list[int], str, str]:
            # the model adds the first mark itself, but not to an empty text
            ids = sp.encode(chunk[1:]) if len(chunk) > 1 else [sp.piece_to_id(MARK)]
            # decoding a chunk alone drops its first mark, which stands for a space
            return ids, ",".join(map(str, ids)), " " + sp.decode(ids)

        return WordTable(describe, self.most)

    @staticmethod
    def chunks(text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def encoded(self, text: Column) -> Column:
        """``array<int>`` ids of a text column; null is an empty text, and an empty text has no ids."""
        self.refuse_unfit()

        @pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = self.table(self.processor())
            for batch in batches:
                out = []
                for value in batch:
                    table.renew()
                    at = table.numbers(self.chunks(value or ""))
                    out.append([i for a in at for i in table.rows[a][0]])
                yield pd.Series(out, dtype=object)

        return run(text)

    def digests(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text.

        Null and empty texts have no ids and decode to the empty text.  Repeated
        rows and null ids pass through; other columns are not read.
        """
        self.refuse_unfit()

        @pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            table = self.table(self.processor())
            for batch in batches:
                texts, out = [x or "" for x in batch], []
                for i, j in text_slices(texts, 1_000_000):
                    table.renew()
                    for text in texts[i:j]:
                        rows = [table.rows[a] for a in table.numbers(self.chunks(text))]
                        ids, decoded = ",".join([r[1] for r in rows]), "".join([r[2] for r in rows])[1:]
                        out.append((sum([len(r[0]) for r in rows]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("d")).select("doc_id", "d.*")
