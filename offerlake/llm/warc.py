"""Web archives: WARC files written and read by Spark, and their capture index merged from sorted runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import scratch, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
INDEX = "run string, url_key string, captured_at string, page_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, position bigint"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes: each 5 hex digits are 4 symbols."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(bits, by).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for bits in groups for by in (15, 10, 5, 0)])


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the top domain down, then the rest, without scheme, ``www`` and fragment."""
    clean = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\.)?|#.*$", "")
    host = F.regexp_extract(clean, r"^([^/?:]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(clean, r"^[^/?:]*", ""))


@dataclass(frozen=True)
class Archives:
    """Pages as WARC 1.0 records in gzip files, equal payloads stored once.

    A record's capture time is ``first`` plus its page id in seconds, since the
    pages carry none.  A file holds at most ``records`` records and ``payload``
    bytes of payload; a larger page has a file of its own.
    """

    first: int = 1_767_225_600  #: 2026-01-01T00:00:00Z
    records: int = 4000
    payload: int = 64 << 20

    def plan(self, pages: DataFrame) -> DataFrame:
        """``pages`` (``page_id``, ``url``, ``html``) with payload, digest, record type and the response it refers to.

        Of equal payloads the record with the largest id is the response; null
        html is an empty payload, a null id is smaller than any other, and rows
        that repeat the largest id are all responses.
        """
        html = F.coalesce(F.col("html"), F.lit(""))
        rows = pages.select("page_id", "url", html.alias("html"), payload_digest(html).alias("digest"), F.octet_length(html).cast("bigint").alias("size"))
        last = pages.select("page_id", payload_digest(html).alias("digest")).groupBy("digest").agg(F.max("page_id").alias("response"))
        same = F.col("page_id").eqNullSafe(F.col("response"))
        return rows.join(last, "digest").withColumn("kind", F.when(same, "response").otherwise("revisit"))

    def write(self, pages: DataFrame, path: str) -> None:
        """WARC files under ``path``: Spark's text writer with the record end of WARC as line end.

        Pages are written by size, each class with as many records a file as its
        largest pages allow; a job per class that occurs, about six at most.  Columns
        beyond ``page_id``, ``url`` and ``html`` are left out; an empty table
        gives an empty folder.
        """
        name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
        when = F.date_format(F.timestamp_seconds(F.lit(self.first) + F.coalesce(F.col("page_id"), F.lit(0)) % 2_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        body = F.when(F.col("kind") == "response", F.col("html")).otherwise("")
        lines = [
            F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), "kind"), F.concat(F.lit("WARC-Record-ID: "), name), F.concat(F.lit("WARC-Date: "), when),
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"), F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
            F.when(F.col("kind") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("response").cast("string"), F.lit("")), F.lit(">"))),
            F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        ]
        record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)
        limits = self.size_limits()
        sized = F.lit(0)
        for limit in limits:
            sized = sized + (F.coalesce(F.octet_length("html"), F.lit(0)) > limit).cast("int")
        occurring = sorted(r["c"] for r in pages.select(sized.alias("c")).distinct().collect())  # one number per class
        planned = self.plan(pages)
        for c in occurring or [0]:
            most = max(1, min(self.records, self.payload // limits[c])) if c < len(limits) else 1
            out = planned.filter(sized == c).select(record.alias("value")).write.mode("append")
            out.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)

    def size_limits(self) -> list[int]:
        """Largest payloads of the size classes, eightfold steps up to ``payload``; the class after them is larger still."""
        limits = [max(1, self.payload // self.records)]
        while limits[-1] < self.payload:
            limits.append(min(limits[-1] * 8, self.payload))
        return limits

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Index rows of all archives; each file is one run, sorted by URL key, time and id.

        Records are cut by their ``Content-Length``, so payloads may hold
        anything; a response whose payload does not give its digest is an error.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, content in zip(batch["path"], batch["content"], strict=True):
                    yield _index_of(name, gzip.decompress(content))

        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
        raw = files.mapInPandas(run, "run string, url string, captured_at string, page_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, position bigint")
        order = ["url_key", "captured_at", "page_id", "position"]
        keyed = raw.select("run", url_key(F.col("url")).alias("url_key"), *raw.columns[2:])
        return keyed.sortWithinPartitions("run", *order)

    def histories(self, index: DataFrame) -> DataFrame:
        """Capture histories in global order: range partitions, each merged from its sorted runs by a loser tree.

        Ranges are over (URL key, time, id), so a URL with very many captures
        spans several of them.  A range's part of a run arrives in run order.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            runs: dict[str, list[pd.DataFrame]] = {}
            for batch in batches:
                for name, part in batch.groupby("run", sort=False):
                    runs.setdefault(name, []).append(part)
            tables = [pd.concat(parts, ignore_index=True) for parts in runs.values()]
            keys = [list(zip(t["url_key"], t["captured_at"], t["page_id"].fillna(-(2**63)), t["position"], strict=True)) for t in tables]
            # blocks of a run may arrive in any order; runs themselves are sorted
            tables = [t if k == sorted(k) else t.iloc[sorted(range(len(k)), key=k.__getitem__)] for t, k in zip(tables, keys, strict=True)]
            keys = [sorted(k) for k in keys]
            if tables:
                places, base = [], [0]
                for t in tables:
                    base.append(base[-1] + len(t))
                for at, i in merged(keys):
                    places.append(base[at] + i)
                yield pd.concat(tables, ignore_index=True).iloc[places]

        ranged = index.repartitionByRange("url_key", "captured_at", "page_id")
        return ranged.mapInPandas(run, INDEX)

    def captured(self, pages: DataFrame) -> DataFrame:
        """Write ``pages`` into archives, read them back and merge their index."""
        spark = pages.sparkSession
        path = scratch(spark, "warc")
        self.write(pages, path)
        return self.histories(stored(self.read(spark, path), "index"))


def merged(runs: list[list]) -> Iterator[tuple[int, int]]:
    """``(run, place)`` of all entries of sorted runs in order, by a loser tree.

    Inner nodes keep the loser of their match, so replacing the winner takes one
    comparison per level.  Equal entries come in the order of their runs.
    """
    k = len(runs)
    if not k:
        return
    at = [0] * k
    beats = lambda x, y: y < 0 or (x >= 0 and (at[x] < len(runs[x])) and (at[y] >= len(runs[y]) or (runs[x][at[x]], x) < (runs[y][at[y]], y)))
    losers, winners = [-1] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        x, y = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (x, y) if beats(x, y) else (y, x)
    best = winners[1] if k > 1 else 0
    while at[best] < len(runs[best]):
        yield best, at[best]
        at[best] += 1
        node, now = (best + k) // 2, best
        while node:
            if beats(losers[node], now):
                now, losers[node] = losers[node], now
            node //= 2
        best = now


def _index_of(name: str, content: bytes) -> pd.DataFrame:
    """The index rows of one archive."""
    rows, at = [], 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in content[at:end].decode("utf-8").split("\r\n")[1:])
        body = content[end + 4 : end + 4 + int(head["Content-Length"])]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"{name}: the record at {at} does not match its digest")
        page, first = (head.get(f, "")[len("<urn:page:") : -1] for f in ("WARC-Record-ID", "WARC-Refers-To"))
        rows.append((name, head.get("WARC-Target-URI"), head["WARC-Date"], int(page) if page else None, head["WARC-Type"], digest, int(head["WARC-Payload-Length"]), int(first) if first else None, at))
        at = end + 8 + len(body)
    frame = pd.DataFrame(rows, columns=["run", "url", "captured_at", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "position"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})
