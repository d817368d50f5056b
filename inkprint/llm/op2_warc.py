"""Deterministic sharded writer and reader of WARC 1.1 archives.

Records are sorted by (page_id, digest, url). Exact running sums of payload bytes
put the cuts between shards at keys, so the same table gives the same archives
whatever the number of executors or partitions. A shard is written by one task
that streams its records and starts a new file once the compressed size passes
``roll_bytes``. Every record is a gzip member of its own. Headers and digests are
made anew from the payload.

Defined cases: a null payload is empty; a null page_id sorts first, has no id
header and reads back as null, and its record revisits the page with the largest id of
its payload, or is a response where no page of that payload has an id; ids are 64-bit
numbers throughout; a null url is written as ``about:blank``; pages that share the
largest id of their payload are all responses; rows equal in all columns are all written. Other columns of the input are ignored. No rows give no files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import folder, rows_by_python, running_start, stage, table, tag
from inkprint.llm.files import commit, make_folder, place, spread

SHARD_BYTES = 32 << 20
MAX_SHARDS = 20_000
ROLL_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, number int, temp string, file string, records long, file_bytes long, first_id long, last_id long"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url string, record_id string, file string, digest_ok boolean")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, keeper) -> bytes:
    """One WARC record; with ``keeper`` a revisit, whose HTTP head stays but not its payload."""
    digest = _base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            "WARC-Target-URI: " + ("about:blank" if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
            f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if keeper is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(keeper, digest)}", f"X-Refers-To-Page-ID: {keeper}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """The files of one shard, each under a temporary name of its own."""

    def __init__(self, home: str, shard: int, roll_bytes: int):
        self.store, self.home = place(home)
        self.shard, self.roll, self.number, self.out = shard, roll_bytes, 0, None

    def add(self, page_id, data: bytes) -> Iterator[dict]:
        if self.out is None:
            self.temp = f"tmp-{tag()}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.home}/{self.temp}")
            self.records, self.size, self.first = 0, 0, page_id
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.records, self.size, self.last = self.records + 1, self.size + len(packed), page_id
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> dict:
        self.out.close()
        self.out = None
        row = {"shard": self.shard, "number": self.number, "temp": self.temp,
               "file": f"shard-{self.shard:05d}-{self.number:05d}.warc.gz", "records": self.records,
               "file_bytes": self.size, "first_id": self.first, "last_id": self.last}
        self.number += 1
        return row


_ROWS = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("temp", pa.string()), ("file", pa.string()),
                   ("records", pa.int64()), ("file_bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def _writer(home: str, roll_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, now, kept = None, None, None
        for batch in batches:
            rows = []
            for shard, page_id, kind, digest, keeper, url, html in zip(*(batch.column(c).to_pylist() for c in (
                    "shard", "page_id", "kind", "digest", "keeper", "url", "html"))):
                if roller is None or roller.shard != shard:
                    if roller is not None and roller.out is not None:
                        rows.append(roller.close())
                    roller = _Roller(home, shard, roll_bytes)
                if (page_id, digest) != now:
                    now, kept = (page_id, digest), None
                if kind == 0:  # which page the payload of the next records is kept with
                    kept = keeper
                    continue
                rows.extend(roller.add(page_id, record(page_id, url, (html or "").encode(), kept)))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROWS)
        if roller is not None and roller.out is not None:
            yield pa.RecordBatch.from_pylist([roller.close()], _ROWS)

    return work


def write(pages: DataFrame, home: str, *, min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES,
          roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write (page_id, url, html) as archives under ``home``; returns the committed manifest.

    Shards hold about ``shard_bytes`` of payload, more if there would be over
    20,000 of them: their first keys are the only thing sent to all tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    narrow = stage(rows.select(
        "page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"),
        F.octet_length("html").cast("long").alias("bytes")), "warc-keys")
    group = narrow.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL")
    revisits = narrow.join(group, "digest").where("page_id IS NULL OR page_id < keeper").select(
        "page_id", "digest", "keeper").distinct()
    size = max(shard_bytes, -(-(narrow.agg(F.sum("bytes")).first()[0] or 0) // MAX_SHARDS))
    # All rows of one id go to the shard in which the id starts; rows without an id are dealt by digest.
    part = F.when(F.col("page_id").isNull(), F.col("digest")).otherwise("")
    ids = narrow.withColumn("part", part).groupBy("page_id", "part").agg(F.sum("bytes").alias("bytes"))
    starts = running_start(ids, ["page_id", "part"], "bytes", "warc-order")
    cuts = [_key(r["first"]["page_id"], r["first"]["part"]) for r in starts.groupBy(F.floor(F.col("start") / size).alias("shard")).agg(
        F.min(F.struct("page_id", "part")).alias("first")).orderBy("shard").collect()]

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, parts: pa.Array) -> pa.Array:
        return pa.array([max(0, bisect_right(cuts, _key(i, p)) - 1) for i, p in zip(ids.to_pylist(), parts.to_pylist())], pa.int32())

    make_folder(home)
    none = F.lit(None)
    both = rows.select("page_id", F.lit(1).alias("kind"), F.sha1(F.encode("html", "utf-8")).alias("digest"),
                       none.cast("long").alias("keeper"), "url", "html").unionByName(
        revisits.select("page_id", F.lit(0).alias("kind"), "digest", "keeper",
                        none.cast("string").alias("url"), none.cast("string").alias("html")))
    # A task per shard, whatever the shards' numbers hash to.
    dealt = both.withColumn("shard", shard_of("page_id", part)).repartitionById(max(1, len(cuts)), "shard").sortWithinPartitions(
        "shard", "page_id", "digest", "kind", "url")
    return commit(rows_by_python(dealt, _writer(home, roll_bytes), MANIFEST), home, "warc")


def _key(page_id: int | None, part: str) -> tuple:
    """The order of Spark: nulls first."""
    return page_id is not None, page_id or 0, part


def records(stream: io.RawIOBase) -> Iterator[bytes]:
    """The records of an archive: every gzip member holds one."""
    part, left = b"", zlib.decompressobj(31)
    out: list[bytes] = []
    while True:
        if not part:
            part = stream.read(1 << 20)
            if not part:
                return
        out.append(left.decompress(part))
        if left.eof:
            yield b"".join(out)
            part, left, out = left.unused_data, zlib.decompressobj(31), []
        else:
            part = b""


def parse(data: bytes, file: str) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(told["Content-Length"])
    sound = _base32(hashlib.sha1(block).digest()) == fields["WARC-Block-Digest"].removeprefix("sha1:")
    if kind == "response":
        sound = sound and len(payload) == size and _base32(hashlib.sha1(payload).digest()) == digest
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"),
            "url": fields["WARC-Target-URI"], "record_id": fields["WARC-Record-ID"], "file": file, "digest_ok": sound}


def read(manifest: DataFrame, home: str) -> DataFrame:
    """One row per record of the committed files; files are streamed, never held whole."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url",
             "record_id", "file", "digest_ok"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
             pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))

    def work(batches):
        store, at = place(home)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{at}/{file}") as stream:
                    for data in records(stream):
                        rows.append(parse(data, file))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return rows_by_python(spread(manifest.select("file")), work, RECORD)


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of all pages, read back."""
    home = folder(spark, "warc-archives")
    return read(write(table(spark, sf, "pages"), home), home).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


QUERIES = {"op2_warc": op2_warc}
SQL = {"op2_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT
                >> (15 - 5 * (i % 4))::INTEGER) & 31))::INTEGER, 1)), '') AS payload_digest,
        CASE WHEN page_id < keeper OR (page_id IS NULL AND keeper IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id < keeper OR page_id IS NULL THEN keeper END AS refers_to, true AS digest_ok
    FROM q"""}
