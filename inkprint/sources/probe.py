"""Files are looked at before they are scanned, so that a broken one costs itself and not the job.

Tasks open each file: the footer of a Parquet file, the header of a CSV file, and the whole
stream of a gzip file, which alone tells whether it is complete. The result is a written
table with a row per file; readers scan the sound ones and log the others. A store that
Python can't open leaves its files ``unprobed``: they are scanned, and Spark skips what
it can't read of them.
"""

from __future__ import annotations

import csv
import io
import logging
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.session import materialise

log = logging.getLogger(__name__)

STATUS = "path string, bytes long, kind string, status string, reason string, columns array<string>, types array<string>"
FILES_PER_TASK = 64
CHUNK = 1 << 20
SHOWN = 20  # broken files that are logged by name
_SCHEMA = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("kind", pa.string()), ("status", pa.string()),
                     ("reason", pa.string()), ("columns", pa.list_(pa.string())), ("types", pa.list_(pa.string()))])
# Column types that readers can ask for by name; others are read as text where a file has no types.
TYPES = {"string": "string", "large_string": "string", "int64": "bigint", "int32": "int", "double": "double", "float": "float", "bool": "boolean"}


def kind_of(path: str) -> str:
    """What a file is, by its name; other names are plain files without a check."""
    name = path.rstrip("/").lower()
    return next((k for k in ("parquet", "csv", "gz") if name.endswith(f".{k}")), "plain")


def looked_at(kind: str, stream: pa.NativeFile) -> tuple[list[str], list[str]]:
    """Column names and types of a sound file, where its kind has any; raises on a broken one."""
    if kind == "parquet":
        schema = pq.read_schema(stream)
        return schema.names, [TYPES.get(str(f.type), "other") for f in schema]
    if kind == "csv":
        head = io.TextIOWrapper(io.BytesIO(stream.read(CHUNK)), "utf-8-sig", "replace", newline="")
        names = next(csv.reader(head), [])
        return names, ["string"] * len(names)
    if kind == "gz":
        member, seen = zlib.decompressobj(31), False
        while part := stream.read(CHUNK):
            while part:
                seen = True
                member.decompress(part)
                part = member.unused_data
                if member.eof:
                    member, seen = zlib.decompressobj(31), bool(part)
        if seen:
            raise EOFError("the stream ends inside a member")
    return [], []


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
            row = {"path": path, "bytes": size, "kind": kind_of(path), "status": "ok", "reason": None, "columns": [], "types": []}
            try:
                store, at = fs.FileSystem.from_uri(path)
            except (pa.ArrowException, OSError) as e:
                rows.append(row | {"status": "unprobed", "reason": str(e)[:200]})
                continue
            try:
                with store.open_input_file(at) as stream:
                    row["columns"], row["types"] = looked_at(row["kind"], stream)
            except (pa.ArrowException, OSError, EOFError, zlib.error, csv.Error) as e:
                row |= {"status": "broken", "reason": f"{type(e).__name__}: {e}"[:200]}
            rows.append(row)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths or patterns that name at least one file or folder; others are logged."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        hits = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        if hits is not None and len(hits):
            found.append(path)
        else:
            log.warning("%s skipped: there is no such file", path)
    return found


def probe(spark: SparkSession, paths: list[str] | str, pattern: str | None = None) -> DataFrame:
    """(path, bytes, kind, status, reason, columns, types) of every file under ``paths``, as a written table."""
    known = existing(spark, [paths] if isinstance(paths, str) else paths)
    if not known:
        return spark.createDataFrame([], STATUS)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader if pattern is None else reader.option("pathGlobFilter", pattern)
    listed = materialise(reader.load(known).select("path", F.col("length").alias("bytes")), "files")
    tasks = max(1, min(-(-listed.count() // FILES_PER_TASK), 10_000))
    return materialise(listed.repartition(tasks, "path").mapInArrow(_probed, STATUS), "file-status")


def sound(files: DataFrame, what: str) -> DataFrame:
    """The files that can be scanned; the broken ones are logged."""
    for row in files.where("status = 'broken'").orderBy("path").limit(SHOWN).collect():
        log.warning("%s: %s skipped: %s", what, row["path"], row["reason"])
    return files.where("status <> 'broken'")


def sound_paths(spark: SparkSession, paths: list[str] | str, what: str, pattern: str | None = None) -> list[str]:
    """Names of the files of a source that can be scanned, in order."""
    return [r["path"] for r in sound(probe(spark, paths, pattern), what).orderBy("path").select("path").toLocalIterator()]
