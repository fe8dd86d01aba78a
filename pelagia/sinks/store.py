"""Small files beside the data, wherever it lies: through Hadoop's file systems (K1, K4, L1)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file read at a time.
STEP = 8 << 20


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return where, system.getRawFileSystem() if system.getUri().getScheme() == "file" else system  # no checksum files beside local ones


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Other readers see the old file or the whole new one."""
    where, system = _at(spark, path)
    part = where.suffix(f".{uuid.uuid4().hex}.part")
    stream = system.create(part, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if system.getUri().getScheme() == "file":
        if not system.rename(part, where):
            raise OSError(f"{path} can't be written")
        return
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(system.makeQualified(part), system.makeQualified(where), options)


def move_only_file(spark: SparkSession, folder: str, path: str) -> None:
    """The one file of data that Spark wrote into a folder gets a name of its own."""
    where, system = _at(spark, folder)
    (found,) = [f.getPath() for f in system.listStatus(where) if f.getPath().getName().startswith("part-")]
    target, _ = _at(spark, path)
    system.delete(target, False)
    if not system.rename(found, target):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Sorted, and NaN is an error."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n")


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place, in a task: a path of this machine, or a URI as Spark tells it."""
    if ":/" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, name = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    return system.open_input_file(name)


def files_of(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length) of the files below a folder; nothing of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            h = hashlib.sha256()
            with opened(path) as f:
                while part := f.read(STEP):
                    h.update(part)
            found.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "sha"])


def folder_digest(spark: SparkSession, path: str) -> str:
    """V7: SHA-256 over names and contents of a folder's files. Each is read in a task, a few megabytes at a time; the driver sees a name and a digest a file."""
    files = files_of(spark, path)
    rows = files.select("path").repartition(max(1, min(200, files.count()))).mapInArrow(_digests, "path string, sha string").select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha").collect()
    return hashlib.sha256("\n".join(sorted(f"{r.name} {r.sha}" for r in rows)).encode()).hexdigest()
