"""Files as rows: whole texts and raw bytes, with paths relative to the root."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import paths
from cartulary.sources.sinks import write_into

#: Files and bytes that a reading task hands on at once.
FILES, BYTES = 1000, 8_000_000


def _relative(root: str) -> Column:
    """The path below the root, whatever scheme the scan names it with; escapes resolved."""
    bare = root.split("://", 1)[-1].rstrip("/").removeprefix("file:")
    full = F.coalesce(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), F.col("_metadata.file_path"))
    return F.substr(full, F.instr(full, bare.rstrip("/") + "/") + len(bare) + 1)


def _pattern(spark: SparkSession, glob: str) -> str:
    """The regular expression of a Hadoop glob."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()


def _names(system: fs.FileSystem, base: str, pattern: str, recursive: bool) -> Iterator[str]:
    """Names below ``base`` of the files that match, given as they are found. Hidden ones
    (``.x``, ``_x``) are left out, as Spark's own readers do."""
    fits, folders = re.compile(pattern, re.DOTALL).fullmatch, [""]
    while folders:
        at = folders.pop()
        if isinstance(system, fs.LocalFileSystem):
            entries = ((x.name, x.is_dir()) for x in os.scandir(f"{base}/{at}"))
        else:
            entries = ((x.base_name, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/"))))
        for name, folder in entries:
            if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
                continue
            if folder:
                folders += [f"{at}{name}/"] * recursive
            elif fits(name):
                yield at + name


def _texts(system: fs.FileSystem, base: str, names: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """path, value of the files named, in batches of limited size."""
    found: list[tuple[str, bytes]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary())], names=["path", "value"])

    for name in names:
        with system.open_input_stream(f"{base}/{name}") as file:
            found.append((name, file.read()))
        held += len(found[-1][1])
        if len(found) >= FILES or held >= BYTES:
            yield batch()
            found, held = [], 0
    if found:
        yield batch()


def whole_texts(spark: SparkSession, root: str, glob: str, recursive: bool = True) -> DataFrame:
    """path, value: one row a file below ``root`` whose name matches (S1, S2, S6, S9). A task
    lists them and all read them: the driver holds no names, and many small files are no
    more tasks than there are cores to use."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(root)
    uri, pattern = store.makeQualified(at).toUri().toString(), _pattern(spark, glob)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            some: list[str] = []
            for name in _names(*fs.FileSystem.from_uri(uri), pattern, recursive):
                some.append(name)
                if len(some) >= 10 * FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])
                    some = []
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _texts(*fs.FileSystem.from_uri(uri), (n for b in batches for n in b.column(0).to_pylist()))

    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "path string")
    names = names.repartition(2 * spark.sparkContext.defaultParallelism, "path")
    return names.mapInArrow(read, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


def through_files(rows: DataFrame, root: str, glob: str, path: str = "path", content: str = "content", at_once: int = FILES) -> DataFrame:
    """path, value: every row's text written to a file of its own and read back as
    ``whole_texts`` does. A task has a folder of its own below ``root`` and ``at_once`` files
    in it at a time, removed once they are read: a small file takes a whole block of the
    disk. Rows of the same path follow one another. Rows without path or content give none."""
    pattern = _pattern(rows.sparkSession, glob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)

        def turn(files: dict[str, str]) -> Iterator[pa.RecordBatch]:
            own = f"{base}/{uuid.uuid4().hex}"
            try:
                write_into(system, own, files.items())
                yield from _texts(system, own, _names(system, own, pattern, True))
            finally:
                system.delete_dir(own)

        some: dict[str, str] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name in some or len(some) >= at_once:
                    yield from turn(some)
                    some = {}
                some[name] = text
        if some:
            yield from turn(some)

    ready = rows.select(path, content).where(F.col(path).isNotNull() & F.col(content).isNotNull())
    return ready.mapInArrow(run, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


def raw_files(spark: SparkSession, root: str, glob: str = "*", missing_ok: bool = True) -> DataFrame:
    """path, modified, length, content (S12, S13); files gone since they were listed are left
    out where ``missing_ok``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("ignoreMissingFiles", missing_ok)
    return reader.load(root).select(_relative(root).alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


def pages_outside(files: DataFrame, part: str) -> DataFrame:
    """Files none of whose path parts below the root is ``part``; what the root's own
    path holds does not matter."""
    return files.where(~paths.has_part(F.col("path"), part))


def templates(files: DataFrame, suffixes: list[str], ignored: list[str]) -> DataFrame:
    """Files with one of the suffixes and none of the ignored patterns (``dir/**``, or
    ``*.md`` at the top)."""
    kept = F.lit(False)
    for s in suffixes:
        kept = kept | F.endswith("path", F.lit(s))
    for pattern in ignored:
        if pattern.endswith("/**"):
            kept = kept & ~F.startswith("path", F.lit(pattern[:-2]))
        else:
            kept = kept & ~F.rlike("path", F.lit("^" + r"[^/]*".join(rf"\Q{x}\E" for x in pattern.split("*")) + "$"))
    return files.where(kept)
