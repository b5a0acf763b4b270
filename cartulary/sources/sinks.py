"""Rows as files: one file a row (K1)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_into(system: fs.FileSystem, base: str, files: Iterable[tuple[str, str]], made: set[str] | None = None) -> None:
    """Writes texts to paths below ``base``; a path that leads out of it is an error.
    ``made``: folders that are there already, added to."""
    made = set() if made is None else made
    local = isinstance(system, fs.LocalFileSystem)
    for name, text in files:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} is not below the root")
        at = f"{base}/{name}"
        folder = at.rpartition("/")[0]
        if folder not in made:
            system.create_dir(folder, recursive=True)
            made.add(folder)
        with open(at, "wb", buffering=0) if local else system.open_output_stream(at) as out:
            out.write(text.encode("utf-8", "surrogatepass"))


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Writes each row's text to ``root/path`` and gives their number. Executors write their
    own rows; a task that runs again writes the same files again. Rows without path or
    content write none; a path that leads out of the root is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            write_into(target, base, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), made)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    ready = rows.select(path, content).where(F.col(path).isNotNull() & F.col(content).isNotNull())
    return ready.mapInArrow(run, "n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0
