"""Tables of a database: read in parts over ranges of a key, written in bounded batches."""

from __future__ import annotations

import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMBEDDED = "org.apache.derby.jdbc.EmbeddedDriver"


def read_table(spark: SparkSession, url: str, name: str, driver: str, key: str, parts: int = 8) -> DataFrame:
    """The table in ``parts`` queries over equal ranges of the numeric ``key``; its bounds are
    asked of the database. Filters and columns are pushed into the queries. Rows of a null
    key come with the first range."""
    options = {"url": url, "driver": driver}
    bounds = spark.read.format("jdbc").options(**options).option("query", f'SELECT min("{key}") AS lo, max("{key}") AS hi FROM {name}').load().first()
    whole = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if bounds[0] is None or bounds[0] == bounds[1]:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1] + 1, numPartitions=parts).load()


def write_table(rows: DataFrame, url: str, name: str, driver: str, batch: int = 10_000, mode: str = "append") -> None:
    """Appends (or with ``mode`` overwrites) the rows, ``batch`` at a time from each task."""
    rows.write.format("jdbc").options(url=url, driver=driver, dbtable=name, batchsize=batch).mode(mode).save()


def embedded(rows: DataFrame, root: str, name: str) -> str:
    """The url, for ``EMBEDDED``, of a database whose table ``name`` holds the rows. An open
    embedded database belongs to one process: tasks write the rows as text below ``root`` (a
    mounted folder that all executors share), the driver's database takes it in, is closed and
    packed, and as an archive can be read by every executor at once."""
    spark, folder = rows.sparkSession, Path(root.removeprefix("file://"))
    if not folder.is_absolute():
        raise ValueError(f"{root} is not a mounted folder")
    field = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    rows.select(F.concat_ws(",", *(field(c) for c in rows.columns))).write.text(f"{root}/righe")
    jvm = spark.sparkContext._jvm
    url, driver = f"jdbc:derby:{folder}/aperta", getattr(jvm.org.apache.derby.jdbc, "EmbeddedDriver")()
    write_table(spark.createDataFrame([], rows.schema), f"{url};create=true", name, EMBEDDED)  # the table, by the driver
    held = driver.connect(url, jvm.java.util.Properties())
    for part in sorted(folder.glob("righe/part-*")):
        if part.stat().st_size:
            call = held.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
            call.setString(1, name.upper())
            call.setString(2, str(part))
            call.execute()
            call.close()
    held.close()
    try:
        driver.connect(f"{url};shutdown=true", jvm.java.util.Properties())
    except Py4JJavaError as closed:
        if closed.java_exception.getSQLState() != "08006":  # how it says that it is closed
            raise
    with zipfile.ZipFile(folder / "chiusa.jar", "w", zipfile.ZIP_STORED) as packed:
        for file in sorted((folder / "aperta").rglob("*")):
            if file.is_file() and file.suffix != ".lck":
                packed.write(file, f"chiusa/{file.relative_to(folder / 'aperta')}")
    return f"jdbc:derby:jar:({folder}/chiusa.jar)chiusa"
