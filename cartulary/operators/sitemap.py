"""The site map: two sources of addresses, filtered, joined, put in order, written as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import text, values
from cartulary.operators.ordering import in_order

#: The format's frame.
OPENING = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
CLOSING = "\n</urlset>\n"


def listed(url: Column, flag: Column, sample: Column) -> Column:
    """pages with an address, not switched off (null is on), not a sample."""
    return F.coalesce(url != "", F.lit(False)) & ~flag.eqNullSafe(F.lit(False)) & ~F.coalesce(sample, F.lit(False))


def entries(url: Column, day: Column, site: str) -> list[Column]:
    """Loc, lastmod."""
    return [F.concat(F.lit(site), url).alias("loc"), values.iso_day(day).alias("lastmod")]


def ordered(rows: DataFrame) -> DataFrame:
    """O2: ``posto`` by the language's order of letters, not of bytes; loc comes back as it was."""
    return in_order(rows, [F.collate("loc", "UNICODE"), F.col("loc"), F.col("lastmod")])


def entry_text(loc: Column, lastmod: Column) -> Column:
    """The lines of one entry."""
    return F.concat(F.lit("  <url>\n    <loc>"), text.xml_escape(loc), F.lit("</loc>\n    <lastmod>"), F.coalesce(lastmod, F.lit("")), F.lit("</lastmod>\n  </url>"))


def lines(rows: DataFrame) -> DataFrame:
    """posto, riga: the document as rows in order, for a sink that writes one after another;
    nothing is gathered in one place."""
    body = ordered(rows).select("posto", entry_text(F.col("loc"), F.col("lastmod")).alias("riga"))
    spark = rows.sparkSession
    frame = spark.createDataFrame([(0, OPENING.rstrip("\n")), (2**31 - 1, CLOSING.strip("\n"))], "posto int, riga string")
    return frame.unionByName(body)


def document(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """K3: one row, xml. The format allows ``most`` entries a document; more are an error
    (split them over several documents)."""
    body = ordered(rows)
    if body.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entries in one document")
    told = F.sort_array(F.collect_list(F.struct("posto", entry_text(F.col("loc"), F.col("lastmod")).alias("riga"))))
    joined = F.array_join(F.transform(told, lambda x: x["riga"]), "\n")
    return body.agg(F.concat(F.lit(OPENING), joined, F.lit(CLOSING)).alias("xml"))
