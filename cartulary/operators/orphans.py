"""References to records that do not exist.

References and parent keys are co-partitioned and sorted on the key, then both streams are
merged linearly (sort-merge join); the parents' validity intervals tell apart references
whose parent is missing, deleted or loaded only later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.links import link_key
from cartulary.session import materialize, spread

#: A key with at least one in HOT_SHARE of all references is spread over SALTS partitions;
#: at most HOT_SHARE keys can be that frequent, so the list sent to the driver is bounded.
HOT_SHARE, SALTS = 64, 32

MISSING, DELETED, LATE, UNDATED = "assente", "rimosso", "tardivo", "senza data"


def hot_keys(refs: DataFrame, key: str) -> list:
    """Keys holding at least one in HOT_SHARE of the rows; at most HOT_SHARE of them. The
    counts are combined map-side before anything is shuffled."""
    total = refs.where(F.col(key).isNotNull()).count()
    counts = refs.where(F.col(key).isNotNull()).groupBy(key).count()
    rows = counts.where(F.col("count") * HOT_SHARE >= total).collect() if total else []
    return [r[key] for r in rows]


def merge_join(refs: DataFrame, parents: DataFrame, key: str, spread: Column, hot: list) -> DataFrame:
    """Left sort-merge join of ``refs`` with ``parents`` (one row a key) on ``key``; the rows
    of ``hot`` keys are spread over SALTS sub-keys by ``spread``, their parents repeated."""
    if hot:
        is_hot = F.col(key).isin(hot)
        salted = refs.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        held = parents.withColumn("_salt", F.explode(copies))
        return salted.join(held.hint("merge"), [key, "_salt"], "left").drop("_salt")
    return refs.join(parents.hint("merge"), key, "left")


def valid_at(intervals: Column, t: Column) -> Column:
    """Whether one of the ``struct<da, a>`` intervals holds ``t``: da <= t and (a null or a > t)."""
    return F.coalesce(F.exists(intervals, lambda i: (i["da"] <= t) & (i["a"].isNull() | (i["a"] > t))), F.lit(False))


def begun_at(intervals: Column, t: Column) -> Column:
    return F.coalesce(F.exists(intervals, lambda i: i["da"] <= t), F.lit(False))


def orphan_references(refs: DataFrame, parents: DataFrame, key: str, time: str, spread: Column, levels: list[str]) -> DataFrame:
    """The rows of ``refs`` without a valid parent, with ``stato`` saying why.

    ``refs`` has one row a reference with its ``key`` (null: no reference, left out) and its
    ``time``. ``parents`` has one row a key and, in each column of ``levels``, an array of
    ``struct<da timestamp, a timestamp>`` of which one must hold the time; a null level is
    not asked for. ``stato`` is MISSING without a parent row, LATE if the parent (or a level
    of it) begins only later, DELETED if it was there and is gone, UNDATED if ``time`` is
    null. Repeated rows of ``refs`` stay repeated; empty tables give no row."""
    refs = materialize(refs.where(F.col(key).isNotNull()), "riferimenti")  # read twice: hot keys, join
    t = F.col(time)
    joined = merge_join(refs, parents.withColumn("_there", F.lit(True)), key, spread, hot_keys(refs, key))
    valid, begun = F.lit(True), F.lit(True)
    for level in levels:
        asked = F.col(level).isNotNull()
        valid = valid & (~asked | valid_at(F.col(level), t))
        begun = begun & (~asked | begun_at(F.col(level), t))
    stato = (
        F.when(t.isNull(), UNDATED).when(F.col("_there").isNull(), MISSING)
        .when(valid, F.lit(None)).when(~begun, LATE).otherwise(DELETED)
    )
    return joined.withColumn("stato", stato).where(F.col("stato").isNotNull()).drop("_there", *levels)


def card_references(cards: DataFrame, tabella: str) -> DataFrame:
    """One row an entry of ``norme``: tabella, scheda_id, posizione, caricata_il, chiave
    (``file#anchor``, null where the entry is no reference)."""
    keys = F.transform("norme", lambda n: link_key(n["href"]))  # inside the generator: a filter on it is not pushed below and computed twice
    cards = spread(cards.select("scheda_id", "caricata_il", "norme"))
    return cards.select(F.lit(tabella).alias("tabella"), "scheda_id", "caricata_il", F.posexplode(keys).alias("posizione", "chiave"))


def act_parents(atti: DataFrame, articoli: DataFrame) -> DataFrame:
    """One row a target: chiave (``file#`` of an act, ``file#anchor`` of an article), act,
    art, and the validity intervals ``atto`` and (articles only) ``articolo``.

    Rows without file or without anchor are no targets; an article whose act has no row can
    not be addressed and is none either."""
    span = F.collect_list(F.struct(F.col("caricato_il").alias("da"), F.col("rimosso_il").alias("a")))
    acts = atti.where("file IS NOT NULL AND act IS NOT NULL").groupBy("act", F.lower("file").alias("file")).agg(span.alias("atto"))
    arts = articoli.where("anchor IS NOT NULL").groupBy("act", F.lower("anchor").alias("anchor")).agg(F.min("art").alias("art"), span.alias("articolo"))
    both = arts.join(acts, "act").select(F.concat("file", F.lit("#"), "anchor").alias("chiave"), "act", "art", "atto", "articolo")
    only = acts.select(F.concat("file", F.lit("#")).alias("chiave"), "act", F.lit(None).cast("string").alias("art"), "atto", F.lit(None).cast("array<struct<da:timestamp_ntz,a:timestamp_ntz>>").alias("articolo"))
    return both.unionByName(only)
