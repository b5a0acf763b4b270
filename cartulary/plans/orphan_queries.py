"""Problem 1: links of cards to acts and articles that are absent, removed or late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.links import link_key_sql
from cartulary.operators.orphans import act_parents, card_references, orphan_references
from cartulary.session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = card_references(table(spark, sf_dir, "giurisprudenza"), "giurisprudenza").unionByName(
        card_references(table(spark, sf_dir, "circolari"), "circolari")
    )
    parents = act_parents(table(spark, sf_dir, "atti"), table(spark, sf_dir, "articoli"))
    return orphan_references(refs, parents, "chiave", "caricata_il", F.struct("scheda_id", "posizione"), ["atto", "articolo"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("tabella", "scheda_id", "posizione").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per card table, month of caricata_il and reason."""
    mese = F.date_format("caricata_il", "yyyy-MM")
    return _orphans(spark, sf_dir).groupBy("tabella", mese.alias("mese"), "stato").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_REFS = f"""
refs AS (
  SELECT tabella, scheda_id, posizione, t, {link_key_sql('href')} AS k FROM (
    SELECT 'giurisprudenza' AS tabella, scheda_id, caricata_il AS t, unnest(norme).href AS href, generate_subscripts(norme, 1) - 1 AS posizione FROM giurisprudenza
    UNION ALL
    SELECT 'circolari', scheda_id, caricata_il, unnest(norme).href, generate_subscripts(norme, 1) - 1 FROM circolari)),
acts AS (SELECT act, lower(file) AS file, caricato_il AS da, rimosso_il AS a FROM atti WHERE file IS NOT NULL),
arts AS (SELECT a.file || '#' || lower(r.anchor) AS k, a.da, a.a, r.caricato_il AS da2, r.rimosso_il AS a2 FROM articoli r JOIN acts a USING (act)),
st AS (
  SELECT refs.tabella, refs.scheda_id, refs.posizione, refs.t,
    (SELECT count(*) FROM acts WHERE acts.file || '#' = refs.k) + (SELECT count(*) FROM arts WHERE arts.k = refs.k) AS n,
    (SELECT coalesce(bool_or(da <= refs.t AND (a IS NULL OR a > refs.t)), false) FROM acts WHERE acts.file || '#' = refs.k)
      OR (SELECT coalesce(bool_or(da <= refs.t AND (a IS NULL OR a > refs.t)) AND bool_or(da2 <= refs.t AND (a2 IS NULL OR a2 > refs.t)), false) FROM arts WHERE arts.k = refs.k) AS valid,
    (SELECT coalesce(bool_or(da <= refs.t), false) FROM acts WHERE acts.file || '#' = refs.k)
      OR (SELECT coalesce(bool_or(da <= refs.t) AND bool_or(da2 <= refs.t), false) FROM arts WHERE arts.k = refs.k) AS begun
  FROM refs WHERE refs.k IS NOT NULL)"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT tabella, scheda_id, CAST(posizione AS INTEGER) AS posizione FROM st WHERE NOT valid",
    "p1_report": f"WITH {_REFS} SELECT tabella, strftime(t, '%Y-%m') AS mese, CASE WHEN n = 0 THEN 'assente' WHEN NOT begun THEN 'tardivo' ELSE 'rimosso' END AS stato, count(*) AS n FROM st WHERE NOT valid GROUP BY ALL",
}
