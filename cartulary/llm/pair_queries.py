"""Problem 2: topics and cited acts that occur on the same decision card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.functions.links import link_key_sql
from cartulary.llm.pairs import citation_rows, item_pairs, topic_rows
from cartulary.operators.orphans import act_parents
from cartulary.session import materialize, table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "giurisprudenza")
    parents = act_parents(table(spark, sf_dir, "atti"), table(spark, sf_dir, "articoli"))
    rows = topic_rows(cards).unionByName(citation_rows(cards, parents))
    return materialize(rows, "voci")  # read for the counts, the sizes and the pairs


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = item_pairs(_rows(spark, sf_dir), least=8, least_share=1000)
    return pairs.where("CAST(k AS DECIMAL(38,0)) * n >= 4 * CAST(n_a AS DECIMAL(19,0)) * n_b").select("campo", "voce_a", "voce_b")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its count and its ratio to chance."""
    return item_pairs(_rows(spark, sf_dir)).selectExpr("campo", "voce_a", "voce_b", "k", "lift")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}

_ITEMS = f"""
parents AS (
  SELECT lower(file) || '#' AS k, act AS item FROM atti WHERE file IS NOT NULL
  UNION SELECT lower(a.file) || '#' || lower(r.anchor), r.act || '#' || min(r.art) FROM articoli r JOIN atti a USING (act) GROUP BY a.file, r.anchor, r.act),
items AS (
  SELECT DISTINCT 'temi' AS campo, scheda_id, trim(regexp_replace(lower(t), '[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')) AS item
  FROM (SELECT scheda_id, unnest(temi) AS t FROM giurisprudenza) WHERE item <> ''
  UNION ALL
  SELECT DISTINCT 'norme', scheda_id, item FROM (SELECT scheda_id, {link_key_sql('href')} AS k FROM (SELECT scheda_id, unnest(norme).href AS href FROM giurisprudenza)) JOIN parents USING (k)),
sizes AS (SELECT campo, count(DISTINCT scheda_id) AS n FROM items GROUP BY campo),
counts AS (SELECT campo, item, count(*) AS c FROM items GROUP BY ALL),
pairs AS (SELECT a.campo, a.item AS voce_a, b.item AS voce_b, count(*) AS k FROM items a JOIN items b ON a.campo = b.campo AND a.scheda_id = b.scheda_id AND a.item < b.item GROUP BY ALL)"""
_FROM = "FROM pairs p JOIN sizes s USING (campo) JOIN counts x ON x.campo = p.campo AND x.item = voce_a JOIN counts y ON y.campo = p.campo AND y.item = voce_b"

SQL = {
    "p2_found": f"WITH {_ITEMS} SELECT p.campo, voce_a, voce_b {_FROM} WHERE k >= 8 AND k * 1000 >= n AND k * n >= 4 * x.c * y.c",
    "p2_pairs": f"WITH {_ITEMS} SELECT p.campo, voce_a, voce_b, k, CAST(k AS DOUBLE) * n / (CAST(x.c AS DOUBLE) * y.c) AS lift {_FROM}",
}
