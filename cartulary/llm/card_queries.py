"""Problem 3: decision cards that differ in formatting only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.cards import collapsed, formatting_pairs
from cartulary.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_pairs(table(spark, sf_dir, "giurisprudenza"))


def p3_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision card once, with the number of its copies."""
    return collapsed(table(spark, sf_dir, "giurisprudenza"))


QUERIES = {"p3_found": p3_found, "p3_cards": p3_cards}


def _norm(x: str) -> str:
    # RE2 has no lookaround: initials are joined by marking the words of two and more letters
    spaced = f"' ' || regexp_replace(regexp_replace(lower({x}), '[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{3000}}.''’`´]+', ' ', 'g'), '([\\p{{L}}\\p{{M}}]{{2,}}|[^\\p{{L}}\\p{{M}}\\s]+)', ' <\\1> ', 'g') || ' '"
    joined = f"regexp_replace({spaced}, ' ([\\p{{L}}]) ', '\\1', 'g')"
    return f"list_sort(regexp_extract_all({joined}, '\\p{{N}}+|[\\p{{L}}\\p{{M}}]+'))"


_BLANK = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*"

_KEYED = f"""
t AS (
  SELECT scheda_id, date, corte, numero, {_norm('corte')} AS tc, {_norm('numero')} AS tn,
    coalesce(date IS NOT NULL AND NOT regexp_full_match(corte, '{_BLANK}') AND NOT regexp_full_match(numero, '{_BLANK}'), false) AS presente FROM giurisprudenza),
f AS (SELECT * FROM t WHERE presente)"""

SQL = {
    "p3_found": f"WITH {_KEYED} SELECT DISTINCT a.scheda_id AS scheda_a, b.scheda_id AS scheda_b FROM f a JOIN f b ON a.date = b.date AND a.tc = b.tc AND a.tn = b.tn AND a.scheda_id < b.scheda_id",
    "p3_cards": f"WITH {_KEYED} SELECT min(scheda_id) AS scheda_id, count(*) AS copie, arg_min(corte, scheda_id) AS corte, arg_min(numero, scheda_id) AS numero, date FROM f GROUP BY date, tc, tn UNION ALL SELECT scheda_id, 1, corte, numero, date FROM t WHERE NOT presente",
}
