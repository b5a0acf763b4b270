"""Problem 5: freely typed courts, kinds and offices and the entries of ``voci`` they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.canonical import _ACCENTS, _COURT, WORDS, found_values, free_values, mapped
from cartulary.session import table

_FIELDS = [("giurisprudenza", "corte"), ("giurisprudenza", "tipo"), ("circolari", "ente")]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return free_values({t: table(spark, sf_dir, t) for t in dict(_FIELDS)}, _FIELDS, "scheda_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_values(_values(spark, sf_dir), table(spark, sf_dir, "voci"), "scheda_id")


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value not written as the list does, with the entry it means (voce_id 0 and no
    name: none) and the number of its rows."""
    voci = table(spark, sf_dir, "voci")
    names = voci.select("campo", F.col("nome").alias("valore")).distinct()
    rows = _values(spark, sf_dir).groupBy("tabella", "campo", "valore").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(names, ["campo", "valore"], "left_anti")
    named = mapped(rows.select("campo", "valore"), voci).join(voci.select("voce_id", "nome"), "voce_id", "left")
    return rows.join(named, ["campo", "valore"]).select("tabella", "campo", "valore", "voce_id", "nome", "n")


QUERIES = {"p5_found": p5_found, "p5_values": p5_values}

_Q = lambda x: "'" + x.replace("'", "''") + "'"
_FIXED = ", ".join(f"({_Q(c)}, {_Q(w)}, {_Q(x)})" for c, m in WORDS.items() for w, x in m.items())
_SPACE = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _re(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {_Q(pattern)}, {_Q(new)}, 'g')"


def _plain(x: str) -> str:
    """The same plain form without lookahead: single letters are marked, then joined."""
    x = _re(f"translate(lower({x}), {_Q(_ACCENTS[0])}, {_Q(_ACCENTS[1])})", "[\\x{0300}-\\x{036f}]", "")
    x = f"trim({_re(x, _SPACE + '+', ' ')})"
    x = _re(_re(_re(x, r"\b([a-z])\b", r"<\1>"), r">\. ?<", ""), "[<>]", "")
    x = _re(_re(x, r"\bcomm\.ne\b", "commissione"), r"\bnaz\.le\b", "nazionale")
    x = _re(_re(x, r"\bcd ?'? ?a\b", "corte appello"), r"\bgdp\b", "giudice pace")
    x = _re(x, r"\bc\. ?(app|d')", r"corte \1")
    return _re(_re(x, r"\b1 ?[\^°ªa]([^a-z]|$)", r"i \1"), r"\b2 ?[\^°ªa]([^a-z]|$)", r"ii \1")


_BRACKETS = _re("x", r"\([^)]*\)?", " ")
_KIND = _re(_re(_re(_BRACKETS, " [-–—] .*$", ""), r"\b(?:n|nr|num)\b[.°º]? ?\d.*$", ""), r"\b(?:reclamo|ricorso)? ?(?:ex )?art\..*$", "")
_COURTS = f"list_reduce(list_prepend(x, list_filter(regexp_extract_all(x, '\\([^)]*\\)'), lambda g: NOT regexp_matches(g, {_Q(_COURT)}))), lambda t, g: replace(t, g, ' '))"

#: The same meaning by other steps: every unknown word against every word of the list.
_MEANT = f"""
rows AS (SELECT 'giurisprudenza' AS tabella, 'corte' AS campo, scheda_id, corte AS valore FROM giurisprudenza UNION ALL SELECT 'giurisprudenza', 'tipo', scheda_id, tipo FROM giurisprudenza UNION ALL SELECT 'circolari', 'ente', scheda_id, ente FROM circolari),
free AS (SELECT * FROM rows WHERE valore IS NOT NULL AND NOT EXISTS (SELECT 1 FROM voci v WHERE v.campo = rows.campo AND v.nome = valore)),
v0 AS (SELECT DISTINCT campo, valore, {_plain('valore')} AS x FROM free WHERE NOT regexp_full_match(valore, '{_SPACE}*')),
forms AS (SELECT campo, x, 0 AS lettura, x AS f FROM v0 UNION SELECT campo, x, 1, CASE campo WHEN 'tipo' THEN {_KIND} WHEN 'ente' THEN {_BRACKETS} ELSE {_COURTS} END FROM v0),
tok AS (SELECT DISTINCT campo, x, lettura, unnest(regexp_extract_all(f, '[a-z0-9]+')) AS w FROM forms),
fixed(campo, w, canon) AS (VALUES {_FIXED}),
listed AS (
  SELECT l.campo, voce_id, forma, w, coalesce(canon, w) AS canon
  FROM (SELECT campo, voce_id, forma, unnest(regexp_extract_all({_plain('y')}, '[a-z0-9]+')) AS w FROM (SELECT campo, voce_id, 0 AS forma, nome AS y FROM voci UNION ALL SELECT campo, voce_id, 1, sigla FROM voci WHERE sigla IS NOT NULL)) l LEFT JOIN fixed USING (campo, w)),
own AS (SELECT campo, w, canon FROM listed UNION SELECT campo, w, canon FROM fixed),
near AS (
  SELECT s.campo, s.w, canon, levenshtein(s.w, r.w) AS d, CASE WHEN length(r.w) >= 7 THEN 3 WHEN length(r.w) >= 5 THEN 2 WHEN length(r.w) = 4 THEN 1 ELSE 0 END AS k,
    length(r.w) >= 8 AND list_sort(string_split(s.w, '')) = list_sort(string_split(r.w, '')) AS stesse,
    (SELECT count(DISTINCT c) FROM unnest(string_split(s.w, '')) t(c) WHERE NOT contains(r.w, c)) + (SELECT count(DISTINCT c) FROM unnest(string_split(r.w, '')) t(c) WHERE NOT contains(s.w, c)) AS altre
  FROM (SELECT DISTINCT campo, w FROM tok ANTI JOIN own USING (campo, w)) s JOIN own r ON r.campo = s.campo AND abs(length(s.w) - length(r.w)) <= 3 AND NOT regexp_matches(r.w, '[0-9]')
  WHERE length(s.w) >= 3 AND levenshtein(s.w, r.w) <= 4),
good AS (SELECT *, min(d) OVER (PARTITION BY campo, w) AS m FROM near WHERE (d <= k AND (d < 3 OR altre <= 2)) OR (d = 4 AND stesse)),
canon AS (SELECT campo, w, list(DISTINCT canon) AS canoni FROM good WHERE d = m GROUP BY ALL UNION ALL SELECT campo, w, list(DISTINCT canon) FROM own GROUP BY ALL),
entries AS (SELECT campo, chiave, min(voce_id) AS voce_id FROM (SELECT campo, voce_id, forma, string_agg(DISTINCT canon, ' ' ORDER BY canon) AS chiave FROM listed WHERE canon <> '' GROUP BY ALL) GROUP BY ALL),
parts AS (SELECT campo, x, lettura, list(DISTINCT coalesce(canoni, [w])) AS parti FROM tok LEFT JOIN canon USING (campo, w) WHERE NOT list_contains(coalesce(canoni, [w]), '') GROUP BY ALL),
keys AS (SELECT campo, x, lettura, unnest(list_reduce(parti, lambda acc, alts: flatten(list_transform(acc, lambda a: list_transform(alts, lambda b: a || ' ' || b))))) AS k FROM parts WHERE len(parti) <= 16),
meant AS (SELECT k.campo, x, arg_min(voce_id, lettura * 1000000000 + voce_id) AS voce_id FROM keys k JOIN entries e ON e.campo = k.campo AND e.chiave = array_to_string(list_sort(list_distinct(string_split(k.k, ' '))), ' ') GROUP BY ALL),
detto AS (SELECT campo, valore, coalesce(voce_id, 0)::BIGINT AS voce_id FROM v0 LEFT JOIN meant USING (campo, x))"""

SQL = {
    "p5_found": f"WITH {_MEANT} SELECT DISTINCT tabella, f.campo, scheda_id, voce_id FROM free f JOIN detto USING (campo, valore)",
    "p5_values": f"WITH {_MEANT} SELECT tabella, f.campo, f.valore, d.voce_id, v.nome, count(*) AS n FROM free f JOIN detto d USING (campo, valore) LEFT JOIN voci v ON v.voce_id = d.voce_id GROUP BY ALL",
}
