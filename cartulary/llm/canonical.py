"""Freely typed values mapped to a reference list: a partition-based pigeonhole join.

A value is cut into words in small letters without accents; abbreviations stand for their
word, articles, prepositions and words that tell no entries apart are dropped. A word that
the list does not know is corrected by an edit-distance join: within k edits of a list word
cut into k + 1 segments, at least one segment is unchanged and at most k places away, so an
equality join on segments finds every candidate and levenshtein verifies it. A value means
the entry whose set of words is the same: order, letter case, punctuation and remarks do not
matter, another kind, place or section does. All of it is Spark SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.session import materialize

_ACCENTS = ("àáâäèéêëìíîïòóôöùúûü’‘`´", "aaaaeeeeiiiioooouuuu''''")

_DROPPED = "di del dello della dell dei degli delle il lo la gli le l al alla allo ai da dal per e un una"

#: Words by field and what they stand for; an empty text is dropped.
WORDS: dict[str, dict[str, str]] = {
    "corte": dict.fromkeys((_DROPPED + " d sez sezione ordinario ord ufficio spec specializzata previdenza").split(), "")
    | {"trib": "tribunale", "app": "appello", "giud": "giudice", "civ": "civile", "lav": "lavoro", "imm": "immigrazione", "immigraz": "immigrazione", "prot": "protezione", "int": "internazionale", "internaz": "internazionale", "prima": "i", "seconda": "ii", "terza": "iii"},
    "tipo": dict.fromkeys((_DROPPED + " i").split(), "")
    | {"d": "decreto", "decr": "decreto", "ord": "ordinanza", "sent": "sentenza", "caut": "cautelare", "rimess": "rimessione", "interl": "interlocutoria", "fiss": "fissazione", "ud": "udienza", "conv": "convalida", "pror": "proroga", "def": "definitiva", "rinv": "rinvio"}
    | {"verb": "verbale", "concil": "conciliazione", "par": "parere", "cons": "consultivo", "provv": "provvedimento", "pres": "presidenziale", "istr": "istruttoria", "coll": "collegiale", "liq": "liquidazione", "comp": "compensi"},
    "ente": dict.fromkeys((_DROPPED + " d i").split(), "")
    | {"dic": "dicastero", "dir": "direzione", "gen": "generale", "comm": "commissione", "terr": "territoriale", "centr": "centrale", "az": "azienda", "san": "sanitaria", "quest": "questura", "pref": "prefettura", "ag": "agenzia", "oss": "osservatorio"}
    | {"ist": "istituto", "cass": "cassa", "naz": "nazionale", "segr": "segreteria", "aut": "autorita", "cons": "consulta", "isp": "ispettorato", "gab": "gabinetto"},
}

#: What a remark in brackets does not hold in the field corte: a kind of court or a section.
_COURT = r"sez|civ|lav|imm|prot|trib|cort|app|pace|\bi\b|\bii\b"


def plain(value: Column) -> Column:
    """Small letters without accents, one space for white space, initials joined."""
    x = F.regexp_replace(F.translate(F.lower(value), *_ACCENTS), "[\\u0300-\\u036f]", "")
    x = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    x = F.regexp_replace(x, r"\b([a-z])\. ?(?=[a-z]\b)", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"\bcomm\.ne\b", "commissione"), r"\bnaz\.le\b", "nazionale")
    x = F.regexp_replace(x, r"\bcd ?'? ?a\b", "corte appello")
    x = F.regexp_replace(F.regexp_replace(x, r"\bgdp\b", "giudice pace"), r"\bc\. ?(?=app|d')", "corte ")
    x = F.regexp_replace(F.regexp_replace(x, "\\b1 ?[\\^°ªa](?![a-z])", "i "), "\\b2 ?[\\^°ªa](?![a-z])", "ii ")
    return x


def readings(campo: Column, x: Column) -> Column:
    """A plain value as it is, then without its remarks."""
    bracketed = F.regexp_replace(x, r"\([^)]*\)?", " ")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(bracketed, r" [-–—] .*$", ""), r"\b(?:n|nr|num)\b[.°º]? ?\d.*$", ""), r"\b(?:reclamo|ricorso)? ?(?:ex )?art\..*$", "")
    court = F.regexp_replace(x, rf"\((?![^)]*(?:{_COURT}))[^)]*\)", " ")
    other = F.when(campo == "tipo", kind).when(campo == "ente", bracketed).otherwise(court)
    return F.array_distinct(F.array(x, other))


def _words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("([a-z0-9]+)"), F.lit(1))


def edits(word: Column) -> Column:
    """Edits allowed within a list word, by its length."""
    n = F.length(word)
    return F.when(n >= 7, 3).when(n >= 5, 2).when(n == 4, 1).otherwise(0)


def corrected(words: DataFrame, known: DataFrame) -> DataFrame:
    """campo, w, canoni array<string>: what the list words nearest to each of ``words`` (campo,
    w) within the edits allowed stand for, all of equal distance. ``known``: campo, r, canon.
    Words without one are left out."""
    k = F.col("k")
    cut = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((F.floor(F.length("r") * i / (k + 1))).cast("int").alias("at"), (F.floor(F.length("r") * (i + 1) / (k + 1)) - F.floor(F.length("r") * i / (k + 1))).cast("int").alias("len")))
    segments = known.withColumn("k", edits(F.col("r"))).where("k > 0").withColumn("cut", F.explode(cut))
    segments = segments.select("campo", "r", "canon", "k", F.col("cut.at").alias("at"), F.expr("substring(r, cut.at + 1, cut.len)").alias("seg"))
    sizes = F.expr("sequence(1, least(6, length(w)))")
    parts = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(0), F.length("w") - n), lambda s: F.struct(s.cast("int").alias("s"), F.substring(F.col("w"), s + 1, n).alias("seg")))))
    longest = known.agg(F.max(F.length("r"))).first()[0] or 0  # a longer word is near none
    probes = words.where(F.length("w").between(3, longest + 3)).select("campo", "w", F.explode(parts).alias("p")).select("campo", "w", "p.s", "p.seg")
    near = (F.abs(F.col("s") - F.col("at")) <= k) & (F.abs(F.length("w") - F.length("r")) <= k)
    pairs = probes.join(segments, ["campo", "seg"]).where(near).select("campo", "w", "r", "canon", "k").distinct()
    # a third edit counts only where two of the three are letters that changed places
    letters = lambda x, y: F.size(F.array_except(F.split(x, ""), F.split(y, "")))
    pairs = pairs.withColumn("d", F.levenshtein("w", "r")).where((F.col("d") <= F.col("k")) & ((F.col("d") < 3) | (letters("w", "r") + letters("r", "w") <= 2)))
    # two pairs of letters that changed places are four edits, but the same letters
    ordered = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    same = known.where(F.length("r") >= 8).withColumn("lettere", ordered("r")).join(words.withColumn("lettere", ordered("w")), ["campo", "lettere"])
    same = same.withColumn("d", F.levenshtein("w", "r")).where("d = 4").select("campo", "w", "r", "canon", F.lit(4).alias("k"), "d")
    pairs = pairs.select("campo", "w", "r", "canon", "k", "d").unionByName(same.distinct())
    near_by = pairs.groupBy("campo", "w").agg(F.min("d").alias("d"), F.collect_set(F.struct("d", "canon")).alias("all"))
    return near_by.select("campo", "w", F.array_distinct(F.expr("transform(filter(all, a -> a.d = d), a -> a.canon)")).alias("canoni"))


def _listed(voci: DataFrame) -> DataFrame:
    """campo, voce_id, w: the words of every entry's name; an abbreviation's own entry too."""
    names = voci.select("campo", "voce_id", F.lit(0).alias("forma"), F.col("nome").alias("x")).unionByName(voci.where("sigla IS NOT NULL").select("campo", "voce_id", F.lit(1).alias("forma"), F.col("sigla").alias("x")))
    return names.select("campo", "voce_id", "forma", F.explode(_words(plain(F.col("x")))).alias("w"))


def mapped(values: DataFrame, voci: DataFrame) -> DataFrame:
    """campo, valore, voce_id: the entry that each value of ``values`` (campo, valore) means,
    0 if none; repeated values come out once, null and blank ones not at all. Of entries with
    the same words the one with the smallest voce_id is meant."""
    spark = values.sparkSession
    fixed = spark.createDataFrame([(c, w, x) for c, m in WORDS.items() for w, x in m.items()], "campo string, w string, canon string")
    values = values.where(~F.coalesce(F.col("valore"), F.lit("")).rlike(r"(?U)^\s*$")).distinct()
    values = materialize(values.withColumn("x", plain(F.col("valore"))), "valori")
    forms = values.select("campo", "x").distinct().select("campo", "x", F.posexplode(readings(F.col("campo"), F.col("x"))).alias("lettura", "f"))
    tokens = materialize(forms.select("campo", "x", "lettura", F.explode(F.array_distinct(_words(F.col("f")))).alias("w")), "parole")
    listed = _listed(voci).join(F.broadcast(fixed), ["campo", "w"], "left").withColumn("canon", F.coalesce("canon", "w"))
    own = listed.select("campo", "w", "canon").unionByName(fixed).distinct()
    strange = tokens.select("campo", "w").distinct().join(own, ["campo", "w"], "left_anti")
    known = own.where("w NOT RLIKE '[0-9]'").withColumnRenamed("w", "r")
    exact = own.groupBy("campo", "w").agg(F.collect_set("canon").alias("canoni"))
    canon = exact.unionByName(corrected(strange, known))

    def key(words: Column) -> Column:
        return F.concat_ws(" ", F.sort_array(F.array_distinct(words)))

    entries = listed.groupBy("campo", "voce_id", "forma").agg(F.collect_set(F.when(F.col("canon") != "", F.col("canon"))).alias("parti")).where("size(parti) > 0")
    most = entries.agg(F.max(F.size("parti"))).first()[0] or 0
    entries = entries.groupBy("campo", key(F.col("parti")).alias("chiave")).agg(F.min("voce_id").alias("voce_id"))
    # words that stand for nothing fall out; a reading with more words than any entry means none
    parts = tokens.join(canon, ["campo", "w"], "left").withColumn("canoni", F.coalesce("canoni", F.array("w"))).where("NOT array_contains(canoni, '')")
    parts = parts.groupBy("campo", "x", "lettura").agg(F.collect_set("canoni").alias("parti")).where(F.size("parti") <= most)
    every = F.aggregate("parti", F.array(F.array().cast("array<string>")), lambda acc, alts: F.flatten(F.transform(acc, lambda a: F.transform(alts, lambda w: F.concat(a, F.array(w))))))
    keys = parts.select("campo", "x", "lettura", F.explode(F.array_distinct(F.transform(every, key))).alias("chiave"))
    meant = keys.join(entries, ["campo", "chiave"]).groupBy("campo", "x").agg(F.min(F.struct("lettura", "voce_id")).alias("m")).select("campo", "x", "m.voce_id")
    return values.join(meant, ["campo", "x"], "left").select("campo", "valore", F.coalesce("voce_id", F.lit(0)).cast("bigint").alias("voce_id"))


def free_values(tables: dict[str, DataFrame], fields: list[tuple[str, str]], key: str) -> DataFrame:
    """tabella, campo, key, valore: one row a field of a table."""
    parts = [tables[t].select(F.lit(t).alias("tabella"), F.lit(c).alias("campo"), F.col(key), F.col(c).alias("valore")) for t, c in fields]
    return reduce(DataFrame.unionByName, parts)


def found_values(rows: DataFrame, voci: DataFrame, key: str) -> DataFrame:
    """tabella, campo, key, voce_id of every value of ``rows`` that is not blank and not a
    name of its field as the list writes it."""
    rows = rows.select("tabella", "campo", key, "valore")
    names = voci.select("campo", F.col("nome").alias("valore")).distinct()
    free = rows.join(names, ["campo", "valore"], "left_anti")
    return free.join(mapped(free.select("campo", "valore"), voci), ["campo", "valore"]).select("tabella", "campo", key, "voce_id").distinct()
