"""Duplicates hidden by formatting: commutative multiset hashing of normalized fields.

A field's text is cut into tokens: runs of digits, and words in lower case in which letters
set apart only by dots, apostrophes or the spaces of an initialism are one word ("R. G.",
"R.G." and "RG"). Each (field name, token) pair is hashed and the hashes are added up: white
space, case, punctuation and the order of the parts do not change the sum, so nothing has to
be sorted. Records of equal fingerprints are verified field by field, by the number of times
each token occurs. A field that holds neither letters nor digits but is not blank is present
and has no tokens: it equals any other such field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.session import materialize, spread

#: Bits kept of a token's hash: sums of 2**22 tokens stay inside 63 bits.
_MASK = (1 << 41) - 1

#: Letters one by one with dots, apostrophes or spaces between them, as in "R. G. A. C.".
_INITIALS = r"(?<![\p{L}\p{M}])(\p{L})[.'’`´]?[ ]?[.'’`´]?(?=\p{L}(?![\p{L}\p{M}]))"


#: A class with at least one in HOT_SHARE of all rows is spread over SALTS tasks; at most
#: HOT_SHARE classes can be that large.
HOT_SHARE, SALTS = 64, 32


def present(x: Column) -> Column:
    """Neither null nor blank, white space of any kind."""
    return F.coalesce(~F.rlike(x, F.lit(r"(?U)^\s*$")), F.lit(False))


def tokens(text: Column) -> Column:
    """Tokens of a field; none for a text without letters and digits, null for null."""
    x = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    x = F.regexp_replace(x, _INITIALS, "$1")
    return F.regexp_extract_all(x, F.lit(r"(\p{N}+|[\p{L}\p{M}]+)"), F.lit(1))


def multiset_hash(fields: dict[str, Column], seed: int) -> Column:
    """Sum over the (field name, token) pairs of all fields."""

    def of_field(name: str, words: Column) -> Column:
        return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + F.xxhash64(F.lit(seed), F.lit(name), w).bitwiseAND(F.lit(_MASK)))

    total = F.lit(0).cast("bigint")
    for name, words in fields.items():
        total = total + of_field(name, words)
    return total


def fingerprints(cards: DataFrame) -> DataFrame:
    """scheda_id, corte, numero, date, the token arrays tc, tn and the fingerprint h1, h2 over
    court, number and date of the cards that have all three; the others have no counterpart."""
    whole = F.col("date").isNotNull() & present(F.col("corte")) & present(F.col("numero"))
    cards = spread(cards.select("scheda_id", "date", "corte", "numero").where(whole))
    cards = cards.withColumns({"tc": tokens(F.col("corte")), "tn": tokens(F.col("numero"))})
    fields = {"corte": F.col("tc"), "numero": F.col("tn"), "date": F.array(F.col("date").cast("string"))}
    return cards.withColumns({"h1": multiset_hash(fields, 1), "h2": multiset_hash(fields, 2)})


def same_tokens(x: Column, y: Column) -> Column:
    """Equality of two multisets without sorting: as many tokens, each as often in either."""
    times = lambda of, t: F.size(F.filter(of, lambda u: u == t))
    return (x == y) | ((F.size(x) == F.size(y)) & F.forall(x, lambda t: times(x, t) == times(y, t)))


def same_fields(a: str, b: str) -> Column:
    """Whether two rows agree in court, number and date."""
    ok = F.col(f"{a}.date") == F.col(f"{b}.date")
    for t in ("tc", "tn"):
        ok = ok & same_tokens(F.col(f"{a}.{t}"), F.col(f"{b}.{t}"))
    return ok


def formatting_pairs(cards: DataFrame) -> DataFrame:
    """scheda_a < scheda_b of every two cards that differ in formatting only.

    Rows without court, number or date (null or blank) are in no pair; repeated rows (one
    scheda_id) are not paired with themselves; an empty table gives no row. Cards without a
    counterpart leave before the join; the rows of very large classes are spread over SALTS
    tasks, each of which meets the whole class."""
    f = materialize(fingerprints(cards).select("scheda_id", "date", "tc", "tn", "h1", "h2"), "impronte")
    classes = f.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = f.count()
    hot = [(r.h1, r.h2) for r in classes.where(F.col("n") * HOT_SHARE >= rows).select("h1", "h2").collect()]
    is_hot = F.lit(False)
    for h1, h2 in hot:
        is_hot = is_hot | ((F.col("h1") == h1) & (F.col("h2") == h2))
    cold = f.where(~is_hot).join(classes.select("h1", "h2"), ["h1", "h2"], "left_semi").withColumn("s", F.lit(0))
    left = right = cold
    if hot:
        large = f.where(is_hot)
        left = cold.unionByName(large.withColumn("s", F.pmod(F.xxhash64("scheda_id"), F.lit(SALTS)).cast("int")))
        right = cold.unionByName(large.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    key = ["h1", "h2", "s"]
    pairs = left.alias("a").join(right.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.scheda_id") < F.col("b.scheda_id")])
    return pairs.where(same_fields("a", "b")).select(F.col("a.scheda_id").alias("scheda_a"), F.col("b.scheda_id").alias("scheda_b")).distinct()


def collapsed(cards: DataFrame) -> DataFrame:
    """One row a card: scheda_id (the smallest of its copies), copie (rows), corte, numero,
    date as that row writes them.

    Rows lacking court, number or date can not be compared: each stays a card of its own with
    one copy. Rows are first counted by their tokens in the order written, combined map-side,
    so that a card with a third of all rows as copies sends one row a partition and order;
    each such form is verified against the first form of its fingerprint, and those that a
    collision of hashes put beside it are counted by their tokens: it merges nothing."""
    first = F.min(F.struct("scheda_id", "corte", "numero")).alias("f")
    forms = materialize(fingerprints(cards).groupBy("h1", "h2", "date", "tc", "tn").agg(first, F.count(F.lit(1)).alias("copie")), "forme")
    model = forms.groupBy("h1", "h2").agg(F.min(F.struct("f", "date", "tc", "tn")).alias("m")).select("h1", "h2", "m.*")
    own = forms.alias("a").join(model.alias("b").hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("h1", "h2")])
    own = own.select("a.*", same_fields("a", "b").alias("uguali"))
    merged = lambda df, *by: df.groupBy("h1", "h2", "date", *by).agg(F.min("f").alias("f"), F.sum("copie").alias("copie"))
    apart = own.where("NOT uguali").withColumns({"tc": F.sort_array("tc"), "tn": F.sort_array("tn")})
    whole = merged(own.where("uguali")).unionByName(merged(apart, "tc", "tn").drop("tc", "tn"))
    whole = whole.select("f.scheda_id", "copie", "f.corte", "f.numero", "date")
    bare = cards.where(~(F.col("date").isNotNull() & present(F.col("corte")) & present(F.col("numero"))))
    return whole.unionByName(bare.select("scheda_id", F.lit(1).cast("bigint").alias("copie"), "corte", "numero", "date"))
