"""Long exact spans shared between records, by compact windows.

Every character n-gram of GRAM code points is a token with a hash. In the Cartesian tree over
a text's hashes, a node c that spans at least LEAST - GRAM + 1 tokens is a compact window
(left, c, right): all passages of LEAST characters inside it that hold c have c's hash as
their minimum. The tree is built over those wide nodes only: a node that is the nearest
smaller neighbour of a wide node is wide itself, so their extents among each other are their
extents in the whole tree. Two texts that share a passage of LEAST characters hold it in
compact windows of equal minimum; for exact passages one hash is therefore enough, and more
of them would find nothing else.

Windows whose minimum occurs in one text only are dropped; the others are cut out of their
texts and equal windows become one form. Forms of equal minimum are compared letter by letter
while there are few; where a minimum has many forms (a phrase that a great part of the
corpus holds), their runs of LEAST characters are counted by a 128-bit hash instead, which
takes time in proportion to the forms, not to their pairs.

Equal texts are told by their SHA-256 and length; one of them stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.tokens import texts
from cartulary.operators.orphans import hot_keys, merge_join
from cartulary.session import materialize, spread

LEAST, GRAM = 160, 48

#: Forms of one minimum up to which every two are compared.
FEW = 32

#: Code points handled at a time; longer texts are cut into pieces that overlap.
PIECE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 21) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of ``gram`` code points, from prefix sums of a polynomial."""
    n = len(codes)
    size = 1 << max(n, 1).bit_length()
    if size not in _tables:
        _tables[size] = _powers(size)
    up, down = _tables[size]
    c = codes.astype(np.uint64)
    c *= np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    c *= up[:n]
    total = np.cumsum(c, dtype=np.uint64)
    h = total[gram - 1 :].copy()
    h[1:] -= total[: n - gram]
    h *= down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def nearest_smaller(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller element before each, in the same group; -1 without one.
    Every element starts at its neighbour and follows that one's pointer while it is not
    smaller: all between an element and its pointer is greater at any time."""
    at = np.arange(-1, len(x) - 1)
    active = np.arange(len(x))
    while len(active):
        p = at[active]
        inside = p >= 0
        inside[inside] = group[p[inside]] == group[active[inside]]
        at[active[~inside]] = -1
        active, p = active[inside], p[inside]
        over = x[p] > x[active]
        active, p = active[over], p[over]
        at[active] = at[p]
    return at


def compact_windows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, gram: int):
    """(text, position of c, hash, characters before c, characters from c on) of the compact
    windows of the texts codes[starts[i]:ends[i]]; positions count from the array's start. A
    window is cut where no passage of ``least`` characters that holds c reaches further."""
    width = least - gram + 1
    none = np.zeros(0, np.int64)
    long = np.flatnonzero(ends - starts >= least)
    if not len(long):
        return none, none, none, none, none
    h = gram_hashes(codes, gram)
    order = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)  # ties: the first
    smallest = sliding_min(order, width)
    edge = np.zeros(len(codes) + 1, np.int8)
    edge[starts[long]] += 1
    edge[ends[long] - least + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[: len(smallest)]))
    c = (smallest[at] & _POS).astype(np.int64)
    text = np.searchsorted(starts[long], at, "right") - 1
    new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (text[1:] != text[:-1])])
    c, text = c[new], text[new]
    x = order[c]
    parent = nearest_smaller(x, text)
    left = np.where(parent >= 0, c[parent] + 1, starts[long][text])
    parent = len(x) - 1 - nearest_smaller(x[::-1], text[::-1])[::-1]
    right = np.where(parent < len(x), c[np.minimum(parent, len(x) - 1)] - 1, ends[long][text] - gram)
    before, after = np.minimum(c - left, width - 1), np.minimum(right - c, width - 1) + gram
    return long[text], c, h[c].view(np.int64), before, after


def _pieces(batch: list[str | None], least: int):
    """Groups of (row, offset, text) of about PIECE code points; longer texts are cut with an
    overlap of least - 1."""
    group, size = [], 0
    for row, text in enumerate(batch):
        for at in range(0, max(len(text or "") - least + 1, 0), PIECE):
            part = text[at : at + PIECE + least - 1]
            if group and size + len(part) > PIECE + least:
                yield group
                group, size = [], 0
            group.append((row, at, part))
            size += len(part)
    if group:
        yield group


def windows(docs: DataFrame, key: str, text: str, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """h, key, place of the compact windows; place packs position, before, after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for group in _pieces(texts(batch.column(1)), least):
                sizes = np.array([len(t) for _, _, t in group])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                codes = np.frombuffer("".join(t for _, _, t in group).encode("utf-32-le", "surrogatepass"), "<u4")
                i, c, h, before, after = compact_windows(codes, starts, ends, least, gram)
                rows, offset = np.array([r for r, _, _ in group]), np.array([o for _, o, _ in group])
                place = (c - starts[i] + offset[i]) << 24 | before << 12 | after
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[rows[i]]), pa.array(place)], names=["h", key, "place"])

    return spread(docs.select(key, text)).mapInArrow(run, f"h bigint, {key} bigint, place bigint")


_CUT = "h bigint, k bigint, pos bigint, l int, r int, s string, f string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text cut out, with a digest of what a form is made of."""
    for batch in batches:
        for k, t, places in zip(batch.column("k").to_pylist(), texts(batch.column("t")), batch.column("w").to_pylist()):
            for at in range(0, len(places), 4096):
                rows = []
                for w in places[at : at + 4096]:
                    pos, l, r = w["place"] >> 24, w["place"] >> 12 & 4095, w["place"] & 4095
                    s = t[pos - l : pos + r]
                    digest = hashlib.blake2b(f"{w['h']} {l} {r} {s}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                    rows.append((w["h"], k, pos, l, r, s, digest))
                yield pa.RecordBatch.from_pydict({n: pa.array(c, y) for n, y, c in zip(("h", "k", "pos", "l", "r", "s", "f"), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), zip(*rows))})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matching characters before c and from c on, of the aligned texts of two windows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            left = part.column("l").to_numpy()
            width = left + part.column("r").to_numpy()
            ends = np.cumsum(width)
            a, b = (np.frombuffer("".join(texts(part.column(x))).encode("utf-32-le", "surrogatepass"), "<u4") for x in ("sa", "sb"))
            bad = np.flatnonzero(a != b)
            starts = ends - width
            c = starts + left
            k = np.searchsorted(bad, c)  # the first difference at or after c
            before = np.where(k > 0, bad[np.maximum(k, 1) - 1] + 1 if len(bad) else 0, 0)
            after = np.where(k < len(bad), bad[np.minimum(k, len(bad) - 1)] if len(bad) else 0, ends[-1])
            before, after = np.maximum(before, starts), np.minimum(after, ends)
            cols = [part.column(x) for x in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(c - before), pa.array(after - c)], names=["a", "b", "n_l", "n_r"])


def _runs(least: int):
    """Every run of ``least`` characters of a form: two hashes and the characters before c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = (batch.column(c).to_pylist() for c in ("f", "lo", "hi", "l"))
            for f, lo, hi, l, s in zip(*plain, texts(batch.column("s"))):
                if len(s) < least:
                    continue
                codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
                g1 = gram_hashes(codes, least)
                g2 = gram_hashes(codes ^ np.uint32(0x5BD1E995), least)
                n_l = l - np.arange(len(g1))
                n = len(g1)
                yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.string()), pa.array([lo] * n, pa.int64()), pa.array([hi] * n, pa.int64()), pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), pa.array(n_l)], names=["f", "lo", "hi", "g1", "g2", "n_l"])

    return run


def check_least(least: int) -> None:
    """An error for a ``least`` that the windows can not hold."""
    if not 1 <= least < 2048:  # a window's sides are packed into 12 bits each
        raise ValueError(f"least must be from 1 to 2047, not {least}")


def gram_of(least: int) -> int:
    """Characters of a token where none are given: GRAM for LEAST, in proportion for others."""
    check_least(least)
    return max(1, least * GRAM // LEAST)


def classes(docs: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """sha, n (code points), rep (smallest key), copied (whether another key has the text) of
    every class of equal texts of at least ``least`` characters; combined map-side."""
    rows = _long(docs, key, text, least)
    return rows.groupBy("sha", "n").agg(F.min("k").alias("rep"), (F.min("k") < F.max("k")).alias("copied"))


def _long(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    t = F.col(text)
    return docs.where(F.col(key).isNotNull() & (F.length(t) >= least)).select(F.col(key).alias("k"), F.sha2(t, 256).alias("sha"), F.length(t).alias("n"))


def members(docs: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """k, n, rep of every text with a copy: rows of the same key are one text."""
    many = classes(docs, key, text, least).where("copied").withColumn("x", F.concat_ws(" ", "sha", "n")).select("x", "rep")
    own = _long(docs, key, text, least).select("k", "n", F.concat_ws(" ", "sha", "n").alias("x"))
    return merge_join(own, many, "x", F.col("k"), hot_keys(own, "x")).where("rep IS NOT NULL").select("k", "n", "rep")


def shared_windows(docs: DataFrame, key: str, text: str, copies: DataFrame, least: int = LEAST, gram: int | None = None) -> DataFrame:
    """h, k, pos, l, r, s, f of the compact windows, cut out, whose minimum more than one text
    holds; of the texts in ``copies`` only those that stand for their class."""
    check_least(least)
    gram = gram_of(least) if gram is None else gram
    if not 1 <= gram <= least:
        raise ValueError(f"gram must be from 1 to {least}, not {gram}")
    own = docs.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    found = materialize(windows(own, "k", "t", least, gram), "finestre")
    often = found.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("h", F.lit(True).alias("_o"))
    kept = merge_join(found, often, "h", F.struct("k", "place"), hot_keys(found, "h")).where("_o").drop("_o")
    kept = kept.join(copies.where("k <> rep").select("k").distinct(), "k", "left_anti")
    kept = kept.groupBy("k").agg(F.collect_set(F.struct("h", "place")).alias("w"))  # bounded by a text's length
    return materialize(kept.join(own, "k").select("k", "t", "w").mapInArrow(_cut, _CUT), "ritagli")


def matches(cut: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of the forms in ``cut``: f, n_l, n_r: the widest stretch around c (characters before it
    and from it on) that another text or form shares; and the links a < b between forms."""
    forms = cut.groupBy("f").agg(F.first("h").alias("h"), F.first("l").alias("l"), F.first("r").alias("r"), F.first("s").alias("s"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    forms = materialize(forms, "forme")
    sizes = forms.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    forms = merge_join(forms, sizes, "h", F.col("f"), hot_keys(forms, "h"))
    same = forms.where((F.col("lo") < F.col("hi")) & (F.col("l") + F.col("r") >= least)).select("f", F.col("l").cast("bigint").alias("n_l"), F.col("r").cast("bigint").alias("n_r"))
    few = forms.where(F.col("d") <= FEW)
    a, b = few.alias("a"), few.alias("b")
    l, r = F.least("a.l", "b.l"), F.least("a.r", "b.r")
    apart = F.least("a.lo", "b.lo") < F.greatest("a.hi", "b.hi")  # not two places of one text
    two = a.join(b.hint("merge"), (F.col("a.h") == F.col("b.h")) & (F.col("a.f") < F.col("b.f")) & (l + r >= least) & apart)
    aligned = lambda x: F.substring(F.col(f"{x}.s"), F.col(f"{x}.l") - l + 1, l + r)
    two = two.select(F.col("a.f").alias("a"), F.col("b.f").alias("b"), l.cast("bigint").alias("l"), r.cast("bigint").alias("r"), aligned("a").alias("sa"), aligned("b").alias("sb"))
    two = materialize(two.mapInArrow(_verified, "a string, b string, n_l bigint, n_r bigint").where(F.col("n_l") + F.col("n_r") >= least), "coppie")
    runs = materialize(forms.where(F.col("d") > FEW).select("f", "lo", "hi", "l", "s").mapInArrow(_runs(least), "f string, lo bigint, hi bigint, g1 bigint, g2 bigint, n_l bigint"), "tratti")
    runs = runs.withColumn("g", F.concat_ws(" ", "g1", "g2"))
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "f").bitwiseAND(F.lit((1 << 40) - 1)))
    shared = runs.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"), hashed(1).alias("s1"), hashed(2).alias("s2")).where("lo < hi")
    held = merge_join(runs.select("f", "g", "n_l"), shared.select("g", "n", "s1", "s2"), "g", F.col("f"), hot_keys(runs, "g")).where("n IS NOT NULL")
    wide = same.unionByName(two.select(F.col("a").alias("f"), "n_l", "n_r")).unionByName(two.select(F.col("b").alias("f"), "n_l", "n_r"))
    wide = wide.unionByName(held.select("f", "n_l", (F.lit(least) - F.col("n_l")).cast("bigint").alias("n_r")))
    extents = wide.groupBy("f").agg(F.max("n_l").alias("n_l"), F.max("n_r").alias("n_r"))
    # runs that the same forms hold link the same forms: one of them is enough
    one = shared.groupBy("n", "s1", "s2").agg(F.min("g").alias("g")).select("g")
    told = held.join(one, "g", "left_semi").select("g", "f").distinct()
    many = told.alias("a").join(told.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.f") < F.col("b.f"))).select(F.col("a.f").alias("a"), F.col("b.f").alias("b"))
    return extents, two.select("a", "b").unionByName(many).distinct()


def shared_pairs(docs: DataFrame, key: str, text: str, least: int = LEAST, gram: int | None = None) -> DataFrame:
    """doc_a < doc_b of every two rows whose texts share a passage of ``least`` characters.

    Null, empty and shorter texts share nothing; rows of one key are one text and not paired
    with themselves; an empty table gives no row. The result names every pair, as its
    definition asks: its size is that of the groups squared. See ``shared_lengths`` and
    ``members`` for results in proportion to the rows."""
    copies = materialize(members(docs, key, text, least), "copie")
    cut = shared_windows(docs, key, text, copies, least, gram)
    _, links = matches(cut, least)
    holds = cut.select("f", "k").distinct()
    ha, hb = holds.select(F.col("f").alias("a"), F.col("k").alias("x")), holds.select(F.col("f").alias("b"), F.col("k").alias("y"))
    across = links.join(ha, "a").join(hb, "b").select("x", "y")
    wide = cut.where(F.col("l") + F.col("r") >= least).select("f", "k").distinct()
    wx, wy = wide.select("f", F.col("k").alias("x")), wide.select("f", F.col("k").alias("y"))
    within = wx.join(wy, "f").where("x < y").select("x", "y")
    reps = across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    of = lambda n, v: copies.select(F.col("rep").alias(n), F.col("k").alias(v)).distinct()
    spread = reps.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    equal = of("a", "x").join(of("a", "y"), "a").where("x < y").select("x", "y")
    both = spread.unionByName(equal)
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_lengths(docs: DataFrame, key: str, text: str, least: int = LEAST, gram: int | None = None) -> DataFrame:
    """Every row with n_chars and shared: the characters of its text inside passages of at
    least ``least`` characters that occur in another text too, or all of it where another key
    has the same text; 0 for null, empty, short texts and for a null key. In proportion to
    the rows: no pair of texts is formed, and what a window shares with all others is one
    stretch, since all of it holds c."""
    copies = materialize(members(docs, key, text, least), "copie")
    cut = shared_windows(docs, key, text, copies, least, gram)
    extents, _ = matches(cut, least)
    places = cut.select("f", "k", "pos")
    sides = merge_join(places, extents, "f", F.struct("k", "pos"), hot_keys(places, "f")).where("n_l IS NOT NULL")
    sides = sides.groupBy("k", (F.col("pos") - F.col("n_l")).alias("s")).agg(F.max(F.col("pos") + F.col("n_r")).alias("e"))
    w = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("e").over(w), F.lit(0))
    covered = sides.withColumn("c", F.greatest(F.col("e") - F.greatest(F.col("s"), reached), F.lit(0))).groupBy("k").agg(F.sum("c").alias("c"))
    whole = copies.groupBy("k").agg(F.max("n").cast("bigint").alias("c"))
    part = covered.unionByName(whole).groupBy("k").agg(F.max("c").alias("c")).withColumnRenamed("k", "_k")
    rows = docs.select(F.col(key), F.length(text).cast("bigint").alias("n_chars"))
    return rows.join(part, F.col(key) == F.col("_k"), "left").select(key, "n_chars", F.coalesce("c", F.lit(0)).cast("bigint").alias("shared"))


def text_classes(docs: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """key, classe (the smallest key of an equal text), copie (its keys): membership of exact
    copies, one row a key; texts shorter than ``least`` are classes of their own."""
    own = materialize(_long(docs, key, text, least).distinct(), "testi")
    counts = own.groupBy("sha", "n").agg(F.min("k").alias("classe"), F.countDistinct("k").alias("copie"))
    counts = counts.select(F.concat_ws(" ", "sha", "n").alias("x"), "classe", "copie")
    own = own.select("k", F.concat_ws(" ", "sha", "n").alias("x"))
    told = merge_join(own, counts, "x", F.col("k"), hot_keys(own, "x")).select(F.col("k").alias("_k"), "classe", "copie")
    rows = docs.select(F.col(key)).distinct()
    return rows.join(told, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("classe", key).alias("classe"), F.coalesce("copie", F.lit(1)).cast("bigint").alias("copie"))
