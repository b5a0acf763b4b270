"""Items that appear together: pair counts and lift by heavy-light decomposition.

An item is heavy in its field if it holds at least one in HEAVY of all item occurrences of
the field; at most HEAVY items can, so their list has a proven bound. Within each partition

* heavy-heavy pairs are counted in a dense bit matrix (one row of bits an item), by the
  population count of the AND of two rows;
* heavy-light pairs by probing the bit rows at the positions in the light item's list;
* light-light pairs are hash-counted.

A partition sums its counts up and sends one partial count a pair, or a few where its pairs
do not fit in a bounded table; the sums over all of them are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.links import link_key
from cartulary.operators.orphans import hot_keys, merge_join
from cartulary.session import materialize, spread

#: Bound of the number of heavy items a field.
HEAVY = 512

#: Rows of a bit matrix: HEAVY x BLOCK bits are held at a time.
BLOCK = 1 << 15

#: Pairs and names that a partition holds before it sums up and gives away what it has.
PENDING, NAMES = 1 << 22, 1 << 20

_SCHEMA = "campo string, voce_a string, voce_b string, k bigint"


def heavy_heavy(bits: np.ndarray) -> np.ndarray:
    """Upper triangle of the pair counts of a packed bit matrix (items x bytes)."""
    words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)
    out = np.zeros((len(words), len(words)), np.int64)
    for i in range(len(words) - 1):
        out[i, i + 1 :] = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)
    return out


def heavy_light(dense: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Light item codes and, for each, how often every heavy item is in the rows of its list.
    dense: rows x heavy, 0 or 1; rows, codes: the light occurrences."""
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    ends = np.r_[first[1:], len(codes)]
    counts = np.zeros((len(first), dense.shape[1]), np.int64)
    step = 4096  # occurrences probed at a time
    for at in range(0, len(codes), step):
        part = dense[rows[at : at + step]]
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(first, at + len(part), "left")
        starts = np.maximum(first[lo:hi] - at, 0)
        counts[lo:hi] += np.add.reduceat(part, starts, axis=0, dtype=np.int64)
    return codes[first], counts


def light_light(rows: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of codes (smaller first) of the light occurrences, rows ascending: of neighbours,
    of every second, and so on, until no row is that long. An array at a time."""
    shift = 1
    while shift < len(rows):
        same = np.flatnonzero(rows[shift:] == rows[:-shift])
        if not len(same):
            break
        x, y = codes[same], codes[same + shift]
        yield np.minimum(x, y), np.maximum(x, y)
        shift += 1


class Counts:
    """Pair counts of one partition: arrays of (pair, count), summed up when there are many,
    and given away when the sums themselves are. Memory is bounded by PENDING and NAMES."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.pending = 0

    def codes(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in this partition."""
        own = self.names
        return np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words))

    def add(self, a: np.ndarray, b: np.ndarray, k: np.ndarray | None = None) -> None:
        self.keys.append(a << 32 | b)
        self.values.append(np.ones(len(a), np.int64) if k is None else k)
        self.pending += len(a)
        if self.pending > PENDING:
            self.sum_up()

    def sum_up(self) -> None:
        if not self.keys:
            return
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate(self.values))
        self.keys, self.values, self.pending = [keys], [sums], len(keys)

    def full(self) -> bool:
        return self.pending > PENDING // 2 or len(self.names) > NAMES

    def taken(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Names, codes of either side and counts; empties the table."""
        self.sum_up()
        keys, sums = (self.keys[0], self.values[0]) if self.keys else (np.zeros(0, np.int64),) * 2
        names = list(self.names)
        self.__init__()
        return names, keys >> 32, keys & 0xFFFFFFFF, sums


def _partial(heavy: dict[str, list[str]], wanted: dict[str, list[str]] | None):
    """Counter of one partition. heavy, wanted: lists by field; items not wanted are skipped."""

    def out(campo: str, names: list[str], a: np.ndarray, b: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = pa.array(names, pa.string())
        for at in range(0, len(k), BLOCK):
            x, y = words.take(pa.array(a[at : at + BLOCK])), words.take(pa.array(b[at : at + BLOCK]))
            first = pc.less(x, y)  # byte order
            columns = [pa.array([campo] * len(x), pa.string()), pc.if_else(first, x, y), pc.if_else(first, y, x), pa.array(k[at : at + BLOCK], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["campo", "voce_a", "voce_b", "k"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((len(h), len(h)), np.int64) for c, h in heavy.items()}
        counts = {c: Counts() for c in heavy}
        for batch in batches:
            fields = batch.column(0)
            for campo, h in heavy.items():
                own = counts[campo]
                lists = batch.column(1).filter(pc.fill_null(pc.equal(fields, campo), False))
                for at in range(0, len(lists), BLOCK):
                    block = lists.slice(at, BLOCK)
                    rows, items = pc.list_parent_indices(block).to_numpy(), pc.list_flatten(block)
                    if wanted is not None:
                        keep = pc.is_in(items, pa.array(wanted[campo], pa.string()))
                        rows, items = rows[keep.to_numpy(zero_copy_only=False)], items.filter(keep)
                    code = pc.fill_null(pc.index_in(items, pa.array(h, pa.string())), -1).to_numpy()
                    dense = np.zeros((len(block), len(h)), np.uint8)
                    is_heavy = code >= 0
                    dense[rows[is_heavy], code[is_heavy]] = 1
                    sums[campo] += heavy_heavy(np.packbits(dense.T, axis=1))
                    if is_heavy.all():
                        continue
                    words = pc.dictionary_encode(items.filter(pa.array(~is_heavy)))
                    light = own.codes(words.dictionary.to_pylist())
                    codes, rows = words.indices.to_numpy().astype(np.int64), rows[~is_heavy]
                    if len(h):
                        listed, held = heavy_light(dense, rows, codes)
                        i, j = np.nonzero(held)
                        big = own.codes(h)
                        x, y = light[listed[i]], big[j]
                        own.add(np.minimum(x, y), np.maximum(x, y), held[i, j])
                    for x, y in light_light(rows, light[codes]):
                        own.add(x, y)
                    if own.full():
                        own.sum_up()
                        if own.full():
                            yield from out(campo, *own.taken())
        for campo, h in heavy.items():
            yield from out(campo, *counts[campo].taken())
            i, j = np.nonzero(sums[campo])
            yield from out(campo, h, i, j, sums[campo][i, j])

    return counted


def item_pairs(rows: DataFrame, least: int = 1, least_share: int = 0) -> DataFrame:
    """Pairs of items in the same row: campo, voce_a < voce_b (byte order), k rows with both,
    n_a, n_b rows with either, n rows with any item of the field, lift = k * n / (n_a * n_b).

    ``rows``: campo, voci array<string> without repeats; other columns are ignored. Null or
    empty lists count nowhere, null items are none; an empty table gives no row. ``least``
    and ``least_share`` (k * least_share >= n) keep frequent pairs only; an item rarer than
    that is in no such pair and is left out before any pair is counted."""
    rows = rows.select("campo", F.filter("voci", lambda v: v.isNotNull()).alias("voci")).where("campo IS NOT NULL AND size(voci) > 0")
    n = rows.groupBy("campo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("voci")).alias("m"))
    count = rows.select("campo", F.explode("voci").alias("voce")).groupBy("campo", "voce").agg(F.count(F.lit(1)).alias("k"))
    sizes = {r["campo"]: (r["n"], r["m"]) for r in n.collect()}  # one row a field
    is_heavy = F.lit(False)
    often = F.lit(False)
    for campo, (rows_of, occurrences) in sizes.items():
        is_heavy = is_heavy | ((F.col("campo") == campo) & (F.col("k") * HEAVY >= occurrences))
        often = often | ((F.col("campo") == campo) & (F.col("k") >= least) & (F.col("k") * least_share >= rows_of if least_share else F.lit(True)))
    heavy: dict[str, list[str]] = {c: [] for c in sizes}
    for r in count.where(is_heavy & often).select("campo", "voce").collect():  # at most HEAVY a field
        heavy[r["campo"]].append(r["voce"])
    wanted = None
    if least_share:  # k >= n / least_share: at most least_share * items a row of them
        wanted = {c: [] for c in sizes}
        for r in count.where(often).select("campo", "voce").collect():
            wanted[r["campo"]].append(r["voce"])
    of_field = F.lit(None).cast("bigint")
    for campo, (rows_of, _) in sizes.items():
        of_field = F.when(F.col("campo") == campo, F.lit(rows_of).cast("bigint")).otherwise(of_field)
    part = rows.mapInArrow(_partial(heavy, wanted), _SCHEMA)
    pairs = part.groupBy("campo", "voce_a", "voce_b").agg(F.sum("k").alias("k")).where(F.col("k") >= least).withColumn("n", of_field)
    if least_share:
        pairs = pairs.where(F.col("k") * least_share >= F.col("n"))
    pairs = materialize(pairs, "coppie")  # read for the hot items and for the joins
    key = lambda voce: F.concat_ws("\0", "campo", voce)
    for voce, n in (("voce_a", "n_a"), ("voce_b", "n_b")):
        own = count.select(F.concat_ws("\0", "campo", "voce").alias("_v"), F.col("k").alias(n))
        keyed = pairs.withColumn("_v", key(voce))
        pairs = merge_join(keyed, own, "_v", F.struct("voce_a", "voce_b"), hot_keys(keyed, "_v")).drop("_v")
    lift = F.col("k") * F.col("n").cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.select("campo", "voce_a", "voce_b", "k", "n_a", "n_b", "n", lift.alias("lift"))


def topic_rows(cards: DataFrame) -> DataFrame:
    """campo 'temi', voci: trimmed, lower case, any white space as one space, no blanks."""
    clean = F.transform("temi", lambda t: F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " ")))
    return cards.select(F.lit("temi").alias("campo"), F.array_distinct(F.filter(clean, lambda t: t != "")).alias("voci"))


def citation_rows(cards: DataFrame, parents: DataFrame) -> DataFrame:
    """campo 'norme', voci: ``act#art`` or ``act`` of the references whose target has any
    row. parents: chiave, act, art; the references to a very frequent target are spread."""
    keys = F.transform("norme", lambda n: link_key(n["href"]))
    refs = materialize(spread(cards.select("scheda_id", "norme")).select("scheda_id", F.explode(F.array_distinct(keys)).alias("chiave")).where("chiave IS NOT NULL"), "citazioni")
    items = parents.select("chiave", F.concat_ws("#", "act", "art").alias("voce"))
    found = merge_join(refs, items, "chiave", F.col("scheda_id"), hot_keys(refs, "chiave")).where("voce IS NOT NULL")
    return found.groupBy("scheda_id").agg(F.collect_set("voce").alias("voci")).select(F.lit("norme").alias("campo"), "voci")
