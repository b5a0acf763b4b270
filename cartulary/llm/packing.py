"""Filling containers of fixed capacity: a grouping genetic algorithm on islands.

The unit of heredity is the container. A crossover injects well-filled containers of one
parent into the other, removes the containers that hold any of the same items, empties the
worst filled, and puts the displaced items back: first where a displaced item can take the
place of one or two smaller ones and fill the container better, then by best fit. Fitness is
the mean square of the fill. Blocks of items are packed independently. Each block lives on
several islands, which are tasks of their own that evolve from different seeds; between the
rounds the best packing of each island migrates to the others, and after the last the best of
all stays. A block whose packing has as few containers as its sum allows rests. The badly
filled containers of each block are emptied and their items packed again together with those
of neighbouring blocks, dealt by size into as many groups as it takes to bound their items.
Every block and every group is searched, whatever its size.

An item larger than the capacity is cut into full containers and one remainder, which is
packed like any other item.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import materialize

#: Items a block, islands a block, rounds (with a migration between two), packings an island
#: keeps, children it makes a round, packings that it hands on.
BLOCK, ISLANDS, ROUNDS, POPULATION, CHILDREN, ELITES = 1000, 2, 3, 4, 30, 2

#: Blocks whose badly filled containers are packed together, fill below which a container is
#: emptied for that, most items of a group.
NEIGHBOURS, WELL, GROUP = 64, 0.995, 20_000

#: Times as many children for such groups: there are few of them.
LONGER = 4

#: Kinds of containers: read to the driver, more are an error.
MOST_FORMATS = 10_000

#: Items of each container, room left in it.
Packing = tuple[list[list[int]], list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, packing: Packing) -> None:
    """Put the items, in the order given, each where least room stays."""
    bins, room = packing
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        n = sizes[i]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            r, b = free.pop(at)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(0)
        room[b] = r - n
        if room[b]:
            insort(free, (room[b], b))


def exchanged(packing: Packing, loose: list[tuple[int, int]], sizes: list[int], order: list[int]) -> None:
    """In each container, in the order given, the exchange of one or two items for a larger
    loose one that leaves least room; what comes out is loose. ``loose``: sorted (size, item)."""
    bins, room = packing
    for b in order:
        left, items = room[b], bins[b]
        if not left or not loose:
            continue
        gain, at, out = 0, -1, (0, 0)
        for p, i in enumerate(items):
            for q in range(p, len(items)):
                taken = sizes[i] if q == p else sizes[i] + sizes[items[q]]
                k = bisect_right(loose, (taken + left, 1 << 60)) - 1
                if k >= 0 and loose[k][0] - taken > gain:
                    gain, at, out = loose[k][0] - taken, k, (p, q)
            if gain == left:
                break
        if gain:
            _, new = loose.pop(at)
            for i in {items[out[0]], items[out[1]]}:
                insort(loose, (sizes[i], i))
            bins[b] = [i for k, i in enumerate(items) if k not in out] + [new]
            room[b] = left - gain


def fitness(packing: Packing, capacity: int) -> float:
    """Mean square of the fill: fuller and emptier containers beat evenly filled ones."""
    return sum(((capacity - r) / capacity) ** 2 for r in packing[1]) / max(len(packing[1]), 1)


def crossed(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: Random) -> Packing:
    """Child of ``a`` with well-filled containers of ``b`` injected."""
    well = sorted(range(len(b[0])), key=b[1].__getitem__)[: max(1, len(b[0]) // 2)]
    chosen = rng.sample(well, max(1, len(well) // rng.choice((2, 4, 8))))
    bins, room = [list(b[0][k]) for k in chosen], [b[1][k] for k in chosen]
    taken = {i for k in chosen for i in b[0][k]}
    loose: list[int] = []
    for x, r in zip(*a):
        if taken.isdisjoint(x):
            bins.append(list(x))
            room.append(r)
        else:
            loose += [i for i in x if i not in taken]
    worst = sorted(range(len(bins)), key=lambda k: -room[k])[: rng.choice((2, 4, 6))]
    emptied = {*worst, *(rng.randrange(len(bins)) for _ in range(3))}
    loose += [i for k in emptied for i in bins[k]]
    child = [x for k, x in enumerate(bins) if k not in emptied], [r for k, r in enumerate(room) if k not in emptied]
    pool = sorted((sizes[i], i) for i in loose)
    first = rng.randrange(len(child[0]) + 1)  # another container begins each time
    exchanged(child, pool, sizes, [*range(first, len(child[0])), *range(first)])
    best_fit([i for _, i in reversed(pool)], sizes, capacity, child)
    return child


def evolved(sizes: list[int], capacity: int, rng: Random, elites: list[Packing], children: int = CHILDREN) -> list[Packing]:
    """The island's packings, the best first, after ``children`` crossovers, from the elites
    and from best-fit packings of shaken orders. With no elites the first is best-fit
    decreasing itself, so no result is worse than that."""
    least = -(-sum(sizes) // capacity)
    start = list(elites)
    while len(start) < POPULATION and not (start and len(start[0][0]) <= least):
        shake = 0.15 if start else 0.0
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + shake * rng.random()))
        own: Packing = ([], [])
        best_fit(order, sizes, capacity, own)
        start.append(own)
    scored = sorted(((fitness(p, capacity), -k, p) for k, p in enumerate(start)), reverse=True)
    for born in range(len(start), len(start) + children):
        if len(scored[0][2][0]) <= least or len(scored) < 2:
            break
        a, b = rng.sample(scored, 2)
        child = crossed(a[2], b[2], sizes, capacity, rng)
        score = fitness(child, capacity)
        if all(abs(score - s) > 1e-12 for s, _, _ in scored):
            scored = sorted([*scored, (score, -born, child)], reverse=True)[:POPULATION]
    return [p for _, _, p in scored]


def _packing(places: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(places, default=-1) + 1)]
    for i, b in enumerate(places):
        bins[b].append(i)
    return bins, [capacity - sum(sizes[i] for i in x) for x in bins]


def _places(packing: Packing, n: int) -> list[int]:
    at = [0] * n
    for b, items in enumerate(packing[0]):
        for i in items:
            at[i] = b
    return at


def _round(number: int, children: int):
    """One round of every island in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                capacity, sizes = row["capienza"], row["misure"]
                if row["elite"] and max(row["elite"][0]) < -(-sum(sizes) // capacity):  # as few as can be: it rests
                    out.append(row)
                    continue
                elites = [_packing(p, sizes, capacity) for p in row["elite"]]
                rng = Random(f"{row['formato_id']} {row['blocco']} {row['isola']} {number}")
                best = evolved(sizes, capacity, rng, elites, children) if sizes else []
                elites = [_places(p, len(sizes)) for p in best[:ELITES]]
                well = [best[0][1][b] <= (1 - WELL) * capacity for b in elites[0]] if best else []
                out.append({**row, "elite": elites, "pieni": well, "valore": fitness(best[0], capacity) if best else 0.0})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


_ISLAND = "formato_id int, capienza bigint, blocco bigint, isola int, misure array<bigint>, elite array<array<int>>, pieni array<boolean>, valore double"
_ARROW = pa.schema([("formato_id", pa.int32()), ("capienza", pa.int64()), ("blocco", pa.int64()), ("isola", pa.int32()), ("misure", pa.list_(pa.int64())), ("elite", pa.list_(pa.list_(pa.int32()))), ("pieni", pa.list_(pa.bool_())), ("valore", pa.float64())])


def _packed(groups: DataFrame, islands: int, rounds: int, children: int, name: str) -> DataFrame:
    """formato_id, capienza, blocco, misure, posti, pieni: the best packing of each group: the
    container of each item and whether it is well filled. ``groups``: formato_id, capienza,
    blocco, misure. A row is a block with its sizes: what moves
    between the rounds are a few arrays a block, not its items."""
    key = ["formato_id", "blocco"]
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: not to be merged
    now = groups.withColumn("isola", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    now = now.withColumn("elite", F.array().cast("array<array<int>>")).withColumn("pieni", F.array().cast("array<boolean>")).withColumn("valore", F.lit(0.0))
    columns = ["formato_id", "capienza", "blocco", "isola", "misure", "elite", "pieni", "valore"]
    for number in range(rounds):
        spread = now.select(*columns).repartition(tasks, "formato_id", "blocco", "isola")
        done = materialize(spread.mapInArrow(_round(number, children), _ISLAND), f"{name}-{number}")
        if number + 1 < rounds:
            best = done.groupBy(*key).agg(F.collect_list(F.struct("isola", F.col("elite")[0].alias("e"))).alias("altre"))
            guests = F.transform(F.filter("altre", lambda x: (x["isola"] != F.col("isola")) & x["e"].isNotNull()), lambda x: x["e"])
            now = done.join(best, key).withColumn("elite", F.concat("elite", guests))
    of = F.max_by(F.struct("capienza", "misure", F.coalesce(F.get("elite", F.lit(0)), F.array().cast("array<int>")).alias("posti"), "pieni"), F.struct("valore", -F.col("isola")))
    return done.groupBy(*key).agg(of.alias("b")).select(*key, "b.*")


def pack(items: DataFrame, key: str, size: str, formats: DataFrame, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS, children: int = CHILDREN) -> DataFrame:
    """formato_id, contenitore (unique in its format), key, parte, n: where every item lies.

    ``items``: a key and a size >= 0 a row; a null size counts as 0, items of size 0 take no
    room, repeated rows are items of their own. ``formats``: formato_id, capienza > 0; others
    are left out, and more than MOST_FORMATS are an error. An item above the capacity is cut:
    ``parte`` counts its pieces, each but the last filling a container of its own; no other
    item is cut. Empty tables give no row. Nothing is dropped: the n of an item's pieces add
    up to its size."""
    kinds = formats.where("formato_id IS NOT NULL AND capienza > 0").select(F.col("formato_id").cast("int"), F.col("capienza").cast("bigint")).distinct()
    known = sorted(tuple(r) for r in kinds.limit(MOST_FORMATS + 1).collect())
    if len(known) > MOST_FORMATS:
        raise ValueError(f"more than {MOST_FORMATS} kinds of containers")
    kind = F.explode(F.array(*(F.struct(F.lit(i).alias("formato_id"), F.lit(c).cast("bigint").alias("capienza")) for i, c in known)) if known else F.array().cast("array<struct<formato_id:int,capienza:bigint>>"))
    items = materialize(items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size")), "misure")
    blocks = max(1, -(-items.count() // block))
    items = items.withColumn("riga", F.monotonically_increasing_id())
    held = items.withColumn("blocco", F.pmod(F.xxhash64("riga", F.lit(7)), F.lit(blocks))).groupBy("blocco")
    held = materialize(held.agg(F.sort_array(F.collect_list(F.struct("size", "riga", "k"))).alias("oggetti")), "blocchi")  # about ``block`` items
    each = held.select("blocco", F.col("oggetti.size").alias("interi"), kind.alias("f")).select("blocco", "f.*", "interi")
    rest = F.transform("interi", lambda x: F.when((x > 0) & (x % F.col("capienza") == 0), F.when(x == F.col("capienza"), x).otherwise(0)).otherwise(x % F.col("capienza")))
    best = _packed(each.withColumn("misure", rest).drop("interi"), islands, rounds, children, "isole")
    zipped = F.arrays_zip("oggetti", "misure", "posti", "pieni")
    rows = best.join(held, "blocco").select("formato_id", "capienza", "blocco", F.explode(zipped).alias("x"))
    size_of, part = F.col("x.oggetti.size"), F.expr("x.oggetti.size div capienza")
    rows = rows.select("formato_id", "capienza", "blocco", F.col("x.oggetti.k").alias("k"), F.col("x.oggetti.riga").alias("riga"), size_of.alias("size"), F.col("x.misure").alias("n"), F.col("x.posti").alias("bin"), F.col("x.pieni").alias("pieno"), F.when(F.col("x.misure") == size_of, 0).otherwise(part).cast("int").alias("parte"))
    rows = materialize(rows.where("n > 0 OR size = 0"), "posti")  # a multiple of the capacity leaves no remainder
    loose = rows.where("NOT pieno").withColumn("gruppo", F.expr(f"blocco div {NEIGHBOURS}"))
    loose = loose.groupBy("formato_id", "capienza", "gruppo").agg(F.sort_array(F.collect_list(F.struct("n", "riga", "parte", "k"))).alias("oggetti"))
    loose = loose.withColumn("mani", F.ceil(F.size("oggetti") / GROUP)).withColumn("mano", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mani") - 1)))
    dealt = F.filter("oggetti", lambda x, i: i % F.col("mani") == F.col("mano"))
    loose = loose.select("formato_id", "capienza", (F.col("gruppo") + F.col("mano") * (1 << 40)).alias("blocco"), dealt.alias("oggetti"))
    loose = materialize(loose, "residui")
    again = _packed(loose.select("formato_id", "capienza", "blocco", F.col("oggetti.n").alias("misure")), islands, rounds, LONGER * children, "gruppi").drop("capienza", "misure", "pieni")
    again = again.join(loose, ["formato_id", "blocco"]).select("formato_id", "blocco", F.explode(F.arrays_zip("oggetti", "posti")).alias("x"))
    name = lambda mark: F.concat_ws("-", F.lit(mark), F.col("blocco").cast("string"), F.col("bin").cast("string"))
    again = again.select("formato_id", "blocco", F.col("x.posti").alias("bin"), F.col("x.oggetti.k").alias("k"), F.col("x.oggetti.parte").alias("parte"), F.col("x.oggetti.n").alias("n"))
    out = rows.where("pieno").select("formato_id", name("b").alias("contenitore"), "k", "parte", "n").unionByName(again.select("formato_id", name("g").alias("contenitore"), "k", "parte", "n"))
    long = items.where(F.col("size") > F.lit(min((c for _, c in known), default=0))).select("k", "size", "riga", kind.alias("f")).select("k", "size", "riga", "f.*").where("size > capienza")
    full = long.select("formato_id", "capienza", "k", "riga", F.explode(F.sequence(F.lit(0), (F.expr("size div capienza") - 1).cast("int"))).alias("parte"))
    whole = F.concat_ws("-", F.lit("p"), F.col("riga").cast("string"), F.col("parte").cast("string"))
    out = out.unionByName(full.select("formato_id", whole.alias("contenitore"), "k", "parte", F.col("capienza").alias("n")))
    return out.withColumnRenamed("k", key)
