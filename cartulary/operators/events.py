"""State over ordered events: stacks, gaps, last values. The counterparts, over tables, of
what a page does with its reader's actions; nothing here claims to be more.

Every window has an order and a running frame: a task streams through a sorted partition, it
never holds a user's events at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(user: list, *order) -> Window:
    return Window.partitionBy(*user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def stacked(events: DataFrame, user: str, order: list[str], step: Column, entry: Column, cut: Callable[[Column], Column] | None = None) -> DataFrame:
    """``profondita`` and ``cima`` of the user's stack after each event.

    ``step`` is 1 for a push of ``entry``, -1 for a pop (of an empty stack: nothing), 0 for
    none, null for closing the stack. After a pop the top is the last entry pushed to the
    depth that is left, so no stack has to be kept: depth is a running sum above its running
    minimum, the top the last push to a depth.

    ``cut`` splits the first column of ``order`` (the day of a time, say). Sums, minima and
    tops are then taken within a user's part; what a part begins with comes from its
    predecessors' sums, one row each, so that a user with a third of all events is many
    tasks. Without it all of a user is one part."""
    part = cut(F.col(order[0])) if cut else F.lit(0)
    rows = events.withColumns({"_s": F.coalesce(step, F.lit(0)), "_c": step.isNull(), "_e": entry, "_p": part})
    rows = rows.withColumn("_g", F.count_if("_c").over(_running([user, "_p"], *order)))
    w = _running([user, "_p", "_g"], *order)
    rows = rows.withColumn("_t", F.sum("_s").over(w)).withColumn("_m", F.least(F.min("_t").over(w), F.lit(0)))
    # what each part leaves behind: its closings, and sum and minimum of its last stretch
    ends = rows.groupBy(user, "_p", "_g").agg(F.sum("_s").alias("_v"), F.min("_m").alias("_n"))
    ends = ends.groupBy(user, "_p").agg(F.max("_g").alias("_x"), F.max_by(F.struct("_v", "_n"), "_g").alias("_z")).select(user, "_p", "_x", "_z.*")
    u = Window.partitionBy(user).orderBy("_p")
    ends = ends.withColumn("_y", F.sum(F.when(F.col("_x") > 0, 1).otherwise(0)).over(u.rowsBetween(Window.unboundedPreceding, 0)))
    v = _running([user, "_y"], "_p")
    ends = ends.withColumn("_r", F.sum("_v").over(v)).withColumn("_q", F.least(F.min(F.col("_r") - F.col("_v") + F.col("_n")).over(v), F.lit(0)))
    before = {"_t0": F.lag("_r", 1, 0).over(u), "_m0": F.lag("_q", 1, 0).over(u), "_g0": F.coalesce(F.sum("_x").over(u.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    ends = ends.select(F.col(user).alias("_u"), F.col("_p").alias("_pp"), *(c.alias(n) for n, c in before.items()))
    rows = rows.join(ends, rows[user].eqNullSafe(F.col("_u")) & rows["_p"].eqNullSafe(F.col("_pp"))).drop("_u", "_pp")
    first = F.col("_g") == 0  # still the stretch that an earlier part began
    total = F.when(first, F.col("_t0")).otherwise(0) + F.col("_t")
    lowest = F.when(first, F.least(F.col("_m0"), F.col("_t0") + F.col("_m"))).otherwise(F.col("_m"))
    rows = rows.withColumn("profondita", (total - lowest).cast("int")).withColumn("_g", F.col("_g0") + F.col("_g"))
    pushed = F.when(F.col("_s") == 1, F.col("_e"))
    rows = rows.withColumn("_own", F.last(pushed, ignorenulls=True).over(_running([user, "_p", "_g", "profondita"], *order)))
    key = [user, "_g", "profondita"]
    # of every part: is the depth asked for there, and what was last pushed to it
    tops = rows.groupBy(*key, "_p").agg(F.max_by("_e", F.when(F.col("_s") == 1, F.struct(*order))).alias("_e"))
    earlier = F.last("_e", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col(user).alias("_u"), F.col("_g").alias("_gg"), F.col("profondita").alias("_d"), F.col("_p").alias("_pp"), earlier.alias("_old")).where("_old IS NOT NULL")
    same = rows[user].eqNullSafe(F.col("_u")) & (rows["_g"] == F.col("_gg")) & (rows["profondita"] == F.col("_d")) & rows["_p"].eqNullSafe(F.col("_pp"))
    rows = rows.join(tops, same, "left")
    return rows.withColumn("cima", F.when(F.col("profondita") > 0, F.coalesce("_own", "_old"))).select(*events.columns, "profondita", "cima")


def last_rows(events: DataFrame, user: str, order: list[str], n: int = 30) -> DataFrame:
    """L1: the last n rows of each user, ``posto`` 1 for the last; the limit is applied before
    the shuffle."""
    w = Window.partitionBy(user).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("posto", F.row_number().over(w)).where(F.col("posto") <= n)


def undisturbed(events: DataFrame, user: str, time: str, order: list[str], wait: str, step: str = "day") -> DataFrame:
    """T4: the events after which nothing happened for ``wait`` (an interval): what a delayed
    action that any new event cancels would act on.

    The next event is sought within the user's ``step`` of time; only the last event of a step
    looks at the first of the user's next one, so that a user with a third of all events is
    many tasks. ``order`` begins with the time."""
    rows = events.withColumn("_passo", F.date_trunc(step, F.col(time)))
    firsts = rows.groupBy(user, "_passo").agg(F.min(time).alias("_primo"))
    later = F.lead("_primo").over(Window.partitionBy(user).orderBy("_passo"))  # one row a step
    firsts = firsts.select(user, "_passo", later.alias("_prossimo"))
    own = F.lead(time).over(Window.partitionBy(user, "_passo").orderBy(*order))
    rows = rows.withColumn("_dopo", own)
    rows = rows.join(firsts, (rows[user].eqNullSafe(firsts[user])) & (rows["_passo"].eqNullSafe(firsts["_passo"])), "left").select(*(rows[c] for c in events.columns), F.coalesce("_dopo", "_prossimo").alias("_dopo"))
    return rows.where(F.col("_dopo").isNull() | (F.col("_dopo") > F.col(time) + F.expr(f"INTERVAL {wait}"))).drop("_dopo")


def debounced(events: DataFrame, user: str, time: str, order: list[str], gap: str) -> DataFrame:
    """T5: user, inizio, fine, n and the last row (``ultimo``) of each run of events with less
    than ``gap`` between them."""
    w = F.session_window(F.col(time).cast("timestamp"), gap)
    rows = events.groupBy(user, w.alias("w")).agg(F.min(time).alias("inizio"), F.max(time).alias("fine"), F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*events.columns), F.struct(*order)).alias("ultimo"))
    return rows.drop("w")


def throttled(events: DataFrame, user: str, time: str, order: list[str], window: str) -> DataFrame:
    """The first event of each user in each window."""
    rows = events.groupBy(user, F.window(F.col(time).cast("timestamp"), window).alias("w")).agg(F.min_by(F.struct(*events.columns), F.struct(*order)).alias("r"))
    return rows.select("r.*")


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, combined map-side."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("r")).select("r.*")


def swipe(dx: Column, dy: Column, ms: Column, least: float = 50, most: float = 100, within: float = 300) -> Column:
    """left or right for a quick, long and level movement, else null; 0 counts as right."""
    counts = (ms <= within) & (F.abs(dx) >= least) & (F.abs(dy) <= most)
    return F.when(counts, F.when(dx < 0, "left").otherwise("right"))
