"""Rate windows that open at a client's first hit, for many clients at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Parts of a bucket that are ranked apart before its first hits are taken together.
SALTS = 64


def _cell(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def first_at_or_after(times: DataFrame, width: int) -> DataFrame:
    """(client, t, nxt): for each distinct time of a client, its first time that is at least `width` later; no row where there is none.

    A window holds the times of one client in one cell of `width`, not all of a client's; beyond the next cell only the first time of each cell counts.
    """
    own = times.withColumn("cell", _cell(F.col("t"), width))
    points = own.select("client", "cell", F.col("t").alias("v"), F.col("t").alias("point"), F.lit(None).cast("long").alias("asker"))
    asks = own.select("client", (F.col("cell") + 1).alias("cell"), (F.col("t") + width).alias("v"), F.lit(None).cast("long").alias("point"), F.col("t").alias("asker"))
    down = Window.partitionBy("client", "cell").orderBy(F.desc("v"), F.col("asker").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = points.unionByName(asks).withColumn("inside", F.last("point", ignorenulls=True).over(down)).filter("asker is not null").select("client", (F.col("cell") - 1).alias("cell"), F.col("asker").alias("t"), "inside")
    by_cell = Window.partitionBy("client").orderBy("cell")
    firsts = own.groupBy("client", "cell").agg(F.min("t").alias("first"))
    firsts = firsts.select("client", "cell", F.lead("cell").over(by_cell).alias("next_cell"), F.lead("first").over(by_cell).alias("next_first"), F.lead("first", 2).over(by_cell).alias("third_first"))
    later = F.when(F.col("next_cell") == F.col("cell") + 1, F.coalesce("inside", "third_first")).otherwise(F.col("next_first"))
    return inside.join(firsts, ["client", "cell"]).select("client", "t", later.alias("nxt")).filter("nxt is not null")


def openers(times: DataFrame, width: int) -> DataFrame:
    """(client, t): the times at which a window opens: a client's first, and then each first one at or after the end of the window before.

    Links to the first time after a window are doubled: after k rounds a link spans 2**k windows, and twice as many openers are known. So there are as many rounds as the longest
    chain has binary digits, and each is a join by client and time, over which a client with many hits is spread.
    """
    links = checkpointed(first_at_or_after(times, width))
    known = checkpointed(times.groupBy("client").agg(F.min("t").alias("t")))
    while True:
        more = checkpointed(known.join(links, ["client", "t"]).select("client", F.col("nxt").alias("t")))
        if more.isEmpty():
            return known
        known = known.unionByName(more)
        onward = links.select("client", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        links = checkpointed(links.join(onward, ["client", "nxt"]).select("client", "t", F.col("far").alias("nxt")))


def fixed_windows(hits: DataFrame, most: int, seconds: int, client: str = "client", at: str = "event_ts", order: str = "event_id") -> DataFrame:
    """Hits with the window they fall into (opened_at, reset_at) and whether they are allowed: the first `most` of a window, by time, then by `order`; at least one.

    A window opens at a client's first hit, or its first one at or after the reset of the window before, and lasts `seconds`. Hits equal in client, time and order are one request. A hit
    without client or time belongs to no window: opened_at, reset_at and allowed are null.
    """
    width = seconds * 1_000_000
    placed = hits.filter(F.col(client).isNotNull() & F.col(at).isNotNull())
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    opened = openers(placed.select(F.col(client).alias("client"), micros.alias("t")).distinct(), width)
    cells = placed.select(F.col(client).alias("client"), _cell(micros, width).alias("cell")).distinct()
    starts = opened.select("client", _cell(F.col("t"), width).alias("cell"), F.col("t").alias("own"))  # two openers never share a cell
    before = Window.partitionBy("client").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(starts, ["client", "cell"], "left").withColumn("earlier", F.last("own", ignorenulls=True).over(before))
    rows = placed.withColumns({"_client": F.col(client), "_t": micros, "_cell": _cell(micros, width)})
    spot = cells.select(F.col("client").alias("_client"), F.col("cell").alias("_cell"), F.col("own").alias("_own"), F.col("earlier").alias("_earlier"))
    rows = rows.join(spot, ["_client", "_cell"]).withColumn("_open", F.when(F.col("_t") >= F.col("_own"), F.col("_own")).otherwise(F.col("_earlier"))).withColumn("_place", F.struct("_t", F.col(order).alias("_order")))
    one = rows.select("_client", "_open", "_place").distinct().withColumn("_salt", F.pmod(F.xxhash64("_place"), F.lit(SALTS)))
    for by in (("_client", "_open", "_salt"), ("_client", "_open")):
        one = one.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_place"))).filter(F.col("_n") <= max(1, most))
    last = one.groupBy("_client", "_open").agg(F.max("_place").alias("_last"))
    as_time = lambda micros: F.timestamp_micros(micros)
    decided = rows.join(last, ["_client", "_open"]).select(*hits.columns, as_time(F.col("_open")).alias("opened_at"), as_time(F.col("_open") + width).alias("reset_at"), (F.col("_place") <= F.col("_last")).alias("allowed"))
    rest = hits.filter(F.col(client).isNull() | F.col(at).isNull())
    nothing = {"opened_at": F.lit(None).cast("timestamp"), "reset_at": F.lit(None).cast("timestamp"), "allowed": F.lit(None).cast("boolean")}
    return decided.unionByName(rest.withColumns(nothing))
