"""Exact quantiles of many groups at once, of which none need fit a task.

Equal values are counted first.  A group that still has many distinct values is cut into ranges whose bounds come from a
mergeable sketch; a histogram over the ranges, which is exact, says in which of them each wanted rank lies, and only
those ranges are looked into further.  The sketch decides how evenly a range is cut, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.stored import stored

RANGES = 64  # a group is cut into so many ranges in a round


def order_statistics(counted: DataFrame, wanted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, rank, v): the value at each wanted rank (from 0) of its group.

    counted: keys, v, n, a row for each distinct value; wanted: keys, rank.  keys hold no nulls.
    """
    cell = [*keys, "cell"]
    values = counted.withColumn("cell", F.lit(""))
    open_ = wanted.withColumns({"cell": F.lit(""), "left": F.col("rank")})
    done = []
    while True:
        sizes = values.groupBy(*cell).agg(F.count(F.lit(1)).alias("d"))
        large = stored(sizes.where(F.col("d") > most).select(*cell))
        if large.isEmpty():
            done.append((values, open_))
            break
        done.append((values.join(large, cell, "left_anti"), open_.join(large, cell, "left_anti")))
        grid = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
        bounds = values.join(large, cell).groupBy(*cell).agg(F.percentile_approx("v", grid, 10_000).alias("bounds"))
        tagged = stored(values.join(bounds, cell).withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds"))
        ranges = tagged.groupBy(*cell, "range").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*cell).orderBy("range")) - F.col("n")
        ranges = ranges.select(*cell, "range", before.alias("before"), (before + F.col("n")).alias("upto"))
        inner = F.concat("cell", F.lit("."), F.col("range").cast("string"))
        open_ = stored(open_.join(ranges, cell).where("left >= before AND left < upto").select(*keys, "rank", inner.alias("cell"), (F.col("left") - F.col("before")).alias("left")))
        values = stored(tagged.withColumn("cell", inner).drop("range").join(open_.select(*cell).distinct(), cell, "left_semi").select(*cell, "v", "n"))
    out = None
    for some, ranks in done:
        upto = F.sum("n").over(Window.partitionBy(*cell).orderBy("v"))
        found = some.withColumn("upto", upto).join(ranks, cell).where("left >= upto - n AND left < upto").select(*keys, "rank", "v")
        out = found if out is None else out.unionByName(found)
    return out


def exact_quantiles(rows: DataFrame, value: Column | str, at: list[float], *keys: str, most: int = 10_000) -> DataFrame:
    """(keys, q1, q2, ...): quantiles with linear interpolation between neighbours, as Spark's percentile has them.

    Nulls are no values; a group without values has no row.  Null keys are a group.  most: distinct values that a task
    may hold of one group.
    """
    safe = [f"_key{i}" for i in range(len(keys))]  # nulls join: each key becomes a struct
    hold = [F.struct(F.col(k).alias("k")).alias(s) for k, s in zip(keys, safe, strict=True)] or [F.lit(0).alias("_all")]
    names = safe or ["_all"]
    v = F.col(value) if isinstance(value, str) else value
    counted = stored(rows.select(*hold, v.alias("v")).where("v IS NOT NULL").groupBy(*names, "v").agg(F.count(F.lit(1)).alias("n")))
    places = counted.groupBy(*names).agg(F.sum("n").alias("total")).select(*names, F.posexplode(F.array(*[F.lit(q) * (F.col("total") - 1) for q in at])).alias("i", "place"))
    places = stored(places.withColumns({"low": F.floor("place"), "high": F.ceil("place")}))
    wanted = places.select(*names, F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = stored(order_statistics(counted, wanted, names, most))
    side = lambda c: found.select(*names, F.col("rank").alias(c), F.col("v").alias(f"v_{c}"))
    both = places.join(side("low"), [*names, "low"]).join(side("high"), [*names, "high"])
    mixed = F.when(F.col("low") == F.col("high"), F.col("v_low").cast("double")).otherwise((F.col("high") - F.col("place")) * F.col("v_low") + (F.col("place") - F.col("low")) * F.col("v_high"))
    out = both.groupBy(*names).agg(*[F.max(F.when(F.col("i") == i, mixed)).alias(f"q{i + 1}") for i in range(len(at))])
    return out.select(*[F.col(s)["k"].alias(k) for s, k in zip(safe, keys, strict=True)], *[f"q{i + 1}" for i in range(len(at))])
