"""Few candidates out of buckets of any size: rings.

A bucket's members are ordered once, by a seeded digest, and numbered; they form a ring.  A task starts at a place that
its own digest draws and takes as many successors as it needs, each by an equality join on (bucket, place).  So the rows
that are made grow with the tasks times what each of them needs, never with tasks times bucket, and no task of Spark
sees a whole bucket.

The law: the order of a ring is a seeded shuffle, and so is the start, so what one task gets is a sample without
replacement in which each set of members is as likely as any other, as if the whole bucket had been shuffled for it.
Tasks of one bucket share its ring: neighbours in one sample are neighbours in another that meets them.  What a task may
not get (its own target, its caller) is counted beforehand; it takes so many successors more, and those members go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import numbered, order_key


def drawn_place(size: Column, *parts: Column | str | int) -> Column:
    """A place from 0 to size - 1, drawn by 60 bits of the parts' digest."""
    return F.conv(F.substring(order_key(*parts), 1, 15), 16, 10).cast("long") % size


def ring(members: DataFrame, keys: list[str], sym: str, seed: int) -> DataFrame:
    """members with `place`, from 0 within each bucket, in seeded order of the column sym."""
    return numbered(members.withColumn("_digest", order_key(seed, "ring", F.col(sym))), "place", keys, "_digest", sym).drop("_digest")


def bucket_sizes(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_size"))


def successors(tasks: DataFrame, members: DataFrame, keys: list[str], need: Column, sym: str, seed: int) -> DataFrame:
    """Each task (task_id, keys, any more) with `need` members that follow its place, or all of a smaller bucket.

    Gives the task's columns, `step` (from 0), and the members' columns; no two of these may share a name but the keys.
    """
    sized = tasks.join(bucket_sizes(members, keys), keys)
    take = F.least(need.cast("long"), F.col("bucket_size"))
    started = sized.where(take > 0).withColumn("_start", drawn_place(F.col("bucket_size"), seed, "start", F.col("task_id")))
    steps = started.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), take - 1)))
    placed = steps.withColumn("place", (F.col("_start") + F.col("step")) % F.col("bucket_size")).drop("_start", "bucket_size")
    return placed.join(ring(members, keys, sym, seed), [*keys, "place"]).drop("place")
