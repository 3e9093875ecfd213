"""Minimax contiguous sharding (operator 10), in DataFrame functions only.

Equal texts form one atomic group.  Groups lie in the order of their text's SHA-256; shards are runs of that order.
The smallest capacity for which a greedy walk needs no more than the given number of shards is found by search over
the running sums of the group sizes, and the walk at that capacity makes the cuts.  A cut is kept as a digest prefix
that begins behind it, so each row finds its shard by comparing digests; nothing is joined to the rows.

The search never gathers all groups.  The driver knows the running sums where digest prefixes begin, at first those
of four hex digits (at most 65,536 numbers).  At a capacity the walk's cuts then lie between two walks: one that takes
every cut inside a prefix as early as can be, one that takes it as late as can be.  Both need sums alone, so the
capacities that may still be the smallest, and the prefixes in which their cuts may fall, are found without a job.  One
job divides these prefixes further (at most `at_once` of them, into at most `local_groups` parts or, where more are
needed at once, 16 for each), and the search goes on until each cut falls where a single group stands.

Cases: a null text has size 8, checksum 0 and its own group with empty texts.  Rows that repeat, and null ids, are
rows like any other.  With fewer groups than shards some shards stay empty.  An empty table gives an empty result.
A group larger than the mean shard sets the capacity alone; the other groups then fill fewer shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

DIGITS = 4  # hex digits of the first prefixes


@dataclass(frozen=True)
class ShardParams:
    shards: int = 24
    overhead: int = 8
    at_once: int = 4096
    local_groups: int = 50_000


class _Sums:
    """Running sums of group sizes where digest prefixes begin; a prefix is divided where a cut may fall inside."""

    def __init__(self, groups: DataFrame, p: ShardParams):
        self.groups, self.p = groups, p
        self._keep(self._parts(groups, DIGITS))

    def _parts(self, groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        """(prefix, bytes, number of groups) of each prefix of so many digits."""
        by = groups.groupBy(F.substring(F.hex("digest"), 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        return [tuple(r) for r in by.collect()]

    def _keep(self, parts: list[tuple[str, int, int]]) -> None:
        self.parts = sorted(parts)
        self.starts = [0, *accumulate(size for _, size, _ in self.parts)]
        self.total = self.starts.pop()

    def at(self, target: int) -> int:
        """The part that holds the byte behind the target."""
        return bisect_right(self.starts, target) - 1

    def walk(self, capacity: int, late: bool) -> list[int]:
        """The greedy cuts as running sums, none later (late: none earlier) than they are."""
        cuts = [0]
        for _ in range(self.p.shards):
            target = cuts[-1] + capacity
            if target >= self.total:
                return [*cuts, self.total]
            part = self.at(target)
            cuts.append(target if late and self.parts[part][2] > 1 else self.starts[part])
        return cuts

    def least(self, low: int, late: bool) -> int:
        """The smallest capacity from low on that such a walk gets to the end with."""
        return low + bisect_left(range(low, self.total), True, key=lambda c: self.walk(c, late)[-1] == self.total)

    def unsure(self, first: int, last: int) -> list[int]:
        """Parts of several groups where a cut may fall for a capacity from first to last."""
        inside: set[int] = set()
        for early, late in zip_longest(self.walk(first, False), self.walk(last, True), fillvalue=self.total):
            if early + first < self.total:
                inside.update(range(self.at(early + first), self.at(min(late + last, self.total - 1)) + 1))
        return [k for k in inside if self.parts[k][2] > 1]

    def divide(self, wanted: list[int]) -> None:
        """Divide the coarsest of these parts, the largest first, as finely as the driver has room for."""
        digits = min(len(self.parts[k][0]) for k in wanted)
        some = sorted((k for k in wanted if len(self.parts[k][0]) == digits), key=lambda k: -self.parts[k][1])[: self.p.at_once]
        room = lambda more: sum(min(self.parts[k][2], 16**more) for k in some)
        more = max((m for m in range(1, 64 - digits + 1) if room(m) <= self.p.local_groups), default=1)
        within = F.substring(F.hex("digest"), 1, digits).isin([self.parts[k][0] for k in some])
        gone = set(some)
        self._keep([x for k, x in enumerate(self.parts) if k not in gone] + self._parts(self.groups.where(within), digits + more))


def smallest_capacity(sums: _Sums, p: ShardParams) -> list[int]:
    """Cuts (running sums, first 0, last the total) of the smallest capacity that p.shards shards suffice for."""
    first = -(-sums.total // p.shards)
    while True:
        first = sums.least(first, True)  # no smaller one can do
        wanted = sums.unsure(first, sums.least(first, False))
        if not wanted:
            return sums.walk(first, False)
        sums.divide(wanted)


def sized(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """A narrow row for each document, with its group's digest and a number that tells equal rows apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", (F.octet_length(text) + p.overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
    )


def cuts_of(rows: DataFrame, p: ShardParams = ShardParams()) -> list[bytes]:
    """Where each shard but the first begins: no digest of it is smaller, all before it are."""
    sums = _Sums(cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes"))), p)
    if not sums.parts:
        return []
    cuts = smallest_capacity(sums, p)[1:-1]
    begin = {start: prefix for start, (prefix, _, _) in zip(sums.starts, sums.parts, strict=True)}
    return [bytes.fromhex(begin[c] + "0" * (len(begin[c]) % 2)) for c in cuts]


def shard_of(digest: Column, cuts: list[bytes]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (digest >= F.lit(c)).cast("int")
    return out


def shard_documents(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each document.

    Slots are numbered in two steps: within what one input split gives a shard, and by the splits' counts before it;
    so no task sees a whole shard, nor all copies of one text.
    """
    rows = cut(sized(docs, p))
    rows = rows.withColumn("shard", shard_of(F.col("digest"), cuts_of(rows, p)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    out = rows.withColumn("local", local).join(starts, ["shard", "part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
