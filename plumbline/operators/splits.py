"""Splits of examples by whole source files, holdouts, folds, samples and their guards."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import numbered, order_key

SPLITS = ("train", "validation", "test")


def hex_threshold(share: float) -> str:
    """The least 64-bit number whose quotient by 2^64 is not below share, as 16 hex digits."""
    t = int(share * 2**64)
    while t > 0 and (t - 1) / 2**64 >= share:
        t -= 1
    while t / 2**64 < share:
        t += 1
    return f"{min(t, 2**64 - 1):016x}"


def source_hash(seed: int, source="source"):
    """First eight bytes of the seeded SHA-256 of a source; lower-case hex compares as the number does."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(source)), 256), 1, 16)


def hash_split(examples: DataFrame, seed: int = 0, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """examples with a split column; all rows of a source go together."""
    if not 0 < train < 1 or not 0 <= validation < 1 or train + validation >= 1:
        raise ValueError("train and validation must leave room for a test split")
    h = source_hash(seed)
    return examples.withColumn("split", F.when(h < hex_threshold(train), "train").when(h < hex_threshold(train + validation), "validation").otherwise("test"))


def progressions(size: int, filled: tuple, targets: tuple) -> list[tuple[str, int, int]]:
    """(split, first, step) of each split with a target: how the cost grows by its first source of this size and, from
    one such source to the next, by how much more.

    The cost is the sum of squared errors relative to the targets; the numbers are exact, on a common scale.
    """
    terms = []
    for s, f, t in zip(SPLITS, filled, targets, strict=True):
        if t > 0:
            d = Fraction(max(t, 1.0)) ** 2
            terms.append((s, (2 * size * (f - Fraction(t)) + size * size) / d, 2 * size * size / d))
    scale = lcm(*[x.denominator for _, a, b in terms for x in (a, b)])
    return [(s, int(a * scale), int(b * scale)) for s, a, b in terms]


def turn(lists: list[tuple[str, int, int]], k: int, j: int) -> int:
    """The turn (from 0) at which the k-th split gets its j-th source of a run, when the cheapest always comes next.

    Costs of a split rise steadily, so turns are places in a merge of rising lists; of equal costs the first split's is next.
    """
    v = lists[k][1] + j * lists[k][2]
    return j + sum(max(0, (v - a) // b + 1 if i < k else -((a - v) // b)) for i, (_, a, b) in enumerate(lists) if i != k)


def taken(lists: list[tuple[str, int, int]], k: int, turns: int) -> int:
    """How many of the first turns are the k-th split's."""
    lo, hi = 0, turns
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if turn(lists, k, mid) < turns else (lo, mid)
    return lo


def split_at(lists: list[tuple[str, int, int]], at: int) -> str:
    """The split whose turn it is."""
    return next(lists[k][0] for k in range(len(lists)) if taken(lists, k, at + 1) > taken(lists, k, at))


def walk(runs: list[tuple[int, int]], targets: tuple) -> list[tuple[int, list[str], tuple]]:
    """(size, splits of the run's sources that seed one, rows of each split before the others) of each (size, sources).

    The largest sources seed every split, at the least cost; a source counts by its size alone, so a run is one step.
    """
    active = [k for k, t in enumerate(targets) if t > 0]
    runs = sorted(runs, reverse=True)
    if sum(n for _, n in runs) < len(active):
        raise ValueError("fewer sources than splits")
    largest = [size for size, n in runs for _ in range(min(n, len(active)))][: len(active)]
    scale = [Fraction(max(t, 1.0)) for t in targets]
    cost = lambda order: sum(((n - Fraction(targets[k])) / scale[k]) ** 2 for k, n in zip(order, largest, strict=True))
    seeds = list(min(permutations(active), key=cost))
    filled = [0, 0, 0]
    for k, n in zip(seeds, largest, strict=True):
        filled[k] = n
    out = []
    for size, n in runs:
        mine, seeds = seeds[:n], seeds[n:]
        out.append((size, [SPLITS[k] for k in mine], tuple(filled)))
        if rest := n - len(mine):
            lists = progressions(size, tuple(filled), targets)
            for i, k in enumerate(active):
                filled[k] += size * taken(lists, i, rest)
    return out


def assign_balanced(groups: list[tuple[str, int, str]], targets: dict[str, float]) -> dict[str, str]:
    """Split of each of a few (source, size, hash): the largest seed every split with a target, the rest go where the
    squared relative error grows least."""
    goal = tuple(targets[s] for s in SPLITS)
    sizes = Counter(g[1] for g in groups)
    steps = {size: (seeds, progressions(size, filled, goal)) for size, seeds, filled in walk(list(sizes.items()), goal)}
    out, seen = {}, Counter()
    for name, size, _ in sorted(groups, key=lambda g: (-g[1], g[2], g[0])):
        seeds, lists = steps[size]
        at, seen[size] = seen[size], seen[size] + 1
        out[name] = seeds[at] if at < len(seeds) else split_at(lists, at - len(seeds))
    return out


def balanced_split(examples: DataFrame, seed: int = 0, train: float = 0.7, validation: float = 0.15, within: str | None = None, small: str = "train") -> DataFrame:
    """examples with a split column that balances row counts, sources whole; within: in each namespace by itself.

    Sources of one size are a run, and the runs alone (how many sources have each size) are walked in one task, largest
    first; a source then finds its split by its place in its run.  A namespace with fewer sources than splits goes to
    train, or is an error.  Rows without a source are one source.
    """
    part = F.col(within) if within else F.lit("all")
    counts = examples.groupBy(part.alias("_part"), "source").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.coalesce(source_hash(seed), F.lit("0" * 16)))
    kind = counts.schema["_part"].dataType.simpleString()
    shares = (train, validation, 1 - train - validation)

    def follow(rows):
        import pandas as pd

        runs = list(zip(rows["_n"].astype(int).tolist(), rows["sources"].astype(int).tolist(), strict=True))
        total, sources = sum(n * k for n, k in runs), sum(k for _, k in runs)
        targets = tuple(total * s for s in shares)
        if sources >= sum(t > 0 for t in targets):
            steps = walk(runs, targets)
        elif small == "train":
            steps = [(n, ["train"] * k, (0, 0, 0)) for n, k in runs]
        else:
            raise ValueError(f"too few sources in {rows['_part'].iloc[0]}")
        part = rows["_part"].iloc[0]
        return pd.DataFrame({"_p": [part] * len(steps), "_size": [s[0] for s in steps], "seeds": [s[1] for s in steps], "filled": [list(s[2]) for s in steps], "total": [total] * len(steps)})

    def place(frames):
        known = lru_cache(4096)(progressions)
        for rows in frames:
            split = []
            for at, n, seeds, filled, total in zip(*[rows[c].tolist() for c in ("_at", "_n", "seeds", "filled", "total")], strict=True):
                lists = None if at < len(seeds) else known(n, tuple(int(f) for f in filled), tuple(total * s for s in shares))
                split.append(split_at(lists, at - len(seeds)) if lists else seeds[at])
            yield rows[["_part", "source"]].assign(split=split)

    runs = counts.groupBy("_part", "_n").agg(F.count(F.lit(1)).alias("sources"))
    steps = runs.groupBy("_part").applyInPandas(follow, f"_p {kind}, _size long, seeds array<string>, filled array<long>, total long")
    placed = numbered(counts, "_at", ["_part", "_n"], "_h", "source")
    placed = placed.join(steps, F.col("_part").eqNullSafe(F.col("_p")) & (F.col("_n") == F.col("_size"))).select("_part", "source", "_at", "_n", "seeds", "filled", "total")
    found = placed.mapInPandas(place, f"_part {kind}, source string, split string").withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source")) & part.eqNullSafe(F.col("_part"))
    return examples.join(found, on).drop("_part", "_source")


def holdout(examples: DataFrame, held_out: list[str], seed: int = 0, validation: float = 0.0) -> DataFrame:
    """Whole namespaces as test; the rest is train, or train and validation by source hash."""
    if not held_out:
        raise ValueError("name at least one namespace to hold out")
    rest = F.when(source_hash(seed) < hex_threshold(1 - validation), "train").otherwise("validation") if validation else F.lit("train")
    return examples.withColumn("split", F.when(F.col("namespace").isin(held_out), "test").otherwise(rest))


def leave_one_out(examples: DataFrame) -> DataFrame:
    """(fold, split, n) sizes of the folds that hold out each namespace in turn, from counts alone: no fold copies the rows."""
    n = examples.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    if n.limit(2).count() < 2:
        raise ValueError("folds need two namespaces")
    total = n.agg(F.sum("n").alias("total"))
    rows = n.join(F.broadcast(total), F.lit(True))
    return rows.select(F.col("namespace").alias("fold"), F.inline(F.array(F.struct(F.lit("test").alias("split"), F.col("n").alias("n")), F.struct(F.lit("train").alias("split"), (F.col("total") - F.col("n")).alias("n")))))


def stratified_sample(examples: DataFrame, quota: int, size: int, *strata: str, seed: int = 0) -> DataFrame:
    """Up to quota rows of each stratum in stable hash order, then the next rows of all until size is reached."""
    h = order_key(seed, "sample", F.col("task_id"))
    rows = examples.withColumn("_h", h).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", "task_id")))
    rows = rows.where(F.col("_n") <= quota + size)  # a stratum can give no more, and Spark cuts it before it shuffles
    first = rows.where(F.col("_n") <= quota)
    have = first.count()
    rest = rows.where(F.col("_n") > quota).orderBy("_h", "task_id").limit(max(0, size - have))
    return first.unionByName(rest).drop("_h", "_n")


def eligible_namespaces(examples: DataFrame, least: int = 25, files: int = 5, first: int = 4) -> DataFrame:
    """The first namespaces in order with enough examples and files."""
    g = examples.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("files"))
    return g.where((F.col("n") >= least) & (F.col("files") >= files)).orderBy("namespace").limit(first)


def split_sizes(split: DataFrame) -> DataFrame:
    """Rows of each split, 0 for an empty one."""
    names = split.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return names.join(split.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def leaked_namespaces(split: DataFrame) -> DataFrame:
    """Namespaces of the test split that train or validation also have; must be empty.  See also held_out()."""
    return split.where("split = 'test'").select("namespace").intersect(split.where("split <> 'test'").select("namespace"))


def held_out(split: DataFrame) -> DataFrame:
    """The namespaces held out for the test; an error if there are none or if train or validation has one of them."""
    of = split.groupBy("namespace").agg(F.bool_or(F.col("split") == "test").alias("test"), F.bool_or(F.col("split") != "test").alias("other")).where("test")
    if of.isEmpty():
        raise ValueError("the test split is empty")
    said = F.raise_error(F.concat(F.lit("not unseen: "), F.coalesce("namespace", F.lit("null"))))
    return of.select(F.when(F.col("other"), said).otherwise(F.col("namespace")).alias("namespace"))


def shared_sources(split: DataFrame) -> DataFrame:
    """Sources that stand in more than one split; must be empty."""
    return split.groupBy("source").agg(F.countDistinct("split").alias("splits")).where("splits > 1").select("source")


def unlike(examples: DataFrame, split: DataFrame, *columns: str) -> DataFrame:
    """(columns, n, split_n): rows of the examples that the split does not hold as often, or holds without cause; must be empty.

    Empty here and in shared_sources(), the splits are disjoint and jointly complete.
    """
    count = lambda df, name: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    a, b = count(examples, "n").alias("a"), count(split, "split_n").alias("b")
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # the side that has the row has its values: nulls of the other side say nothing
    value = lambda c: F.when(F.col("n").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, same, "full_outer").where("NOT n <=> split_n").select(*[value(c) for c in columns], z("n"), z("split_n"))


def drift(counts: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows of two count tables that differ, with the side they come from."""
    return counts.exceptAll(frozen).withColumn("side", F.lit("now")).unionByName(frozen.exceptAll(counts).withColumn("side", F.lit("frozen")))


def pool_namespaces(parts: dict[str, DataFrame]) -> DataFrame:
    """Repositories' examples in one table, sources prefixed by their namespace."""
    out = None
    for name, df in parts.items():
        one = df.withColumns({"namespace": F.lit(name), "source": F.concat(F.lit(f"{name}::"), F.col("source"))})
        out = one if out is None else out.unionByName(one)
    return out


def namespace_of(source) -> F.Column:
    """The part before the first `::`, an error without one."""
    c = F.col(source) if isinstance(source, str) else source
    return F.when(F.instr(c, "::") > 0, F.substring_index(c, "::", 1)).otherwise(F.raise_error(F.concat(F.lit("source without namespace: "), F.coalesce(c, F.lit("null")))))
