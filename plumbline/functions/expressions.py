"""Column expressions that several operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def order_key(*parts: Column | str | int) -> Column:
    """Seeded order that does not depend on partitioning: SHA-256 of the parts, unit separators between them."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws(chr(31), *[c.cast("string") for c in cols]), 256)


def numbered(df: DataFrame, name: str, keys: list[str], key: str, *ties: str, digits: int = 4) -> DataFrame:
    """df with each row's place (from 0) among the rows of equal keys, in the order of a hex digest and then of ties.

    The digest's first digits deal a group's rows to ranges; a place is that in the range plus the sizes of those before,
    so that no task sorts a whole group, however large.
    """
    x = df.withColumn("_range", F.substring(key, 1, digits))
    sizes = x.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_range").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = x.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(key, *ties)) - 1)
    return own.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_own")).cast("long").alias(name))


def draw(n: Column, *parts: Column | str | int) -> Column:
    """A whole number from 0 to n - 1 drawn by a hash of the parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    key = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n


def _past_stirling(x: Column) -> Column:
    """ln x! without its Stirling approximation (x + 1/2) ln x - x + ln(2 pi) / 2, for whole x > 0."""
    exact = [0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)]
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.when(x < 16, F.get(F.array(*map(F.lit, exact)), x.cast("int"))).otherwise(series)


#: Nodes and weights on [0, 1] for an integrand that falls like a normal density.
_NODES = [((float(x) + 1) / 2, float(w) / 2) for x, w in zip(*np.polynomial.legendre.leggauss(48), strict=True)]

MANY = 1_000_000.0  # trials up to which the tail is summed term by term


def two_sided_binomial(wins: Column, losses: Column, many: float = MANY) -> Column:
    """Exact two-sided p-value of a fair binomial, for any counts; 1 without trials.

    The tail is its largest term, C(n, m) / 2^n for the smaller count m, times a sum of products of ratios.  The term
    comes from Stirling's series and the divergence from one half, without a sum.  The ratios fall at least like a normal
    density of variance n / 4, so up to a million trials some 5 sqrt(n) products are added and the rest is below the last
    bit.  Beyond that the sum is the integral of the smooth product (48 nodes where it is above e^-40) and its Euler-Maclaurin corrections,
    so the cost does not depend on the counts.
    """
    zero, one = F.lit(0.0), F.lit(1.0)

    def largest(x: Column) -> Column:
        n, a, b = x["n"], x["a"], x["b"]
        u = (b - a) / n
        divergence = n / 2 * ((1 - u) * F.log1p(-u) + (1 + u) * F.log1p(u))
        inner = -divergence + F.log(n / (2 * math.pi * a * b)) / 2 + _past_stirling(n) - _past_stirling(a) - _past_stirling(b)
        return F.exp(F.when(a > 0, inner).otherwise(-n * math.log(2)))

    def summed(x: Column) -> Column:
        n, a, b = x["n"], x["a"], x["b"]
        count = F.least(a, F.floor(5 * F.sqrt(n)) + 50).cast("int")
        steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(one.alias("term"), one.alias("sum"))

        def step(s: Column, k: Column) -> Column:
            return let(s["term"] * (a - k) / (b + 1 + k), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))

        return F.aggregate(steps, start, step, lambda s: s["sum"])

    def integrated(x: Column) -> Column:
        a, b = x["a"], x["b"]
        fall, bend = F.log(b / a), (1 / a + 1 / b) / 2
        last = F.least(a / 2, 80 / (fall + F.sqrt(fall * fall + 160 * bend)))

        def over(y: Column) -> Column:
            def at(total: Column, node: Column) -> Column:
                i = y * node["x"]
                log_product = -i * fall - (a - i + 0.5) * F.log1p(-i / a) - (b + i + 0.5) * F.log1p(i / b) + (1 / a - 1 / (a - i) + 1 / b - 1 / (b + i)) / 12
                return total + node["w"] * F.exp(log_product)

            nodes = F.array(*[F.struct(F.lit(p).alias("x"), F.lit(w).alias("w")) for p, w in _NODES])
            return y * F.aggregate(nodes, zero, at)

        slope = -F.log((b + 0.5) / (a + 0.5))
        return let(last, over) + 0.5 - slope / 12 + (slope * slope * slope - 6 * bend * slope) / 720

    def tail(x: Column) -> Column:
        far = x["b"] - x["a"] > x["n"] / 2  # so far from one half that many trials leave nothing
        total = F.when(x["n"] <= many, summed(x)).when(far, zero).otherwise(integrated(x))
        return F.when(x["n"] == 0, one).otherwise(F.least(one, 2 * largest(x) * total))

    a, b = F.least(wins, losses).cast("double"), F.greatest(wins, losses).cast("double")
    return let(F.struct((a + b).alias("n"), a.alias("a"), b.alias("b")), tail)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
