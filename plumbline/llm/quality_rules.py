"""Quality rules with adaptive thresholds (operator 4), in DataFrame functions only.

Each document gets a few integer measures.  Their distributions are kept as mergeable quantile sketches: counts in
bins whose edges are fixed (32 bins to each power of two, so a quantile is off by about 3 % at most), per language
and source.  Sketches merge by adding counts, so a group with too few documents uses the merged sketch of its
language, and that of all documents if the language is small as well.  A document is rejected if a measure lies
beyond its group's fence: the upper quartile plus a multiple of the distance between the quartiles plus a margin
(for the mean word length also the like below the lower quartile).

Cases: a null text is an empty one; it has no words and fails the base rule.  Null languages and sources are groups
of their own.  Rows that repeat are judged alike, one result each.  An empty table gives an empty result.  Columns
beyond text, lang and source are carried, except those that the rules add.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, join_small, let, words_of

SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleParams:
    """The measures' fences: (multiple of the distance between quartiles, margin in the measure's unit)."""

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    min_group: int = 200
    above: dict = field(default_factory=lambda: {"symbol_bp": (3, 300), "dup_line_bp": (3, 2000), "repeat_bp": (3, 1000), "word_len_c": (3, 150)})
    below: dict = field(default_factory=lambda: {"word_len_c": (3, 150)})


def repeat_words(words: Column, window: int) -> Column:
    """How many words stand in a window of that many words which the text holds twice or more.

    Windows are compared by 64-bit hashes of their words' hashes.  Texts whose windows all differ, the most, end
    after one set lookup per window; else the windows are sorted once.
    """

    def marked(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))
            steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return let(at, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

        return let(pairs, twice)

    def windows(h: Column) -> Column:
        parts = lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)])
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0))), parts)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(marked(w))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count))


def measures(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """docs with the base counts, base_failed, and the measures that the fences judge."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_lines = lambda xs: F.struct(F.size(xs).alias("n"), (F.size(xs) - F.size(F.array_distinct(xs))).alias("d"))
    of_words = lambda ws: F.struct(F.size(ws).alias("n"), repeat_words(ws, p.window).alias("r"), F.length(F.array_join(ws, "")).alias("c"))
    # the row number keeps filters above from being pushed below, where each would measure the text again
    out = docs.withColumns({"_w": let(words_of(F.col("text")), of_words), "_l": let(lines, of_lines), "_row_no": F.monotonically_increasing_id()})
    whole = lambda a, b, k: F.expr(f"CASE WHEN {b} > 0 THEN ({k} * {a}) DIV {b} ELSE 0L END")
    out = out.withColumns({
        "n_words": F.col("_w.n").cast("long"), "word_chars": F.col("_w.c").cast("long"), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": F.col("_l.d").cast("long"), "n_repeat_words": F.col("_w.r").cast("long"), "_lines": F.col("_l.n").cast("long"),
    })
    return out.withColumns({
        "base_failed": (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words")),
        "symbol_bp": whole("n_symbols", "word_chars", 10000), "dup_line_bp": whole("n_dup_lines", "_lines", 10000),
        "repeat_bp": whole("n_repeat_words", "n_words", 10000), "word_len_c": whole("word_chars", "n_words", 100),
    }).drop("_w", "_l", "_lines")


def sketch_bin(x: str) -> str:
    """SQL for the bin of a whole number: its power of two and the next five bits; numbers below 64 have bins of their own."""
    e = f"(length(bin({x})) - 6)"
    return f"CASE WHEN {x} < 64 THEN {x} ELSE CAST({e} * 64 + shiftright({x}, {e}) AS BIGINT) END"


def sketch_value(b: str) -> str:
    """The smallest number in a bin."""
    return f"CASE WHEN {b} < 64 THEN {b} ELSE shiftleft({b} % 64, CAST({b} DIV 64 AS INT)) END"


def sketches(measured: DataFrame, names: list[str]) -> DataFrame:
    """Mergeable sketches: a count for each (lang, source, measure, bin) over documents with a word."""
    some = "n_words > 0 AND _row_no >= 0" if "_row_no" in measured.columns else "n_words > 0"  # as in measures()
    stacked = measured.where(some).select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("measure", "x"))
    return stacked.groupBy("lang", "source", "measure", F.expr(sketch_bin("x")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Group size and quartiles of each sketch: a row for each group, columns n, {measure}_q1, {measure}_q3."""
    of = Window.partitionBy(*keys, "measure")
    up = merged.withColumns({"upto": F.sum("n").over(of.orderBy("bin")), "total": F.sum("n").over(of), "x": F.expr(sketch_value("bin"))})
    at = lambda num: F.min(F.when(F.col("upto") * 4 >= F.col("total") * num, F.col("x")))
    return up.groupBy(*keys, "measure").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """For each (lang, source): the fences of its own sketch, else its language's, else all documents'."""
    levels = [quartiles(sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n")), keys) for keys in (["lang", "source"], ["lang"], [])]
    own, lang, whole = (x.select(*[c for c in ("lang", "source") if c in x.columns], "measure", F.struct("n", "q1", "q3").alias(f"s{i}")) for i, x in enumerate(levels))
    lang = lang.withColumnsRenamed({"lang": "lang1", "measure": "m1"})
    whole = whole.withColumnRenamed("measure", "m2")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("measure") == F.col("m1"))).join(F.broadcast(whole), F.col("measure") == F.col("m2"))  # a row for each measure
    s = F.when(F.col("s0.n") >= p.min_group, F.col("s0")).when(F.col("s1.n") >= p.min_group, F.col("s1")).otherwise(F.col("s2"))
    joined = joined.select("lang", "source", "measure", s.alias("s"))
    pick = lambda m, e: F.max(F.when(F.col("measure") == m, e))
    spread = F.col("s.q3") - F.col("s.q1")
    out = [pick(m, F.col("s.q3") + k * spread + add).alias(f"{m}_max") for m, (k, add) in p.above.items()]
    out += [pick(m, F.col("s.q1") - k * spread - add).alias(f"{m}_min") for m, (k, add) in p.below.items()]
    return joined.groupBy("lang", "source").agg(*out)


def judge(measured: DataFrame, limits: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """measured with kept: false if the base rule or a fence rejects the document."""
    right = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.lit(True)
    for m in p.above:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_max"), F.lit(True))
    for m in p.below:
        inside &= F.coalesce(F.col(m) >= F.col(f"{m}_min"), F.lit(True))
    added = [c for c in right.columns]
    return join_small(measured, right, on, "left").withColumn("kept", ~F.col("base_failed") & inside).drop(*added)


def quality_rules(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """Base counts and the verdict `kept` for each document, without its text."""
    narrow = docs.select("doc_id", "text", "lang", "source")
    names = sorted({*p.above, *p.below})
    measured = cut(measures(narrow, p).drop("text", "_row_no"))
    return judge(measured, cut(fences(sketches(measured, names), p)), p)


def filter_documents(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The fences are found in a first pass; the second measures each text again, so that no text is shuffled.
    """
    names = sorted({*p.above, *p.below})
    limits = cut(fences(sketches(measures(docs.select("text", "lang", "source"), p).drop("text"), names), p))
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return judge(measures(docs.select(body, "text", "lang", "source"), p), limits, p).where("kept AND _row_no >= 0").select("_row.*")
