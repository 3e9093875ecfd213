"""Spelling variants (operator 12): words one edit apart, and the common form that a rare one stands for.

Words are counted by Spark's own functions.  Two words that differ by one inserted, deleted or replaced code point
share all but a small window of the shorter one: what stands before the window and what stands behind it are equal.  So
each word goes, as the shorter or the longer of a pair, to one group for each window of its length: the group's key is
the shared part itself, and a pair belongs to the window in which it first differs, so it is found once and only once.
A group that is still large is dealt again by narrower windows, down to one code point, where a group can hold no more
than the words that differ in one or two code points.

Within a group the free middles are one sorted list.  For each word the list is scanned from its own place on, with a
banded edit matrix (three cells a row, the band of one edit).  The rows are kept by depth: the next middle takes over
those of the prefix that it shares with the one before, and where a row has no cell left within one edit, the whole
range that shares that prefix is skipped by a search in the sorted list.  A group yields one row for each of its words
that has a near one (how many, and the commonest), never a row for each pair.  Roots follow the forms by pointer doubling: each form is ten times
as frequent as its word, so the number of rounds follows from the largest count.

Cases: null and blank texts have no words; a null id counts as an empty string in the digest; rows that repeat are
occurrences like any other; ties in frequency go to the smaller word in code-point order; runs of any length take part
(a long one has at most `parts` windows at a time); no words, or an empty table, give an empty result; columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, join_small

LAST = "\U0010ffff"  # behind every letter


@dataclass(frozen=True)
class SpellingParams:
    letters: str = "A-Za-zÀ-ÿ"
    shortest: int = 7
    least: int = 2  # occurrences of a word
    ratio: int = 10  # a form is so many times as frequent as its word
    every: int = 31  # one run in so many loses a code point
    width: int = 2  # code points of a window
    parts: int = 16  # windows of a word at once; those of a longer word are wider
    group_rows: int = 4096  # a group beyond this, or with middles of more than group_chars, is dealt again
    group_chars: int = 4_000_000


def vocabulary(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n: the words with their numbers of occurrences over all documents."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"([{p.letters}]{{{p.shortest},}})"), F.lit(1))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("run"))
    marked = runs.withColumn("run", lower).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % p.every == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = marked.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= p.least) & (F.length("word") >= p.shortest))


def windows(lo: Column, hi: Column, parts: Column) -> Column:
    """[lo, hi) cut into so many windows of nearly one width, as an array of structs."""
    edge = lambda k: lo + F.floor(k * (hi - lo) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(edge(k).alias("lo"), edge(k + 1).alias("hi")))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (shared, size, lo, hi, middle, n) with an array `w` of narrower windows, one row for each."""
    r = rows.select("shared", "size", F.col("lo").alias("was"), F.col("hi").alias("until"), "middle", "n", F.explode("w").alias("w"))
    left, right = F.col("w.lo") - F.col("was"), F.col("until") - F.col("w.hi")  # of the middle, now shared
    free = F.length("middle") - left - right
    shared = F.concat(F.substring(F.col("shared"), F.lit(1), F.col("was")), F.substring(F.col("middle"), F.lit(1), left), F.substring(F.col("middle"), left + free + 1, right), F.substring(F.col("shared"), F.col("was") + 1, F.length("shared")))
    return r.select(shared.alias("shared"), "size", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), F.substring(F.col("middle"), left + 1, free).alias("middle"), "n")


def near_in_group(lo: int, size: int, hi: int, middles: list[str], counts: list[int], behind: str) -> Iterator[tuple[int, int, int]]:
    """(place, near words, place of the commonest) for the words of one sorted group that have a near one.

    behind is what follows the middles in all words; it decides between equal counts.
    """
    found, best, width, last = [0] * len(middles), [-1] * len(middles), hi - lo, hi == size

    def note(a: int, b: int) -> None:
        found[a] += 1
        c = best[a]
        if c < 0 or counts[b] > counts[c] or (counts[b] == counts[c] and middles[b] + behind < middles[c] + behind):
            best[a] = b

    for a, word in enumerate(middles):
        m = len(word)
        rows = [(2, 0, 1)]  # at depth d: edits between its d code points and d - 1, d, d + 1 of the word, 2 for more than one
        before, b = "", a + 1
        while b < len(middles):
            other = middles[b]
            d = min(len(commonprefix((before, other))), len(rows) - 1) if before else 0
            del rows[d + 1 :]
            less, even, more = rows[d]
            while d < len(other):
                x = other[d]
                one = min(even + 1, less + (d < 1 or d > m or word[d - 1] != x), 2)
                two = min(more + 1, one + 1, even + (d >= m or word[d] != x), 2)
                three = min(two + 1, more + (d + 1 >= m or word[d + 1] != x), 2)
                d, less, even, more = d + 1, one, two, three
                rows.append((less, even, more))
                if less + even + more == 6:
                    break
            before = other
            if less + even + more == 6:  # nothing that begins like this is near
                b = bisect_left(middles, other[:d] + LAST, b + 1)
                continue
            gap = m - d
            if -1 <= gap <= 1 and (less, even, more)[gap + 1] == 1 and min(m, d) == width:
                first = len(commonprefix((word, other)))
                if first < width or last:
                    note(a, b)
                    note(b, a)
            b += 1
    return ((k, n, best[k]) for k, n in enumerate(found) if n)


def near_words(vocab: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n_near, best (struct of -n and word: the commonest near word); words without a near one have no row."""

    def of(batches):
        import pyarrow as pa

        names = ["word", "n_near", "best_n", "best"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]

        def solved(key, middles, counts):
            shared, size, lo, hi = key
            whole = lambda k: shared[:lo] + middles[k] + shared[lo:]
            return [(whole(k), n, counts[b], whole(b)) for k, n, b in near_in_group(lo, size, hi, middles, counts, shared[lo:])]

        key, middles, counts, out = None, [], [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for shared, size, lo, hi, middle, n in zip(*cols, strict=True):
                if key != (shared, size, lo, hi):
                    if len(middles) > 1:
                        out += solved(key, middles, counts)
                    key, middles, counts = (shared, size, lo, hi), [], []
                middles.append(middle)
                counts.append(n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if len(middles) > 1 and (out := solved(key, middles, counts)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    key = ["shared", "size", "lo", "hi"]
    length = F.length("word")
    # a word is the shorter of a pair, or, unless it is one of the shortest, the longer of one
    sizes = F.when(length > p.shortest, F.array(length, length - 1)).otherwise(F.array(length))
    rows = vocab.select("word", "n", F.explode(sizes).alias("size"))
    first = windows(F.lit(0), F.col("size"), F.least(F.ceil(F.col("size") / p.width), F.lit(p.parts)).cast("int"))
    rows = dealt(rows.select(F.lit("").alias("shared"), "size", F.lit(0).alias("lo"), F.col("size").alias("hi"), F.col("word").alias("middle"), "n", first.alias("w")))
    small = []
    while True:
        rows = cut(rows)
        large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("middle")).alias("s")).where(((F.col("c") > p.group_rows) | (F.col("s") > p.group_chars)) & (F.col("hi") - F.col("lo") > 1)).select(*key)
        large = cut(large)
        if large.isEmpty():
            small.append(rows)
            break
        small.append(join_small(rows, large, key, "left_anti"))
        again = windows(F.col("lo"), F.col("hi"), F.least(F.col("hi") - F.col("lo"), F.lit(p.parts)).cast("int"))
        rows = dealt(join_small(rows, large, key, "left_semi").withColumn("w", again))
    found = None
    for rows in small:
        part = rows.repartition(*key).sortWithinPartitions(*key, "middle").select(*key, "middle", "n").mapInArrow(of, "word string, n_near long, best_n long, best string")
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame, most: int, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, root for rows word, form: the last of the forms that lead on from a word; most is the largest count."""
    steps = max(1, math.floor(math.log(max(most / p.least, 2), p.ratio)) + 1)
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        out = cut(out)
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        out = out.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    return out


def variants(docs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word."""
    vocab = cut(vocabulary(docs, p))
    most = vocab.agg(F.max("n")).first()[0] or 0
    common = -F.col("best.less") >= p.ratio * F.col("n")
    rows = vocab.join(near_words(vocab, p), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")
    )
    rows = cut(rows)
    ends = roots(rows.where(F.col("form").isNotNull()), most, p)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
