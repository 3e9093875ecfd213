"""Fill-in-the-middle (operator 11): texts cut at two ranks of units and put together again in another order.

A unit is a code point, or whatever a given pattern matches (words, lines, grapheme clusters).  The ranks of both cuts
count units, the text is indexed by code points; an indexable skip list leads from one to the other.  Its express lanes
hold, for each node, how many units and how many code points lie before the next node of the lane; a unit stands in
lane k with probability `fan ** -k`, by a hash of its number, so the same text always has the same list.  The lowest
lane is the text itself.  A search goes along a lane as long as the units add up to no more than the rank, then down,
and matches the last few units in the text; it ends at the rank's exact code point.  The lanes take about 1 / fan of a
text's units, and the units below them are never listed.

The choice of form and ranks comes from a digest of the row's id, so it depends on no partitioning and a lost task is
redone alike.  Texts go through Spark as Arrow batches, no shuffle takes place.

Cases: null and empty texts are plain and empty.  A text that contains one of the marks is plain, so an output holds
each mark once; no mark can overlap itself or another, so the first of each is the true one and the text is rebuilt
exactly.  What no unit matches belongs to the unit before it (before the first unit: to the first; without any match
the whole text is one unit).  Both cuts may fall together or on an end: parts may be empty.  A null id counts as an
empty string in the digest; rows that repeat get the same output; an empty table gives an empty result; columns beyond
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 8_000_000  # code points of the outputs of one Arrow batch, unless one text alone has more
BLOCK = 65_536  # units whose widths are at hand at once


@dataclass(frozen=True)
class FimParams:
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
    unit: str | None = None  # pattern of a unit; none: a code point
    plain: int = 10  # of a hundred texts stay as they are
    spm: int = 20  # of a hundred others have the suffix first
    seed: str = "1"
    fan: int = 32  # a node of a lane in so many stands in the next one, too

    def __post_init__(self):
        overlap = any(a != b and b in a for a in self.marks for b in self.marks) or any(a.endswith(b[:k]) for a in self.marks for b in self.marks for k in range(1, len(b)))
        if len(set(self.marks)) < 3 or "" in self.marks or overlap:
            raise ValueError("marks must be three strings of which none can overlap another")
        if self.fan < 2:
            raise ValueError("fan must be 2 or more")


def heights(first: int, count: int, fan: int) -> np.ndarray:
    """The highest lane of the nodes first, first + 1, ...: k or more with probability fan ** -k."""
    x = (np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    u = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(fan)).astype(np.int8)


class SkipList:
    """Ranks of units to ranks of code points in one text."""

    def __init__(self, text: str, p: FimParams):
        self.text, self.unit = text, re.compile(p.unit, re.S) if p.unit else None
        at, chars, high = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, 127, np.int8)]
        units = done = 0
        for widths in self.widths():
            h = heights(units, len(widths), p.fan)
            stand = np.flatnonzero(h)
            stand = stand[stand + units > 0]  # the head stands in every lane already
            before = np.cumsum(widths) - widths if self.unit else np.arange(len(widths))
            at.append(stand + units)
            chars.append(before[stand] + done)
            high.append(h[stand])
            units, done = units + len(widths), done + int(widths.sum())
        self.units, self.chars = units, done
        at, chars, high = np.concatenate(at), np.concatenate(chars), np.concatenate(high)
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []  # top first: unit widths, code-point widths, places in the lane below
        below, level = np.arange(len(at)), 1
        while level == 1 or len(below) > 1:
            inside = np.flatnonzero(high[below] >= level)
            nodes = below[inside]
            ends = [np.append(x[nodes], total) for x, total in ((at, units), (chars, done))]
            self.lanes.insert(0, (np.diff(ends[0]).tolist(), np.diff(ends[1]).tolist(), inside.tolist()))
            below, level = nodes, level + 1

    def starts(self, at: int) -> Iterator[int]:
        """Where the units behind the one that begins at code point `at` begin."""
        found = (m.start() for m in self.unit.finditer(self.text, at) if m.end() > m.start())
        next(found, None)
        return found

    def widths(self) -> Iterator[np.ndarray]:
        """Code-point widths of all units, block by block."""
        total = len(self.text)
        if self.unit is None:
            for k in range(0, total, BLOCK):
                yield np.ones(min(BLOCK, total - k), np.int64)
            return
        if not total:
            return
        found, last = self.starts(0), 0
        while some := list(islice(found, BLOCK)):
            yield np.diff(np.array([last, *some]))
            last = some[-1]
        yield np.array([total - last])

    def find(self, rank: int) -> int:
        """The code point at which unit number rank begins (the end, if there are only so many)."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        if rank == self.units:
            return self.chars
        k = units = chars = 0
        for unit_widths, char_widths, down in self.lanes:
            while units + unit_widths[k] <= rank:
                units, chars, k = units + unit_widths[k], chars + char_widths[k], k + 1
            k = down[k]
        rest = rank - units
        if self.unit is None or not rest:
            return chars + rest
        return next(islice(self.starts(chars), rest - 1, None))


def numbers(doc_id, seed: str) -> list[int]:
    """The first four 32-bit numbers of the row's digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(text: str, doc_id, p: FimParams) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    units = SkipList(text, p)
    a, b, whether, order = numbers(doc_id, p.seed)
    if not text or any(m in text for m in p.marks) or whether % 100 >= 100 - p.plain:
        return units.units, "plain", None, None, text
    n = units.units + 1
    first, second = map(units.find, sorted((a % n, b % n)))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    before, after, between = p.marks
    if order % 100 < p.spm:
        return n - 1, "spm", first, len(middle), "".join((after, suffix, before, prefix, between, middle))
    return n - 1, "psm", first, len(middle), "".join((before, prefix, after, suffix, between, middle))


def fill_in_middle(docs: DataFrame, p: FimParams = FimParams()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output for each document."""

    def of(batches):
        import pyarrow as pa

        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids, texts, at = batch.column("doc_id"), batch.column("text"), 0
            sizes = np.cumsum([len(t.as_py() or "") for t in texts])
            while at < len(ids):
                end = max(at + 1, bisect_right(sizes, (sizes[at - 1] if at else 0) + BATCH))
                rows = [transform(texts[k].as_py() or "", ids[k].as_py(), p) for k in range(at, end)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)
                at = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, p: FimParams = FimParams()) -> Column:
    """The text that an output was made of."""
    before, after, between = p.marks

    def span(start: str, end: str | None) -> Column:
        begin = F.locate(start, output) + len(start)
        upto = F.locate(end, output) if end else F.length(output) + 1
        return F.substring(output, begin, upto - begin)

    psm = F.concat(span(before, after), span(between, None), span(after, between))
    spm = F.concat(span(before, between), span(between, None), span(after, before))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame, p: FimParams = FimParams()) -> DataFrame:
    """What fill_in_middle gives, with digests in place of the outputs."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("form"), F.col("output"), p)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
