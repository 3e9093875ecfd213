"""Near-duplicates of documents (operator 6): SetSketch registers, banded, judged by likelihood, then verified.

A document's set holds 64-bit hashes of its distinct word 3-shingles.  Its sketch is `registers` values: each is the
truncated logarithm, to base `base`, of the least of exponentially distributed hashes of the set.  Sketches of unions
are register-wise maxima.  Documents with equal sets are one node from the start, so copies cost one row each.

Nodes that agree in all registers of a band share a bucket.  No bucket's pairs are listed.  First each node is tested
against one hub, the first node of most of its buckets.  Then only buckets that still hold different components are
looked at, in units of two blocks of at most `block` nodes, each a task's work: a pair of different components, in the
first band that it shares, stays if its registers (how many are greater, less, equal) and the set sizes leave a
similarity at the threshold likely enough.  A unit gives back a row for each node with such partners; the full sets of
just these nodes, made anew from their texts, go to their units, where the pairs are verified until their components
are joined.  Thus each pair of a shared bucket is tested or already connected.  Two sets at the threshold share no
bucket with probability (1 - t^rows)^bands, below 1e-6 here.

Cases: a null or blank text has an empty set, is linked with nothing and is its own component; with fewer than three
words the whole sequence is the one shingle; null ids take part, and a component of null ids alone has a null id and
keeps all its rows; rows that repeat are linked; bytes that are not UTF-8 are compared as they are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, join_small, octets, small_enough
from plumbline.llm.components import components


@dataclass(frozen=True)
class NearParams:
    shingle: int = 3
    threshold: int = 85  # per cent: 100 * intersection >= threshold * union
    bands: int = 24
    rows: int = 5
    base: float = 1.02
    rate: float = 20.0
    unlikely: float = 12.0  # log of the likelihood ratio beyond which a pair goes
    block: int = 512
    seed: int = 3

    @property
    def registers(self) -> int:
        return self.bands * self.rows


@lru_cache
def _multipliers(p: NearParams):
    import numpy as np

    r = np.random.default_rng(p.seed).integers(0, 2**64, (2, p.registers), np.uint64)
    return r[0] | np.uint64(1), r[1]


def shingle_set(text: bytes, p: NearParams):
    """Sorted distinct hashes of the text's shingles."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z are lowered, only ASCII white space splits
    if len(words) < p.shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - p.shingle + 1
    out = np.zeros(n, np.uint64)
    for k in range(p.shingle):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def sketch(s, p: NearParams):
    """The set's registers.  The least of exponential hashes belongs to the least uniform one."""
    import numpy as np

    a, b = _multipliers(p)
    least = np.full(p.registers, 2**64 - 1, np.uint64)
    for k in range(0, len(s), 1024):
        least = np.minimum(least, (np.multiply.outer(a, s[k : k + 1024]) + b[:, None]).min(axis=1))
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / p.rate
    return np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / math.log(p.base)), 0, 65535).astype("<u2")


def likely(x, y, nx, ny, p: NearParams):
    """For each pair of sketches (rows of x and y, sizes nx and ny): whether a similarity at the threshold or above is likely enough."""
    import numpy as np

    t = p.threshold / 100
    more, less = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    same = x.shape[1] - more - less
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    share = lambda q: -np.log1p(-np.clip(q, 0, 1) * (p.base - 1) / p.base) / math.log(p.base)

    def loglik(j):
        j = np.minimum(j, top)
        a, b = share(u - v * j), share(v - u * j)
        tiny = 1e-12
        return more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))

    every, high = loglik(np.linspace(0, 1, 41)[None, :]), loglik(np.linspace(t, 1, 16)[None, :])
    best = np.maximum(every.max(axis=1), high.max(axis=1))
    sizes = 100 * np.minimum(nx, ny) >= p.threshold * np.maximum(nx, ny)
    return sizes & (high.max(axis=1) >= best - p.unlikely)


def sketches(docs: DataFrame, p: NearParams) -> DataFrame:
    """doc_id, row, text_hash, n_shingles, print (fingerprint of the set) and sketch for each document."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, prints, sigs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(octets(text), p)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(sketch(s, p).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "print", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(of, f"doc_id {kind}, text_hash long, n_shingles long, print binary, sketch binary")
    return out.withColumn("row", F.monotonically_increasing_id())


class _Pairs:
    """Tests pairs of nodes: by likelihood on sketches, then exactly on sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, p: NearParams):
        self.docs, self.nodes, self.p = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("at"), "text"), nodes, p

    def probable(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches don't rule them out."""
        p = self.p
        side = lambda k: self.nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

        def of(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sa", "sb"))
                    ok = likely(x, y, *(b.column(c).to_numpy().astype(np.float64) for c in ("na", "nb")), p)
                    yield b.select(["a", "b"]).filter(pa.array(ok))

        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(of, "a long, b long")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        p = self.p
        probable = cut(self.probable(pairs))
        if not small_enough(probable, 0):
            return cut(self._verified(probable))
        return probable

    def sets(self, some: DataFrame) -> DataFrame:
        """(node, set) of the nodes, made from their texts, which id and text hash find, so that null or repeated ids do no harm."""
        p = self.p
        need = cut(self.nodes.join(some, "node", "left_semi").select("node", F.col("at").alias("_at"), "print"))
        found = join_small(self.docs, need, self.docs["at"].eqNullSafe(need["_at"]), "inner", 50_000).select("node", "print", "text")

        def make(batches):
            import pyarrow as pa

            for b in batches:
                for node, seal, text in zip(b.column("node"), b.column("print"), b.column("text"), strict=True):
                    s = shingle_set(octets(text), p).tobytes()
                    if hashlib.blake2b(s, digest_size=16).digest() == seal.as_py():  # a text hash may have other texts
                        yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([s], pa.binary())], names=["node", "set"])

        return found.mapInArrow(make, "node long, set binary").dropDuplicates(["node"])

    def _verified(self, pairs: DataFrame) -> DataFrame:
        p = self.p
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = cut(self.sets(ends))
        side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"s{k}"))

        def compare(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                ok = []
                for sa, sb in zip(b.column("sa"), b.column("sb"), strict=True):
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (sa, sb))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= p.threshold * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")

    def across(self, member: DataFrame, comps: DataFrame) -> DataFrame:
        """Links between different components of a bucket: enough of them to join what is linked."""
        p = self.p
        at = member.join(comps, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("comp"))
        opened = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        chunks = F.ceil(F.col("n") / p.block).cast("int")
        at = at.join(opened, "key").select("key", "band", "node", "comp", chunks.alias("chunks"), F.pmod(F.xxhash64("node", F.lit(p.seed)), chunks).cast("int").alias("own"))
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        units = at.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "node", "comp", "own").join(self.nodes.select("node", "n", "sketch"), "node")
        unit = ["key", "i", "j"]

        def guess(batches):
            for key, rows in _groups(batches, unit):
                if found := _likely_partners(rows, key[1] != key[2], p):
                    yield _batch([(*key, *r) for r in found], [*unit, "node", "comp", "partners"], "lllll[")

        lists = cut(units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(guess, "key long, i int, j int, node long, comp long, partners array<long>"))
        if small_enough(lists, 0):
            return lists.select(F.col("node").alias("a"), F.col("node").alias("b"))
        full = lists.join(self.sets(lists.select("node").distinct()), "node")

        def verify(batches):
            for _, rows in _groups(batches, unit):
                if found := _join_components(rows, p):
                    yield _batch(found, ["a", "b"], "ll")

        return cut(full.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(verify, "a long, b long"))


def _groups(batches, keys: list[str]):
    """(key, rows as dicts) of consecutive rows with equal keys."""
    held, last = [], None
    for b in batches:
        for row in b.to_pylist():
            if (now := tuple(row[k] for k in keys)) != last:
                if held:
                    yield last, held
                held, last = [], now
            held.append(row)
    if held:
        yield last, held


def _batch(rows, names, kinds):
    import pyarrow as pa

    types = {"l": pa.int64(), "[": pa.list_(pa.int64())}
    kind = lambda n, k: pa.int32() if n in ("i", "j") else types[k]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind(n, k)) for c, (n, k) in enumerate(zip(names, kinds, strict=True))], names=names)


def _likely_partners(rows: list[dict], two: bool, p: NearParams) -> list[tuple]:
    """(node, comp, likely partners after it) of a unit's nodes that have or are partners."""
    import numpy as np

    x = np.frombuffer(b"".join(r["sketch"] for r in rows), "<u2").reshape(len(rows), -1)
    comp, n, own = (np.array([r[c] for r in rows]) for c in ("comp", "n", "own"))
    size, band = n.astype(float), rows[0]["band"]
    partners: dict[int, list[int]] = {}
    for k in range(len(rows) - 1):
        at = np.arange(k + 1, len(rows))
        ok = (comp[at] != comp[k]) & (100 * np.minimum(n[at], n[k]) >= p.threshold * np.maximum(n[at], n[k]))
        if two:
            ok &= own[at] != own[k]
        at = at[ok]
        if band and len(at):  # pairs that share an earlier band are another unit's
            same = (x[at, : band * p.rows] == x[k, : band * p.rows]).reshape(len(at), band, p.rows).all(axis=2).any(axis=1)
            at = at[~same]
        if len(at):
            at = at[likely(np.broadcast_to(x[k], (len(at), x.shape[1])), x[at], np.full(len(at), size[k]), size[at], p)]
        if len(at):
            partners.setdefault(k, []).extend(rows[j]["node"] for j in at)
            for j in at:
                partners.setdefault(int(j), [])
    return [(rows[k]["node"], rows[k]["comp"], found) for k, found in sorted(partners.items())]


def _join_components(rows: list[dict], p: NearParams) -> list[tuple[int, int]]:
    """Verified links of a unit, none between components that are joined already.

    Sets stay sorted arrays of eight bytes for each shingle; two at a time are compared.
    """
    import numpy as np

    sets = {r["node"]: np.frombuffer(r["set"], np.uint64) for r in rows}
    comp = {r["node"]: r["comp"] for r in rows}
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    out = []
    for r in rows:
        a = r["node"]
        for b in r["partners"]:
            if b in sets and (u := find(comp[a])) != (v := find(comp[b])):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= p.threshold * (len(sets[a]) + len(sets[b]) - both):
                    root[u] = v
                    out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """doc_id, row, text_hash, n_shingles, component_id, kept, first, comp for each document; first marks one row of each component, comp numbers it."""
    rows = cut(sketches(docs, p))
    nodes = cut(rows.where("n_shingles > 0").groupBy("print").agg(F.min("row").alias("node"), F.min_by(F.struct("doc_id", "text_hash"), "row").alias("at"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    width = 2 * p.rows
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * width + 1, width)) for k in range(p.bands)])
    member = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    shared = member.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    member = cut(member.join(shared, "key"))  # nodes alone in a bucket are gone
    test = _Pairs(docs, nodes, p)

    votes = member.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    first_try = votes.groupBy(F.col("node").alias("b")).agg(F.min(F.struct(-F.col("n"), F.col("hub").alias("hub"))).alias("h")).select(F.col("h.hub").alias("a"), "b")
    links = test.linked(first_try)
    comps = components(links, "a", "b")
    more = test.across(member.drop("hub"), comps)
    if not small_enough(more, 0):
        comps = components(links.unionByName(more), "a", "b")

    of_set = nodes.select("print", "node").join(comps, "node", "left").select("print", F.coalesce("component", "node").alias("comp"))
    placed = rows.select("doc_id", "row", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print")).join(of_set, "print", "left")
    placed = cut(placed.select("doc_id", "row", "text_hash", "n_shingles", F.coalesce("comp", F.col("row")).alias("comp")))
    least = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("m"))
    out = placed.join(least, "comp")
    return out.select("doc_id", "row", "text_hash", "n_shingles", F.col("m.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("m.doc_id")).alias("kept"), (F.col("row") == F.col("m.row")).alias("first"), "comp")


def filter_documents(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """One document of each component, with its own columns; rows that repeat an id and its text stay once.

    Rows without words are linked with nothing and all stay.  What goes is taken out by id and text hash; few are
    broadcast, many are joined by shuffling.
    """
    some = near_duplicates(docs, p).where("n_shingles > 0")
    by = cut(some.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("n")))
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(body, "doc_id", F.xxhash64("text").alias("text_hash"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    rows = join_small(rows, by.where("NOT stays").select("_id", "_hash"), on, "left_anti", 100_000)
    again = by.where("stays AND n > 1").select("_id", "_hash")
    if small_enough(again, 0):
        return rows.select("_row.*")
    once = join_small(rows, again, on, "left_anti", 100_000)
    first = join_small(rows, again, on, "left_semi", 100_000).dropDuplicates(["doc_id", "text_hash"])
    return once.select("_row.*").unionByName(first.select("_row.*"))
