"""Near-duplicates of embeddings (operator 8): randomised-rotation binary codes with correction factors.

Each unit vector is turned by seeded random rotations; the signs are its code, and with each rotation goes the inner
product of the turned vector and its code's unit vector, the correction factor.  Bands of code bits put vectors into
buckets (label, dimension and band); bits and bands follow from the number of vectors, so that strangers seldom meet
and two vectors at the threshold miss each other with a probability below `miss`.  For the pairs of a bucket the code
of one and the other's turned vector, divided by the factor, give an unbiased estimate of their inner product, whose
error has a known bound; pairs whose upper bound is below the threshold go, the others are computed exactly, in double
precision, and only exact values make links.

Pairs are not rows: a bucket is worked on in blocks of at most `block` vectors, a pair of blocks to a unit, and gives
back one count for each vector and the edges of a spanning forest.  A pair counts in the first band that it shares.
Equal vectors of a label are one node with a multiplicity, so copies are never compared; they are told by 128 bits of
hashes, so that what is grouped and joined are these and not the vectors.  Vectors are scaled by powers of two before
their squares are taken, so all finite ones are compared, however large or small.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link with
nothing; vectors of different length don't link; null ids take part (a component of null ids alone has a null id and
keeps its rows); rows that repeat are vectors of their own; an empty table gives an empty result; columns beyond
vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut
from plumbline.llm.components import components


@dataclass(frozen=True)
class VectorParams:
    threshold: float = 0.98
    miss: float = 1e-5
    sigmas: float = 6.0
    block: int = 512
    seed: int = 7


def plan_bands(n: int, p: VectorParams) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    bits = min(48, max(16, math.ceil(math.log2(max(n, 2))) + 4))
    agree = (1 - math.acos(p.threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(p.miss) / math.log1p(-agree))


@lru_cache
def rotations(dim: int, bits: int, bands: int, seed: int):
    """Stacked random orthogonal matrices with at least bits * bands rows."""
    import numpy as np

    rng = np.random.default_rng([seed, dim])
    return np.vstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits * bands // dim))])


def in_range(x):
    """The rows of x, each times the power of two that brings its largest component near 1, so that no square overflows or vanishes."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def encode(x, bits: int, bands: int, p: VectorParams):
    """Turned unit vectors, codes (bool), factors per rotation and band keys of the rows of x."""
    import numpy as np

    dim, x = x.shape[1], in_range(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ rotations(dim, bits, bands, p.seed).T
    code = turned > 0
    factors = np.abs(turned).reshape(len(x), -1, dim).sum(axis=2) / math.sqrt(dim)
    keys = code[:, : bits * bands].reshape(len(x), bands, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return turned, code, factors, keys.astype(np.int64)


def estimates(turned, code, factors):
    """Unbiased estimates of all inner products (row: whose code, column: whose vector) and each row's standard error."""
    import numpy as np

    dim = code.shape[1] // factors.shape[1]
    weights = (np.where(code, 1.0, -1.0).reshape(len(code), -1, dim) / (factors[:, :, None] * math.sqrt(dim))).reshape(len(code), -1)
    error = np.sqrt(np.maximum(1 / factors**2 - 1, 0).sum(axis=1)) / factors.shape[1] / math.sqrt(max(dim - 1, 1))
    return weights @ turned.T / factors.shape[1], error


def _forest(n: int, a, b) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (a[k], b[k])."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (r := find(x)) != (s := find(y)):
            root[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


def _unit(nodes, counts, x, side, band: int, across: bool, bits: int, bands: int, p: VectorParams):
    """Counts and forest edges of one unit: all pairs of a block, or the pairs between two."""
    import numpy as np

    x = in_range(x)
    turned, code, factors, keys = encode(x, bits, bands, p)
    guess, error = estimates(turned, code, factors)
    maybe = guess + p.sigmas * error[:, None] >= p.threshold
    maybe = np.triu(maybe | maybe.T, 1)
    if across:
        maybe &= side[:, None] != side[None, :]
    a, b = np.nonzero(maybe)
    fresh = ~(keys[a, :band] == keys[b, :band]).any(axis=1)  # not seen in an earlier band
    a, b = a[fresh], b[fresh]
    norms = np.linalg.norm(x, axis=1)
    exact = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    ok = exact / (norms[a] * norms[b]) >= p.threshold
    a, b = a[ok], b[ok]
    links = np.bincount(a, counts[b], len(x)) + np.bincount(b, counts[a], len(x))
    at = np.nonzero(links)[0]
    edges = _forest(len(x), a, b)
    return [*zip(nodes[at].tolist(), [None] * len(at), links[at].astype(np.int64).tolist(), strict=True), *[(int(nodes[i]), int(nodes[j]), 0) for i, j in edges]]


def near_duplicates(vectors: DataFrame, p: VectorParams = VectorParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    sound &= F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", F.col("label"), F.when(sound, x).alias("x"), F.monotonically_increasing_id().alias("row"))
    mark = F.struct("label", F.size("x").alias("dim"), F.xxhash64(F.lit(1), "x").alias("h1"), F.xxhash64(F.lit(2), "x").alias("h2"))
    rows = cut(rows.select("vec_id", "row", "x", F.when(F.col("x").isNotNull(), mark).alias("same")))
    nodes = cut(rows.where("same IS NOT NULL").groupBy("same").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x")))
    bits, bands = plan_bands(nodes.count(), p)

    def keys(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes = np.array(batch.column("dim").to_pylist(), int)
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                some = batch.take(pa.array(at))
                found = encode(np.array(some.column("x").to_pylist(), float), bits, bands, p)[3]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands), pa.int32()), pa.array(found.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("label"), some.column("dim"), flat], names=["node", "label", "dim", "keys"])

    kind = nodes.schema["same"].dataType["label"].dataType.simpleString()
    coded = nodes.select("node", "same.label", "same.dim", "x").mapInArrow(keys, f"node long, label {kind}, dim int, keys array<long>")
    member = coded.select("node", "label", "dim", F.posexplode("keys").alias("band", "code"))
    at = ["label", "dim", "band", "code"]
    shared = member.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / p.block).cast("int")
    member = member.join(shared, at).select("node", "band", F.xxhash64(*at).alias("key"), chunks.alias("chunks"), F.pmod(F.xxhash64("node", F.lit(p.seed)), chunks).cast("int").alias("own"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = member.select("node", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    full = units.join(nodes.select("node", "copies", "x"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "band", "i", "j")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held, last = [], None

        def give():
            node, copies, side, x = (np.array(c) for c in zip(*held, strict=True))
            _, band, i, j, _ = last
            return _unit(node, copies.astype(float), x.astype(float), side, band, i != j, bits, bands, p) if len(held) > 1 else []

        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["a", "b", "links"])

        for batch in batches:
            for node, band, key, i, j, own, copies, x in zip(*(batch.column(c).to_pylist() for c in ("node", "band", "key", "i", "j", "own", "copies", "x")), strict=True):
                if (now := (key, band, i, j, len(x))) != last:
                    if held and (found := give()):
                        yield pack(found)
                    held, last = [], now
                held.append((node, copies, own, x))
        if held and (found := give()):
            yield pack(found)

    found = cut(full.select("node", "band", "key", "i", "j", "own", "copies", "x").mapInArrow(work, "a long, b long, links long"))
    comps = components(found.where("b IS NOT NULL"), "a", "b")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of_node = nodes.join(counts, "node", "left").join(comps, "node", "left").select("same", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("comp"))
    placed = rows.drop("x").join(of_node, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "row").alias("comp"))
    placed = cut(placed)
    least = placed.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "comp").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
