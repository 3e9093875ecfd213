"""The k nearest of a pool for many queries, block by block.

Queries and pool of a key are dealt to blocks of a bounded number of rows.  Each pair of blocks is one matrix product,
and what leaves it is at most k rows for each of its queries: the state "k best so far" can be merged, so it is merged
in a tree of blocks, never by ranking all scores.  A vector travels once for each block of the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dealt_blocks(rows: DataFrame, keys: list[str], id_: str, most: int) -> DataFrame:
    """rows with `block`, and `blocks`, the number of blocks of their key, so that a block has about `most` rows."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    return rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int"))


def met_blocks(queries: DataFrame, pool: DataFrame, keys: list[str], query_rows: int, pool_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with blocks (qb, pb), each row once for each block of the other side of its key."""
    q = dealt_blocks(queries, keys, "task_id", query_rows).withColumnsRenamed({"block": "qb", "blocks": "qbs"})
    p = dealt_blocks(pool, keys, "cand_id", pool_rows).withColumnsRenamed({"block": "pb", "blocks": "pbs"})
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = q.join(p.select(*keys, "pbs").distinct(), keys).withColumn("pb", every(F.col("pbs"))).select(*keys, "qb", "pb", *[c for c in queries.columns if c not in keys])
    right = p.join(q.select(*keys, "qbs").distinct(), keys).withColumn("qb", every(F.col("qbs"))).select(*keys, "qb", "pb", *[c for c in pool.columns if c not in keys])
    # both may come from one table: columns of their own tell them apart
    return tuple(x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))


def pair_scores(queries: DataFrame, pool: DataFrame, keys: list[str], query_rows: int = 256, pool_rows: int = 4096) -> DataFrame:
    """(keys, task_id, cand_id, place, score): the cosine of every pair of different ids, without their vectors.

    queries: keys, task_id, vec; pool: keys, cand_id, place (any number of the candidate's), vec; keys hold no nulls.  A
    vector travels once for each block of the other side, a pair leaves its block as a few numbers.  Products are added up
    in the order of the components, as functions.expressions.cosine does, so that the scores are the same to the last bit;
    null if a vector is null, zero, holds a null or has another length.
    """
    left, right = met_blocks(queries.select(*keys, "task_id", "vec"), pool.select(*keys, "cand_id", "place", "vec"), keys, query_rows, pool_rows)

    def of(key, left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(vecs, width):
            x = np.zeros((len(vecs), width))
            sound = np.array([v is not None and None not in v for v in vecs], bool)
            for k in np.flatnonzero(sound):
                x[k, : len(vecs[k])] = vecs[k]
            return x, sound, np.array([len(v or ()) for v in vecs])

        def norm(x):
            total = np.zeros(len(x))
            for k in range(x.shape[1]):
                total += x[:, k] * x[:, k]
            return np.sqrt(total)

        vecs = left["vec"].to_pylist(), right["vec"].to_pylist()
        width = max((len(v) for side in vecs for v in side if v is not None), default=0)
        (a, a_sound, a_len), (b, b_sound, b_len) = (matrix(v, width) for v in vecs)
        dot = np.zeros((len(a), len(b)))
        with np.errstate(all="ignore"):
            for k in range(width):
                dot += a[:, k, None] * b[None, :, k]
            size = norm(a)[:, None] * norm(b)[None, :]
            score = dot / size
        known = a_sound[:, None] & b_sound[None, :] & (a_len[:, None] == b_len[None, :]) & (size != 0)
        task, cand, place = (t[c].to_numpy() for t, c in ((left, "task_id"), (right, "cand_id"), (right, "place")))
        at, to = np.nonzero(task[:, None] != cand[None, :])
        columns = [pa.repeat(k, len(at)) for k in key[: len(keys)]]
        columns += [pa.array(task[at]), pa.array(cand[to]), pa.array(place[to]), pa.array(score[at, to], mask=~known[at, to])]
        return pa.Table.from_arrays(columns, names=[*keys, "task_id", "cand_id", "place", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *pool.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "task_id", "cand_id", "place")) + ", score double"
    return left.groupBy(*keys, "qb", "pb").cogroup(right.groupBy(*keys, "qb", "pb")).applyInArrow(of, schema)


def merged(best: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each (by): score first, then the lower id; rows without a score come last."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("score"), "cand_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocked_shortlist(queries: DataFrame, pool: DataFrame, k: int, keys: list[str], itself: bool = True, digits: int | None = None, query_rows: int = 1024, pool_rows: int = 4096, fan: int = 64) -> DataFrame:
    """(keys, task_id, cand_id, score, rank): the k best of the pool by cosine for each query, all of a smaller pool.

    queries: keys, task_id, vec; pool: keys, cand_id, vec; ids are whole numbers, keys hold no nulls.  Without `itself`
    a candidate of the query's own id is left out.  digits: scores are rounded before they are compared.  Ties go to the
    lower id; a zero or null vector has no score and comes last.
    """
    q, p = met_blocks(queries.select(*keys, "task_id", "vec"), pool.select(*keys, "cand_id", "vec"), keys, query_rows, pool_rows)

    def nearest(key, left, right):
        import numpy as np
        import pandas as pd

        def units(vecs):
            width = max((len(v) for v in vecs if v is not None), default=0)
            x = np.array([np.zeros(width) if v is None else np.asarray(v, float) for v in vecs]).reshape(len(vecs), width)
            norm = np.sqrt((x * x).sum(axis=1))
            return x, norm

        right = right.sort_values("cand_id")
        ids = right["cand_id"].to_numpy()
        out = []
        if len(left) and len(right):
            (a, an), (b, bn) = units(left["vec"].tolist()), units(right["vec"].tolist())
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (a @ b.T) / an[:, None] / bn[None, :]
            if digits is not None:
                scores = scores.round(digits)
            scores[~np.isfinite(scores)] = -np.inf
            for task, row in zip(left["task_id"].tolist(), scores, strict=True):
                known = ids != task if not itself else np.ones(len(ids), bool)
                row = np.where(known, row, np.nan)
                at = np.flatnonzero(known)
                if len(at) > k:
                    least = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = at[row[at] >= least]
                at = at[np.argsort(-row[at], kind="stable")][:k]  # the ids ascend already
                out += [(*key[: len(keys)], key[-1], task, int(ids[j]), None if row[j] == -np.inf else float(row[j])) for j in at]
        return pd.DataFrame(out, columns=[*keys, "pb", "task_id", "cand_id", "score"]).astype({"score": "float64"})

    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *pool.schema]}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "pb int", f"task_id {kinds['task_id']}", f"cand_id {kinds['cand_id']}", "score double"])
    best = q.groupBy(*keys, "qb", "pb").cogroup(p.groupBy(*keys, "qb", "pb")).applyInPandas(nearest, schema)
    best = best.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    blocks = pool.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / pool_rows).alias("n")).agg(F.max("n")).first()[0] or 1
    while blocks > fan:
        best = merged(best.withColumn("pb", F.floor(F.col("pb") / fan).cast("int")), k, *keys, "task_id", "pb").drop("rank")
        blocks = -(-blocks // fan)
    return merged(best.drop("pb"), k, *keys, "task_id")
