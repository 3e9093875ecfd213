"""Quality classifier (operator 1): regularised quadratic discriminant analysis over document statistics.

Each document gives a vector of transformed statistics of its whole text.  From the labelled rows Spark sums, per
class, the vectors and their products; the driver gets only these sums (a few hundred numbers), shrinks each class's
covariance towards the pooled one and towards its diagonal, and factors it once by Cholesky.  The inverse factors and
log determinants are constants of the scoring expression: a score is the logistic of the difference of the two
Mahalanobis log-densities plus the log of the class shares.  Statistics are logarithms or bounded roots in steps of
2^-12, and their sums are whole numbers, so that the model does not depend on the order in which rows arrive, or on
tasks that run again.  Very long texts, and texts that are one long word, thus have statistics like any other.

Label, language, source and id are no inputs of a score.  Rows whose crc32(doc_id) mod 4 is 2 are held out.
Cases: a null text is an empty one and gets a score from its vector like any other; a null id is not held out and has
no label; null labels are ignored; an id with several labels counts once for each; with fewer than `least` labelled
rows of a class all scores are the smoothed share of label 1; an empty table gives an empty result.  Columns beyond
doc_id and text are ignored by score(), carried by filter_documents().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, let, words_of
from plumbline.llm.quality_rules import SYMBOLS, repeat_words

FEATURES = ("words", "word_len", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "stops", "distinct", "line_len", "short")


@dataclass(frozen=True)
class QdaParams:
    to_pooled: float = 0.2
    to_diagonal: float = 0.1
    floor: float = 1e-3  # least variance
    threshold: float = 0.7
    least: int = 5
    step: int = 4096  # parts of one in which the statistics are counted when sums are taken
    most: float = 32.0  # no statistic is larger
    train_rows: int = 20_000  # labelled rows that filter_documents() learns from, drawn by hash


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def vector(text: Column, p: QdaParams = QdaParams()) -> Column:
    """The document's transformed statistics, a struct of doubles."""
    text = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("d"), repeat_words(ws, 5).alias("r"), F.length(F.array_join(ws, "")).alias("c"),
            F.size(F.filter(ws, lambda w: F.length(w) <= 1)).alias("s"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    both = lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("d"))
    gone = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    def out(v: Column) -> Column:
        w, ls = v["w"], v["l"]
        root = lambda a, b: F.sqrt(F.greatest(a, F.lit(0)) / F.greatest(b, F.lit(1)))
        values = (
            F.log1p(w["n"].cast("double")), F.log1p(w["c"] / F.greatest(w["n"], F.lit(1))), root(F.regexp_count(text, F.lit(SYMBOLS)), w["c"]), root(ls["d"], ls["n"]), root(w["r"], w["n"]),
            root(F.regexp_count(text, F.lit("\\p{Lu}")), w["c"]), root(F.regexp_count(text, F.lit("[0-9]")), w["c"]), root(gone("!"), w["n"]), root(gone("."), w["n"]),
            root(w["d"], w["n"]), F.log1p((w["c"] / F.greatest(ls["n"], F.lit(1))).cast("double")), root(w["s"], w["n"]),
        )
        stepped = lambda x: F.round(F.least(x, F.lit(p.most)) * p.step) / p.step
        return F.struct(*[stepped(x.cast("double")).alias(name) for name, x in zip(FEATURES, values, strict=True)])

    return let(F.struct(let(words_of(text), of).alias("w"), let(lines, both).alias("l")), out)


@dataclass(frozen=True)
class Qda:
    """For each class (0, 1): mean, inverse Cholesky factor, constant of the log-density; or a share alone."""

    classes: tuple
    share: float

    def score(self) -> Column:
        """Score from the feature columns."""
        if not self.classes:
            return F.lit(self.share)
        logs = []
        for mean, factor, const in self.classes:
            rows = ["POWER(" + " + ".join(f"({factor[i][j]!r}D) * ({f} - ({mean[j]!r}D))" for j, f in enumerate(FEATURES) if j <= i) + ", 2)" for i in range(len(FEATURES))]
            logs.append(f"(({const!r}D) - 0.5D * ({' + '.join(rows)}))")
        return F.expr(f"1D / (1D + EXP(LEAST(700D, GREATEST(-700D, {logs[0]} - {logs[1]}))))")


def fit(labelled: DataFrame, p: QdaParams = QdaParams()) -> Qda:
    """Learn from rows with the feature columns and `quality`."""
    import numpy as np

    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    whole = [f"CAST({f} * {p.step} AS BIGINT)" for f in FEATURES]
    x = labelled.where(F.col("quality").isin(0, 1)).groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum({w})").alias(f"s{i}") for i, w in enumerate(whole)], *[F.expr(f"sum({whole[i]} * {whole[j]})").alias(f"p{i}_{j}") for i, j in pairs],
    )
    by = {r["quality"]: r for r in x.collect()}
    n = [by[c]["n"] if c in by else 0 for c in (0, 1)]
    share = (n[1] + 1) / (sum(n) + 2)
    if min(n) < p.least:
        return Qda((), share)
    means, covs = [], []
    for c in (0, 1):
        mean = np.array([by[c][f"s{i}"] / p.step for i in range(k)]) / n[c]
        cov = np.zeros((k, k))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = by[c][f"p{i}_{j}"] / p.step**2 / n[c] - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    classes = []
    for c in (0, 1):
        cov = (1 - p.to_pooled) * covs[c] + p.to_pooled * pooled
        cov = (1 - p.to_diagonal) * cov + p.to_diagonal * np.diag(np.diag(cov)) + p.floor * np.eye(k)
        low = np.linalg.cholesky(cov)
        const = math.log(n[c] / sum(n)) - float(np.log(np.diag(low)).sum())
        classes.append((tuple(means[c].tolist()), tuple(map(tuple, np.linalg.inv(low).tolist())), const))
    return Qda(tuple(classes), share)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "quality")


def score(docs: DataFrame, labels: DataFrame, p: QdaParams = QdaParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    rows = cut(docs.select("doc_id", vector(F.col("text"), p).alias("v")).select("doc_id", "v.*"))
    model = fit(rows.join(training_labels(labels), F.col("doc_id") == F.col("_id")), p)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def filter_documents(docs: DataFrame, known: DataFrame, labels: DataFrame, p: QdaParams = QdaParams()) -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with their own columns.

    It learns from at most about train_rows labelled rows of `known` (the documents as they came in), drawn by hash;
    their ids are broadcast, so no text is shuffled.
    """
    drawn = training_labels(labels).where(F.col("quality").isin(0, 1))
    n = drawn.count()
    if n > p.train_rows:
        drawn = drawn.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * p.train_rows / n)))
    drawn = drawn.limit(2 * p.train_rows)
    rows = known.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("quality", vector(F.col("text"), p).alias("v")).select("quality", "v.*")
    model = fit(rows, p)
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # the row number keeps the filter from being pushed below, where it would measure the text for each use
    rows = docs.select(body, vector(F.col("text"), p).alias("_v"), F.monotonically_increasing_id().alias("_row_no")).select("_row", "_row_no", "_v.*")
    return rows.where((model.score() >= p.threshold) & (F.col("_row_no") >= 0)).select("_row.*")
