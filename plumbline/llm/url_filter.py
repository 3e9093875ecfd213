"""URL filter (operator 9): host and path rules, and gradient-boosted trees for the URLs that no rule fits.

Rules are a short declared list; each URL is held against it in one projection, no join.  The URLs that a rule decides
are the labelled ones: from a bounded sample of them (`train_rows`, by hash of the URL) Spark ML's boosted trees learn
from lexical features: length, depth, digit ratio, character entropy, parameter counts, hyphens, and statistics of the
host's suffix (what stands behind its first dot): how many URLs and how many hosts of the whole table carry it, as whole
powers of two.  Neither what the rules name (their very hosts and paths) nor any statistic of labels is a feature: a
suffix's share of blocks would only restate the rules where they decide, and say nothing of a suffix that no rule names.
For the same reason the counts are used only where at least `least_suffixes` suffixes have labels, and a power that fewer
than `least_alike` of these bear gives way to the next lower one that enough bear: what is alike for all URLs of a suffix
tells, of a few, which one it is.  A URL is blocked if the trees find it likelier
to be than the labelled URLs are on the whole.  Labels that are no rules don't exist in these tables: the trees carry the
rules' verdicts over to URLs that look alike, and `held_out_auc` tells, on hosts that were not learnt from, how far that
goes.  If the labelled URLs are all of one verdict, or none
exists, URLs without a rule are allowed.

Cases: a null URL, or one without `://`, has an empty host and path and fits no rule; rows that repeat are judged
alike; null ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, join_small, let


@dataclass(frozen=True)
class UrlParams:
    #: (verdict, host/path); a rule's own text is its name.
    rules: tuple = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
    train_rows: int = 20_000
    trees: int = 10
    depth: int = 4
    learning_rate: float = 0.3
    least_suffixes: int = 20  # with fewer labelled suffixes their statistics are left out
    least_alike: int = 5  # labelled suffixes that bear a power for the trees to see it
    block_at: float | None = None  # score from which a URL is blocked; none: the labelled URLs' share of blocks
    seed: int = 5


FEATURES = ("url_len", "host_len", "path_len", "depth", "host_parts", "digit_ratio", "entropy", "n_params", "n_hyphens", "has_fragment", "has_extension", "suffix_n", "suffix_hosts")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "(?s)^([^?#]*)", 1)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits, as a struct (len, rule, verdict), or null."""
    table = F.array(*[F.struct(F.lit(len(r)).alias("len"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for v, r in rules])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.array_max(F.filter(table, fits))


def lexical(judged: DataFrame) -> DataFrame:
    """judged with its host's suffix and the features that come from the URL alone.

    Lengths, digits and entropy are those of the URL without scheme and the host's last label, so that they don't spell it out.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    last = F.regexp_extract("host", "([^.]*)$", 1)
    parent = F.regexp_extract("host", "^[^.]*\\.(.+)$", 1)
    suffix = F.when(parent == "", last).otherwise(parent)
    at = F.locate("://", url)
    name = F.substring(F.col("host"), F.lit(1), F.length("host") - F.length(last))
    body = F.when(at > 0, F.concat(name, F.substring(url, at + 3 + F.length("host"), F.length(url)))).otherwise(url)
    n = F.length("_body")
    share = lambda c: let(F.regexp_count(F.col("_body"), F.concat(F.lit("\\Q"), c, F.lit("\\E"))) / n, lambda q: -q * F.log2(q))
    entropy = F.aggregate(F.array_distinct(F.split("_body", "")), F.lit(0.0), lambda a, c: a + F.when(c == "", F.lit(0.0)).otherwise(share(c)))
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    return judged.withColumns({"suffix": suffix, "_body": body}).withColumns({
        "url_len": n.cast("double"), "host_len": F.length(name).cast("double"), "path_len": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"), "host_parts": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count("_body", F.lit("[0-9]")) / n).otherwise(F.lit(0.0)), "entropy": F.when(n > 0, entropy).otherwise(F.lit(0.0)),
        "n_params": F.regexp_count(query, F.lit("[^&]+")).cast("double"), "n_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "has_fragment": url.contains("#").cast("double"), "has_extension": F.col("path").rlike("\\.[a-z]{2,5}$").cast("double"),
    }).drop("_body")


def suffix_counts(rows: DataFrame) -> DataFrame:
    """For each suffix: how many URLs, and how many different hosts, carry it."""
    hosts = rows.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"))
    return hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"))


def with_suffix(df: DataFrame, counts: DataFrame) -> DataFrame:
    """df with its suffix's numbers of URLs and of hosts, as whole powers of two; 0 for an unknown suffix."""
    power = lambda c: F.floor(F.log2(1 + F.coalesce(F.col(c), F.lit(0)))).cast("double")
    return join_small(df, counts, "suffix", "left").withColumns({"suffix_n": power("n"), "suffix_hosts": power("hosts")}).drop("n", "hosts")


def shared_powers(labelled: DataFrame, counts: DataFrame, p: UrlParams) -> dict[str, list[float]]:
    """For each of the suffix's numbers the powers that enough labelled suffixes bear, ascending; none with too few labelled suffixes."""
    suffixes = with_suffix(labelled.select("suffix").distinct(), counts)
    found = suffixes.groupBy("suffix_n", "suffix_hosts").agg(F.count(F.lit(1)).alias("n")).collect()  # some powers of two
    shared = {}
    for name in ("suffix_n", "suffix_hosts"):
        bearers = Counter()
        for r in found:
            bearers[r[name]] += r.n
        shared[name] = sorted(x for x, n in bearers.items() if n >= p.least_alike and bearers.total() >= p.least_suffixes)
    return shared


def with_shared(df: DataFrame, counts: DataFrame, shared: dict[str, list[float]]) -> DataFrame:
    """with_suffix, each power lowered to the next that is shared (the lowest, if none is below it; 0 if none is shared)."""

    def lowered(name: str, powers: list[float]) -> Column:
        out = F.lit(powers[0] if powers else 0.0)
        for x in powers[1:]:
            out = F.when(F.col(name) >= x, x).otherwise(out)
        return out

    return with_suffix(df, counts).withColumns({name: lowered(name, powers) for name, powers in shared.items()})


def sampled(labelled: DataFrame, n: int, p: UrlParams) -> DataFrame:
    """About train_rows of n labelled rows, drawn by a hash of the URL."""
    part = min(1.0, p.train_rows / n)
    return labelled.where(F.pmod(F.xxhash64("url", F.lit(p.seed)), F.lit(1_000_000)) < F.lit(int(part * 1_000_000)))


def judge_urls(pages: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block) for each page."""
    rows = featured(pages, p)
    labelled = labelled_by_rules(rows)
    scored = score(rows, labelled, p)
    share = labelled.agg(F.avg("label")).first()[0] if p.block_at is None else p.block_at
    verdict = F.coalesce("said", F.when(F.col("score") >= F.lit(share), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def featured(pages: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """The pages' URLs with rule, the rule's verdict and the features of the URL alone, written once."""
    judged = split_url(pages.select("page_id", "url")).withColumn("_r", rule_of(F.col("host"), F.col("path"), p.rules))
    return cut(lexical(judged).select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("said"), "suffix", *FEATURES[:-2]))


def labelled_by_rules(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("rule").isNotNull()).withColumn("label", (F.col("said") == "block").cast("double"))


def score(rows: DataFrame, labelled: DataFrame, p: UrlParams = UrlParams(), counts: DataFrame | None = None) -> DataFrame:
    """rows with score, the probability of block by trees learnt from labelled rows; null unless both labels are there.

    counts: the whole table's suffix_counts, if the rows aren't all of it.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return rows.withColumn("score", F.lit(None).cast("double"))
    counts = cut(suffix_counts(rows) if counts is None else counts)
    shared = shared_powers(labelled, counts, p)
    known = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = known.transform(with_shared(sampled(labelled, sum(found.values()), p), counts, shared))
    train = train.select("features", "label").orderBy(F.xxhash64("features", "label")).limit(2 * p.train_rows)
    model = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, stepSize=p.learning_rate, seed=p.seed, cacheNodeIds=True).fit(cut(train))
    scored = model.transform(known.transform(with_shared(rows, counts, shared)))
    return scored.select(*[scored[c] for c in rows.columns], F.element_at(vector_to_array("probability"), 2).alias("score"))


def held_out_auc(labelled: DataFrame, p: UrlParams = UrlParams(), folds: int = 5) -> float:
    """Area under the ROC curve of labelled rows, each scored by trees that saw none of its host's; one half is chance.

    Hosts go to folds by hash.  The areas of the folds that hold both labels are averaged, weighed by their rows; without such a fold it
    is one half.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    area, weight = 0.0, 0
    dealt = cut(labelled.withColumn("_fold", F.pmod(F.xxhash64("host", F.lit(p.seed)), F.lit(folds))))
    counts = cut(suffix_counts(dealt))
    for k in range(folds):
        held = dealt.where(F.col("_fold") == k)
        scored = score(held.drop("_fold"), dealt.where(F.col("_fold") != k).drop("_fold"), p, counts).where("score IS NOT NULL")
        kinds = scored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels")).first()
        if kinds.labels == 2:
            area += kinds.n * BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(scored)
            weight += kinds.n
    return area / weight if weight else 0.5
