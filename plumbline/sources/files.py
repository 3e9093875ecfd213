"""Reading source trees, parsing each file once, and writing decision sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.functions.binding import PARAMETERS, SHAPE
from plumbline.sources.stored import stored, written

ARITY = "struct<pos:int,req_pos:int,kwonly:int,req_kwonly:int,vararg:boolean,kwarg:boolean,is_async:boolean>"
FACTS = f"namespace string, path string, kind string, ordinal int, name string, signature string, body string, shape {ARITY}, params {PARAMETERS}, class_name string, binding string, callee string, position int, module string, level int, nested boolean, error string"

#: Directories that a scan leaves out.
EXCLUDED = (".git", ".hg", ".mypy_cache", ".nox", ".pytest_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")


def scan(spark: SparkSession, root: str, excluded: tuple = EXCLUDED) -> DataFrame:
    """namespace (first folder below root), path, content of each .py file that lies in no excluded folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    inside = F.regexp_replace(F.col("path"), "^.*" + "\\Q" + root.rstrip("/").rpartition("/")[2] + "\\E/", "")
    parts = F.split(inside, "/")
    kept = rows.where(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, excluded))))
    return kept.select(F.get(parts, F.lit(0)).alias("namespace"), F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("path"), F.col("content").alias("raw")).select("namespace", "path", F.try_validate_utf8(F.col("raw").cast("string")).alias("content"))


def extract(files: DataFrame) -> DataFrame:
    """All facts of all files, a row each, tagged by kind; a file that cannot be read gives one row of kind error.

    Write the result as a table before deriving several things from it, so that each file is parsed once.
    """

    arrow = to_arrow_schema(StructType.fromDDL(FACTS))

    def of(batches):
        import pyarrow as pa

        from plumbline.functions import pysource

        for batch in batches:
            rows = []
            for ns, path, text in zip(*(batch.column(c).to_pylist() for c in ("namespace", "path", "content")), strict=True):
                try:
                    if text is None:
                        raise ValueError("undecodable")
                    rows += [{"namespace": ns, "path": path, **r} for r in pysource.facts(text)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"namespace": ns, "path": path, "kind": "error", "error": type(e).__name__})
            yield from pa.Table.from_pylist(rows, arrow).to_batches()

    return files.select("namespace", "path", "content").mapInArrow(of, FACTS)


def dealt_by_size(files: DataFrame, task_bytes: int = 8_000_000) -> DataFrame:
    """files, dealt to tasks of about task_bytes of content each; a file of that size or more has a task to itself.

    The others are put in an order by hash and cut by the running sum of their bytes, which is added up within ranges of
    the order and over one row for each range.  Only sizes are sorted; contents move once where the sizes are few enough
    to be sent along, else twice.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0)) + 1
    order = ["at", "namespace", "path"]
    sizes = files.select("namespace", "path", F.least(size, F.lit(task_bytes)).alias("weight"), (size >= task_bytes).alias("alone"), F.xxhash64("namespace", "path").alias("at")).dropDuplicates(["namespace", "path"])
    ranges = stored(sizes.repartitionByRange("alone", *order).withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("alone", "part").agg(F.sum("weight").alias("sum"))
    before = sums.select("alone", "part", (F.sum("sum").over(Window.partitionBy("alone").orderBy("part")) - F.col("sum")).alias("before"))
    upto = F.sum("weight").over(Window.partitionBy("alone", "part").orderBy(*order)) - F.col("weight")
    placed = ranges.withColumn("upto", upto).join(F.broadcast(before), ["alone", "part"]).withColumn("task", F.floor((F.col("before") + F.col("upto")) / task_bytes).cast("int"))
    placed = stored(placed.select("namespace", "path", "alone", "task"))
    tasks = {r["alone"]: r["n"] for r in placed.groupBy("alone").agg((F.max("task") + 1).alias("n")).collect()}
    shared = tasks.get(False, 0)
    task = F.when(F.col("alone"), F.col("task") + shared).otherwise(F.col("task"))
    dealt = files.join(placed.select("namespace", "path", task.alias("task")), ["namespace", "path"])
    return dealt.repartitionById(max(1, shared + tasks.get(True, 0)), "task").drop("task")


def fact_table(files: DataFrame) -> DataFrame:
    """The readable files' facts, each file parsed once, as Parquet by kind: symbols(), calls() and the rest read their own part and columns."""
    return readable(written(extract(files), "kind"))


def readable(facts: DataFrame, strict: bool = False) -> DataFrame:
    """Facts of readable files; strict: the first unreadable file is an error."""
    if not strict:
        return facts.where("kind <> 'error'")
    return facts.withColumn("kind", F.when(F.col("kind") == "error", F.raise_error(F.concat_ws(" ", F.lit("cannot read"), "path", "error"))).otherwise(F.col("kind")))


def quarantine(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'error'").select("namespace", "path", "error")


def symbols(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'symbol'").select("namespace", "path", "ordinal", "name", "signature", "body", "shape", "params")


def calls(facts: DataFrame, nested: bool = False) -> DataFrame:
    """Direct calls; nested: inner scopes too."""
    return facts.where(F.col("kind") == "call").where(F.col("nested") == nested).select("namespace", "path", F.col("ordinal").alias("caller_ordinal"), F.col("name").alias("caller"), "callee", F.col("position").alias("call_pos"))


def methods(facts: DataFrame) -> DataFrame:
    """Methods whose name stands once in their class."""
    rows = facts.where("kind = 'method'").select("namespace", "path", "class_name", "binding", "ordinal", "name", "signature", "body", "shape", "params")
    once = rows.groupBy("namespace", "path", "class_name", "name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return rows.join(once, ["namespace", "path", "class_name", "name"], "left_semi")


def method_calls(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'method_call'").select("namespace", "path", "class_name", F.col("name").alias("caller"), "callee", F.col("position").alias("call_pos"))


def imports(facts: DataFrame) -> DataFrame:
    """Module-level imports: name is the bound alias, member the imported name, whole true for `import x`."""
    return facts.where("kind = 'import'").select("namespace", "path", F.col("ordinal").alias("stmt_no"), F.col("position").alias("alias_pos"), "module", "level", F.col("callee").alias("member"), F.col("name").alias("alias"), F.col("nested").alias("whole"))


def name_reads(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'read'").select("namespace", "path", F.col("name").alias("owner"), F.col("callee").alias("name"))


def call_sites(contexts: DataFrame) -> DataFrame:
    """(context_hash, shapes) of distinct contexts; null shapes where a context cannot be parsed."""
    distinct = contexts.select("context", F.sha2("context", 256).alias("context_hash")).dropDuplicates(["context_hash"])

    def of(frames):
        from plumbline.functions import pysource

        for f in frames:
            yield f[["context_hash"]].assign(shapes=[pysource.call_sites(t) for t in f["context"]])

    return distinct.mapInPandas(of, f"context_hash string, shapes array<{SHAPE}>")


def candidate_parameters(candidates: DataFrame) -> DataFrame:
    """(text_hash, params) of distinct rendered candidates."""
    distinct = candidates.select("text", F.sha2("text", 256).alias("text_hash")).dropDuplicates(["text_hash"])

    def of(frames):
        from plumbline.functions import pysource

        for f in frames:
            yield f[["text_hash"]].assign(params=[pysource.candidate_parameters(t) for t in f["text"]])

    return distinct.mapInPandas(of, f"text_hash string, params {PARAMETERS}")


def asked_of_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(namespace, path, content, asked): each file once, with all callers (caller, target) that are asked of it."""
    asked = edges.groupBy("namespace", "path").agg(F.collect_list(F.struct("caller", "target")).alias("asked"))
    return files.select("namespace", "path", "content").join(asked, ["namespace", "path"])


def masked_callers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges (namespace, path, caller, target) with context, rows that still show the target's name left out.

    A file's text travels once and is parsed once, however many of its callers are asked for.
    """

    def of(batches):
        import pyarrow as pa

        from plumbline.functions import pysource

        names = ["namespace", "path", "caller", "target", "context"]
        for batch in batches:
            out = []
            for ns, path, text, asked in zip(*(batch.column(c).to_pylist() for c in ("namespace", "path", "content", "asked")), strict=True):
                said = pysource.masked_all(text, [(x["caller"], x["target"]) for x in asked])
                out += [(ns, path, x["caller"], x["target"], c) for x, c in zip(asked, said, strict=True) if c is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=names)

    return asked_of_files(edges, files).mapInArrow(of, "namespace string, path string, caller string, target string, context string")


def masked(edges: DataFrame) -> DataFrame:
    """masked_callers for edges that carry their file's content."""
    return masked_callers(edges, edges.select("namespace", "path", "content").dropDuplicates(["namespace", "path"]))


def write_decisions(decisions: DataFrame, folder: str) -> None:
    """One JSON-lines folder for each split (empty ones too), keys in order, nulls kept."""
    cols = sorted(c for c in decisions.columns if c != "split")
    for split in ("train", "validation", "test"):
        decisions.where(F.col("split") == split).select(*cols).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{folder}/split={split}")


def read_decisions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
