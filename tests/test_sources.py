"""Scanning source trees and writing decision sets."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import tasks as T
from plumbline.sources import files as S


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "repos"
    for path, text in {
        "one/a.py": b"from b import g as h\ndef f(x):\n    return h(x)\n", "one/b.py": b"def g(a):\n    return a\n", "one/.venv/c.py": b"def z(): pass\n", "one/build.py": b"def k(): pass\n",
        "two/bad.py": b"def (:\n", "two/raw.py": b"\xff\xfe", "two/note.txt": b"no",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text)
    return str(root)


def test_scan_and_extract(spark, tree):
    files = S.scan(spark, tree)
    assert {(r.namespace, r.path) for r in files.collect()} == {("one", "a.py"), ("one", "b.py"), ("one", "build.py"), ("two", "bad.py"), ("two", "raw.py")}
    facts = S.extract(files).cache()
    assert {(r.path, r.error) for r in S.quarantine(facts).collect()} == {("bad.py", "SyntaxError"), ("raw.py", "ValueError")}
    with pytest.raises(Exception, match="cannot read"):
        S.readable(facts, strict=True).collect()
    ok = S.readable(facts)
    edge = T.cross_file_edges(S.calls(ok), T.imported_symbols(S.imports(ok), S.symbols(ok)), S.symbols(ok)).collect()
    assert [(r.path, r.caller, r.target_path, r.target) for r in edge] == [("a.py", "f", "b.py", "g")]


def test_decisions_round_trip(spark, tmp_path):
    rows = [(1, "é", None, "train"), (2, "b", "x", "test")]
    df = spark.createDataFrame(rows, "task_id long, context string, source string, split string")
    S.write_decisions(df, str(tmp_path / "out"))
    assert (tmp_path / "out/split=validation").is_dir()
    back = S.read_decisions(spark, str(tmp_path / "out"), "task_id long, context string, source string, split string")
    assert sorted(map(tuple, back.select("task_id", "context", "source", "split").collect())) == rows
    line = next(p for p in (tmp_path / "out/split=train").glob("*.json") if p.stat().st_size).read_text()
    assert line.strip() == '{"context":"é","source":null,"task_id":1}'


def test_partitioning_does_not_matter(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("string").alias("task_id"), F.col("id").alias("sym"), (F.col("id") < 7).alias("is_target"))
    pick = lambda n: sorted(map(tuple, T.choose(df.repartition(n), 4, 1).select("task_id", "sym", "cand_idx", "answer_index").collect()))
    assert pick(1) == pick(9) != sorted(map(tuple, T.choose(df, 4, 2).select("task_id", "sym", "cand_idx", "answer_index").collect()))
