"""The pipeline's stages against plain versions, and the SQL oracles of the operators."""

import zlib
from array import array
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from plumbline.llm import oracles, quality_classifier, queries

SF = "/root/testdata/sf0.001"


def shingles(t):
    ws = (t or "").encode().lower().split()
    return frozenset(zip(*[ws[k:] for k in range(5)])) if len(ws) > 4 else frozenset([tuple(ws)] if ws else [])


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    by_rules = {r.doc_id for r in queries.op4_quality_rules(spark, SF).collect() if r.kept}
    good = {r.doc_id for r in quality_classifier.score(docs, labels).collect() if r.predicted} & by_rules
    sets = {i: shingles(text[i]) for i in good}
    label = {i: i for i in good}
    links = [(i, j) for i in good for j in good if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in good:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    stay = {i for i in good if label[i] == i}

    at = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (by_rules, good, stay), strict=True):
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
        at = at.cache()
        assert sorted(r.doc_id for r in at.collect()) == sorted(want), name
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for i in stay:
        ids = [*tok.encode(text[i] or "", add_special_tokens=False).ids, 2]
        for k in range(0, len(ids), 4096):
            pieces[i, k, zlib.crc32(array("I", ids[k : k + 4096]).tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == pieces


def plain(v):
    return float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
