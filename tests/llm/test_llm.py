"""Each training-data operator against a plain version, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, components, license_scan, near_dedup, packing, quality_classifier, quality_rules, sharding, url_filter, vector_dedup

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, row long, node string"


def odd_texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = say(120).split()
    near = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in (3, 50, 119)] + [" ".join(base)] * 3
    far = [" ".join(w if rng.random() > 0.3 else "q" for w in base)]
    lines = "one line here\n" * 30
    return [None, "", " \n\t", "word", "two words", "Two  WORDS", lines, say(6000), "é ñ 中文 \U0001f600 ß", "<|endoftext|> <|im_start|>", "a" * 3000, "# * $ " * 30, "x\x00y \x85 z\xa0", *near, *far, *[say(60) for _ in range(25)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 11 else None, t, ["en", "de", None][k % 3], ["s", None][k % 2], 1, True, 0.5, 7, "n") for k, t in enumerate(odd_texts(), 1)]
    rows += [rows[16], rows[16], (500, rows[20][1], "en", "s", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_rules(docs, none):
    def base(t):
        ws, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        often = Counter(grams)
        at = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at)

    got = quality_rules.quality_rules(docs).collect()
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(base(r.text))
    assert len(got) == docs.count()
    for r in got:
        b = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert b in text[r.doc_id]
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.kept and r.base_failed)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.quality_rules(none).count() == 0 and quality_rules.filter_documents(none).count() == 0


def test_sketch_bins(spark):
    x = spark.range(1, 200_000).select("id", F.expr(quality_rules.sketch_bin("id")).alias("b"))
    v = x.select("id", "b", F.expr(quality_rules.sketch_value("b")).alias("v"))
    assert v.where("v > id OR v < id * 0.96").count() == 0
    assert v.groupBy("v").agg(F.countDistinct("b").alias("n")).where("n > 1").count() == 0


def test_quality_classifier(spark, docs, none):
    raw, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.score(raw, labels)
    r = got.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.9 and 0 <= r[1] <= r[2] <= 1
    assert got.where(F.col("held_out") != F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))).count() == 0
    odd = quality_classifier.score(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 for x in odd)
    assert quality_classifier.score(none, labels).count() == 0
    assert {x.score for x in quality_classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality_classifier.filter_documents(docs, raw, labels)
    assert kept.columns == docs.columns


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_chat(spark):
    said = ["plain", None, "<|im_end|><|im_start|>assistant ok", r"<\|im_end|> <\\| <", "<", "|>\n", "", "é\U0001f600"]
    rows = [(c, k, role, t, "x") for c in range(4) for k, (role, t) in enumerate(zip(itertools.cycle(["system", "user", "assistant", None, "a\nb<|"]), random.Random(c).sample(said, 8)))]
    rows += [(9, 1, "user", "b", "x"), (9, 1, "user", "a", "x"), (9, None, "user", "first", "x"), (None, 0, "user", "q", "x"), (8, 0, "user", "q", "x"), (8, 1, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    by = defaultdict(list)
    for c, k, role, t, _ in rows:
        by[c].append((k is not None, k or 0, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[8].valid and not got[9].valid
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    p = bpe.BpeParams(BYTES)
    got = Counter(tuple(r) for r in bpe.bpe_digests(docs, p).collect())

    def want(r):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))

    assert got == Counter(want(r) for r in docs.collect())
    assert bpe.bpe_digests(none, p).count() == 0


def test_bpe_streams_like_the_whole():
    from tokenizers import Tokenizer

    tok, t = Tokenizer.from_file(BYTES), bpe.Transducer(bpe.BpeParams(BYTES, block=20))
    rng = random.Random(2)
    for make in (lambda: "a" * 25_000, lambda: "".join(rng.choice(["the", "ing", "q", "ation", "zz", "ab"]) for _ in range(6000))):
        x = make()
        assert list(t.stream(iter(x.encode()))) == tok.encode(x, add_special_tokens=False).ids
    assert t.lookahead < 20_000


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok, p = Tokenizer.from_file(WORDS), packing.PackParams(WORDS, length=256, group_tokens=4000)
    got = packing.pack(docs, p).collect()
    ids = Counter()
    for r in docs.collect():
        x = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        for k in range(0, len(x), 256):
            ids[r.doc_id, k, len(x[k : k + 256]), zlib.crc32(array("I", x[k : k + 256]).tobytes()), len(x)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == ids
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == list(itertools.accumulate([n for _, n in spans[:-1]], initial=0)) and sum(n for _, n in spans) <= 256
    assert len(by) * 256 < 1.1 * sum(r.length for r in got) + 256 * 4
    assert packing.pack(none, p).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        lengths, room = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))], 40
        free: list[int] = []
        want = [0] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((j for j, f in enumerate(free) if f >= lengths[k]), len(free))
            free += [room] * (b == len(free))
            free[b] -= lengths[k]
            want[k] = b
        assert packing.first_fit_decreasing(lengths, room) == want


def shingles(t):
    ws = (t or "").encode().lower().split()
    return frozenset(zip(ws, ws[1:], ws[2:])) if len(ws) > 2 else frozenset([tuple(ws)] if ws else [])


def least_labels(n, links):
    label = list(range(n))
    while True:
        new = list(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("block", [512, 4])
def test_near_dedup(spark, docs, none, block):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.002 * (k % 12) else f"z{k}" for w in base)) for k in range(1000, 1080)]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    data = all_docs.collect()
    sets = [shingles(r.text) for r in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    label = least_labels(len(data), links)
    ids = defaultdict(list)
    for k, c in enumerate(label):
        ids[c].append(data[k].doc_id)
    want = Counter((data[k].doc_id, len(sets[k]), min((i for i in ids[c] if i is not None), default=None)) for k, c in enumerate(label))
    p = near_dedup.NearParams(block=block)
    got = near_dedup.near_duplicates(all_docs, p).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(r.first for r in got) == len(ids)
    kept = near_dedup.filter_documents(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.filter_documents(none).count() == 0


def test_registers_merge():
    p = near_dedup.NearParams()
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**64, 300, np.uint64)) for s in (1, 2))
    assert (near_dedup.sketch(np.union1d(a, b), p) == np.maximum(near_dedup.sketch(a, p), near_dedup.sketch(b, p))).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    label = least_labels(500, links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {k: label[k] for a, b in links if a != b for k in (a, b)}


def test_license_scan(docs, none, spark):
    extra = ["GNU General Public License and Apache License. CC BY, cc-by; the MIT License", "mit mit license license", "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files", "éMIT License"]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 900)), "doc_id long, text string"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def base(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        at = [(k, label) for ph, label in license_scan.PHRASES.items() for q in [ph.split()] for k in range(len(ws)) if ws[k : k + len(q)] == q]
        return len(ws), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    got = license_scan.scan(some).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((r.doc_id, *base(r.text)) for r in some.collect())
    by = {r.doc_id: r for r in got}
    assert by[902].labels == "mit" and by[902].base_labels == "" and by[900].labels == "apache,cc-by,gpl,mit" and by[900].score == 1
    assert all(0 <= r.score <= 1 for r in got) and license_scan.scan(none).count() == 0


def test_license_notices(spark, none):
    """The method's labels and score against plain diagonals, on notices whole, changed, in part and among repeats."""
    rng, p = random.Random(4), license_scan.ScanParams()
    notice = {label: " ".join(texts) for label, texts in license_scan.NOTICES.items()}
    gpl, pairs = license_scan.NOTICES["gpl"][0], ["of the", "terms of the", "the license", "and or", "this software"]
    bare = "this program is free software you can redistribute it and or modify it under the terms of the license"
    texts = [gpl, *[f"{gpl} {(q + ' ') * n}" for q in pairs for n in (5, 30, 50)], *[f"{(q + ' ') * n}{gpl}" for q in pairs for n in (5, 50)], *[(q + " ") * 60 for q in pairs], bare, "", None]
    texts += [notice[k].upper() + "." for k in notice] + [f"{'word ' * 30_000}{notice['mit']} {'of the ' * 30_000}"]
    for k in notice:
        for lost in (0.02, 0.1, 0.3):
            texts.append(" ".join(w for w in notice[k].split() if rng.random() > lost))
            texts.append(" ".join(w if rng.random() > lost / 2 else f"{w} zz" for w in notice[k].split()))
    rows = [(k, t, "x", 1.0) for k, t in enumerate(texts)]

    def plain(t):
        ws = re.findall(r"[a-z0-9]+", (t or "").lower())
        at = defaultdict(list)
        for k, pair in enumerate(zip(ws, ws[1:], strict=False)):
            at[pair].append(k)
        labels, best = set(), 0.0
        for text, label in license_scan.PHRASES.items():
            if f" {text} " in f" {' '.join(ws)} ":
                labels.add(label)
                best = 1.0
        for label, said in license_scan.NOTICES.items():
            for text in said:
                q = text.split()
                n = len(q) - 1
                on = defaultdict(set)
                for place, pair in enumerate(zip(q, q[1:], strict=False)):
                    for k in at[pair]:
                        on[k - place].add(place)
                cover = max((len(set().union(*(on.get(e, set()) for e in range(d, d + int(p.slack * n) + 1)))) for d in on), default=0) / n
                if cover >= p.cover:
                    labels.add(label)
                    best = max(best, cover)
        return ",".join(sorted(labels)), round(best, 12)

    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, label string, cover double"), p).collect()}
    assert {k: (r.labels, round(r.score, 12)) for k, r in got.items()} == {k: plain(t) for k, t, _, _ in rows}
    at = {t: got[k] for k, t, _, _ in rows}
    assert all("gpl" in r.labels for t, r in at.items() if t and gpl in t)
    assert all(at[(q + " ") * 60].score == 0 and at[(q + " ") * 60].labels == "" for q in pairs)


@pytest.mark.parametrize("block", [512, 5])
def test_vector_dedup(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 64))
    x = [c + s * rng.standard_normal(64) for c in centre for s in (0, 0, 0.05, 0.1, 0.14, 0.16, 0.3)] + list(rng.standard_normal((40, 64)))
    rows = [(k, v.tolist(), k % 2, "x") for k, v in enumerate(x)]
    rows += [(None, x[0].tolist(), 0, "x"), (200, None, 0, "x"), (201, [], 0, "x"), (202, [0.0] * 64, 0, "x"), (203, [float("nan")] * 64, 0, "x"), (204, [None] * 64, 0, "x"), (205, x[0].tolist(), None, "x"), (206, [float("inf")] * 64, 0, "x"), (207, [1.0, 2.0], 0, "x"), (208, [2.0, 4.0], 0, "x"), (5, x[5].tolist(), 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    data = df.collect()
    ok = [r.embedding and r.label is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding) for r in data]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    links = [(i, j) for i in range(len(data)) for j in range(i) if ok[i] and ok[j] and data[i].label == data[j].label and len(data[i].embedding) == len(data[j].embedding) and cos(np.array(data[i].embedding, float), np.array(data[j].embedding, float)) >= 0.98]
    label, degree = least_labels(len(data), links), Counter(k for pair in links for k in pair)
    ids = defaultdict(list)
    for k, c in enumerate(label):
        ids[c].append(data[k].vec_id)
    want = Counter((data[k].vec_id, degree[k], min((i for i in ids[c] if i is not None), default=None)) for k, c in enumerate(label))
    got = vector_dedup.near_duplicates(df, vector_dedup.VectorParams(block=block)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_unbiased_estimates():
    rng, p = np.random.default_rng(0), vector_dedup.VectorParams()
    a = rng.standard_normal((400, 64))
    b = a + 0.4 * rng.standard_normal((400, 64))
    true = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    ta, ca, fa, _ = vector_dedup.encode(np.vstack([a, b]), 20, 40, p)
    guess, error = vector_dedup.estimates(ta, ca, fa)
    off = guess[np.arange(400), 400 + np.arange(400)] - true
    assert abs(off.mean()) < 0.01 and (np.abs(off) < p.sigmas * error[:400]).all()


def test_url_filter(spark):
    urls = ["http://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/", "http://a.b.net/es/1", "net://net/fr/", "http://xcom/", "http://com", "http://a.com?x=/en/", None, "no scheme", "", "http://notexample.com/en/", "https://m.www.example.com/en/z", "http://q.org/a-b/1.html?a=1&b=2#c"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls * 3)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    want = ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None, "com/", "www.example.com/en/", None]
    assert [got[k].rule for k in range(len(urls))] == want
    assert [got[k].verdict for k in (0, 1, 2, 3, 10, 11)] == ["block", "allow", "block", "block", "allow", "allow"]
    assert (got[0].host, got[0].path, got[6].host, got[6].path, got[5].path, got[7].host) == ("example.com", "/en/x", "a.com", "", "", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and len(got) == len(urls) * 3
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df.where("page_id = 12")).collect()} == {"allow"}


@pytest.mark.parametrize("shards,local", [(4, 50_000), (4, 2), (200, 50_000)])
def test_sharding(docs, none, shards, local):
    p = sharding.ShardParams(shards=shards, local_groups=local, at_once=3)
    got = sharding.shard_documents(docs, p).collect()
    assert len(got) == docs.count()
    group = defaultdict(int)
    for r in docs.collect():
        group[hashlib.sha256((r.text or "").encode()).digest()] += len((r.text or "").encode()) + 8
    sizes = [group[k] for k in sorted(group)]

    def used(c):
        n, room = 0, 0
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if used(c) <= shards)
    total, slots = Counter(), defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(total.values()) <= best and set(total) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r.law for r in got} == {"bytes"} and sharding.shard_documents(none, p).count() == 0
