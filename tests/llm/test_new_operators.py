"""Fill-in-the-middle, spelling variants and token id files against plain versions, and their odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import fill_middle, oracles, queries, spelling, token_ids
from plumbline.llm.fill_middle import FimParams, SkipList
from plumbline.llm.spelling import SpellingParams
from plumbline.llm.token_ids import TokenParams

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "a"), (5, "\n\n x\r\n  y\n"), (None, "none has an id here"), (None, None), (6, "glück Àÿ\U0001f642 é 　wide"), (7, "twice the same words"), (7, "twice the same words"),
    (8, "with <P> a mark"), (9, "ends of text <|endoftext|> inside<|endoftext|>"), (10, "word " * 60_000 + "énd"), (11, "x" * 70_000), (12, " leading"), (13, "trailing "), (14, "it's we'll I'd '' 's"),
]


def odd_docs(spark):
    rows = [(i, t, "en", "x", "y", 0, 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, `row` string, n int, seq double")


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_spelling_variants"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(oracles.ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*cols).collect())


# fill-in-the-middle


@pytest.mark.parametrize("unit", [None, r"\w+\s*", r"[^\n]*\n?", ".", "q"])
@pytest.mark.parametrize("fan", [2, 32])
def test_skip_list_finds_every_rank(unit, fan):
    r = random.Random(7)
    for n in (0, 1, 2, 90, 3000, 150_000):
        text = "".join(r.choices("ab é\n\U0001f642\r", k=n))
        if unit is None:
            starts = list(range(n))
        else:
            starts = [m.start() for m in re.finditer(unit, text, re.S) if m.end() > m.start()]
            starts = [0, *starts[1:]] if text else []
        units = SkipList(text, FimParams(unit=unit, fan=fan))
        assert (units.units, units.chars) == (len(starts), n)
        starts.append(n)
        for k in {0, len(starts) - 1} | {r.randrange(len(starts)) for _ in range(100)}:
            assert units.find(k) == starts[k]
        with pytest.raises(IndexError):
            units.find(len(starts))


def test_lanes_thin_out():
    lanes = SkipList("x" * 1_000_000, FimParams()).lanes
    assert len(lanes) >= 4 and len(lanes[-1][0]) < 1_000_000 / 25 and all(len(a[0]) < len(b[0]) for a, b in zip(lanes, lanes[1:], strict=False))


def plain_fim(doc_id, text):
    """The contract's words, without a list."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_odd_rows(spark):
    rows = fill_middle.fill_in_middle(odd_docs(spark))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows.collect())
    assert got == Counter((i, *plain_fim(i, t or "")) for i, t in ODD)
    back = rows.select("doc_id", fill_middle.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in ODD)
    assert fill_middle.digests(fill_middle.fill_in_middle(odd_docs(spark).limit(0))).collect() == []


def test_fim_forms_and_tricky_marks(spark):
    """All forms occur, and parts that end or begin like marks are restored."""
    texts = [(k, random.Random(k).choice(["<<P", "S>>", "<", "P><S", "M>"]) * 9 + str(k)) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = fill_middle.fill_in_middle(docs)
    assert {r.doc_id: r[1:] for r in rows.collect()} == {i: plain_fim(i, t) for i, t in texts}
    assert {r.form for r in rows.collect()} == {"plain", "psm", "spm"}
    assert {r.doc_id: r.t for r in rows.select("doc_id", fill_middle.restored(F.col("form"), F.col("output")).alias("t")).collect()} == dict(texts)
    words = FimParams(unit=r"\S+\s*", plain=0, marks=("[a]", "[b]", "[c]"))
    docs = spark.createDataFrame([(k, "one two  three\nfour") for k in range(30)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(docs, words).collect():
        assert r.n == 4 and r.prefix_chars in (0, 4, 9, 15, 19) and r.prefix_chars + r.middle_chars in (0, 4, 9, 15, 19)
    with pytest.raises(ValueError):
        FimParams(marks=("<P>", "><", "<M>"))


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain_variants(docs, p=SpellingParams()):
    seen = Counter()
    for i, text in docs:
        for run in re.findall(f"[{p.letters}]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return plain_forms({w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}, p)


def plain_forms(v, p=SpellingParams()):
    forms, out = {}, {}
    for w, n in v.items():
        others = [x for x in v if near(w, x)]
        best = min(others, key=lambda x: (-v[x], x), default=None)
        forms[w] = (best if best and v[best] >= p.ratio * n else None, len(others))
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out[w] = (form, root, v[w], n_near, v[form] if form else None)
    return out


def found(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def made_words(alphabet, lengths, count, seed):
    r = random.Random(seed)
    base = ["".join(r.choices(alphabet, k=r.randint(*lengths))) for _ in range(count)]
    for w in list(base):
        at, kind = r.randrange(len(w)), r.randrange(3)
        base.append(w[:at] + (r.choice(alphabet) if kind else "") + w[at + (kind != 1) :])
    return {w: r.choice([2, 2, 3, 20, 30, 400, 5000]) for w in base if len(w) >= 7}


@pytest.mark.parametrize(
    "words, p",
    [
        (made_words("ab", (7, 10), 300, 1), SpellingParams()),
        (made_words("abé", (7, 9), 500, 2), SpellingParams(group_rows=8)),
        (made_words("ab", (30, 60), 100, 3), SpellingParams(parts=4, group_rows=3)),
        (made_words("ab", (7, 8), 200, 4), SpellingParams(width=7, group_rows=10, parts=3)),
        (made_words("abcd", (7, 9), 600, 5), SpellingParams(width=4, group_chars=40)),
    ],
)
def test_near_words_by_hand(spark, words, p):
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), p).collect()
    want = {}
    for w in words:
        if others := [x for x in words if near(w, x)]:
            want[w] = (len(others), *min((-words[x], x) for x in others))
    assert {r.word: (r.n_near, r.best.less, r.best.word) for r in got} == want and len(got) == len(want)


def test_one_large_group_is_dealt_again(spark):
    """A third of all words share half their letters; a chain of forms leads to one root; counts tie."""
    r = random.Random(9)
    words = {"common" + "".join(r.choices("abcdefgh", k=4)): r.choice([2, 2, 25]) for _ in range(1500)}
    words |= {"variants": 5000, "variantss": 500, "variantsss": 50, "variantssss": 5, "xvariants": 5000, "variantsz": 500}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    p = SpellingParams(group_rows=100)
    best = {r.word: (r.n_near, r.best) for r in spelling.near_words(table, p).collect()}
    want = plain_forms(words)
    assert all(best.get(w, (0,))[0] == x[3] for w, x in want.items())
    forms = spark.createDataFrame([(w, x[0]) for w, x in want.items() if x[0]], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms, 5000).collect()} == {w: x[1] for w, x in want.items() if x[0]}
    assert want["variantssss"][1] == "variants"


def test_variants_odd_rows(spark):
    said = "Wherever wherever whereever WHEREVER " * 12 + "wherevr wherevr straßenbahn straßenbahm "
    long = "q" * 5000
    docs = [*ODD, (20, said), (21, said), (21, said), (None, said), (22, f"{long} {long} {long}z {long}z " * 11), (23, "Éclairs éclairs Éclairs éclairs a×b÷cde a×b÷cde"), (24, "short")]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert found(spelling.variants(table)) == plain_variants(docs)
    assert found(spelling.variants(table.limit(0))) == {} and found(spelling.variants(table.where("doc_id = 24"))) == {}


def test_hot_word_and_no_pairs(spark):
    """One word holds most occurrences; what leaves a group is one row for each word."""
    docs = spark.createDataFrame([(k, "overwhelming " * 50 + f"overwhelmin{'abcdefgh'[k % 8]} ") for k in range(400)], "doc_id long, text string")
    got = found(spelling.variants(docs))
    assert got == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


# token id files


def plain_ids(rows, end=0):
    t = Tokenizer.from_file(BYTES)
    t.no_padding()
    t.no_truncation()
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in rows]


def test_ranks_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 8, 1001):
        ranks = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 33, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_ids.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in ranks)
        assert (token_ids.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()
    content = token_ids.pack_file([None, 0, -5], [2, 0, 1], np.array([0, 300, 70_000], np.uint32))
    ids, sizes, ranks = token_ids.unpack_file(content)
    assert ids == [None, 0, -5] and sizes.tolist() == [2, 0, 1] and ranks.tolist() == [0, 300, 70_000] and len(content) == 40 + 3 * 17 + 1 + 6
    with pytest.raises(ValueError):
        token_ids.unpack_file(content[:-1] + b"\xff")
    with pytest.raises(ValueError):
        token_ids.unpack_file(content[:-1])


@pytest.mark.parametrize("file_ids", [50, 2_000_000])
def test_token_files_odd_rows(spark, file_ids):
    p = TokenParams(BYTES, file_ids=file_ids, cached=20)
    folder = token_ids.write_tokens(odd_docs(spark), p)
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_ids.read_tokens(spark, folder).collect()), key=lambda x: x[0])
    assert Counter((i, tuple(x)) for _, i, x in got) == Counter((i, tuple(x)) for i, x in plain_ids(ODD))
    assert [(i is not None, i or 0) for _, i, _ in got] == sorted((i is not None, i or 0) for i, _ in ODD)
    upto = 0
    for start, _, ids in got:
        assert start == upto
        upto += len(ids)
    fs, path = token_ids.file_system(folder)
    order = np.frombuffer(fs.open_input_stream(f"{path}/order").read(), "<u4")
    counts = Counter(i for _, _, x in got for i in x)
    assert order[: len(counts)].tolist() == sorted(counts, key=lambda i: (-counts[i], i)) and sorted(order.tolist()) == list(range(50_257))
    # files that no manifest names, as a lost attempt leaves them, are not read
    with fs.open_output_stream(f"{path}/lost.ids") as f:
        f.write(b"half a file")
    assert token_ids.read_tokens(spark, folder).count() == len(ODD)


def test_token_query_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, start = {}, 0
    for i, ids in plain_ids(sorted((r.doc_id, r.text) for r in docs)):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op13_token_ids(spark, SF).collect()} == want


def test_token_words_like_the_library():
    r = random.Random(5)
    parts = [" ", " ", " ", "\n", "  ", "\t", "　", "\x1c", "'s", "'", "é", "é", "12", "<|endoftext|>", "<|", "\U0001f642", "foo", "Bar", "中文", "-", "\x85", "​"]
    t, whole = token_ids.Tokens(TokenParams(BYTES, cached=30)), Tokenizer.from_file(BYTES)
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert np.frombuffer(t.ids(text), "<u2").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_each_word_of_many_texts_goes_to_the_library_once():
    """However little is remembered: the different words of texts that come together are looked up once, not text by text."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdeé", k=6)) + r.choice(["", "", ".", "'s", "\u4e2d", "7"]) for _ in range(300)]
    texts = ["".join(r.choice(words) + r.choice("   \n") for _ in range(60)).strip() for _ in range(200)]
    texts[7:9] = ["", "two  blanks <|endoftext|>"]
    t, whole, learnt = token_ids.Tokens(TokenParams(BYTES, cached=10)), Tokenizer.from_file(BYTES), []
    letters, others = t.letters, t.others
    t.letters = lambda w: learnt.append(w) or letters(w)
    t.others = lambda ws: learnt.extend(ws) or others(ws)
    assert [np.frombuffer(x, "<u2").tolist() for x in t.many(texts)] == [[*whole.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert len(learnt) <= 2 * len(words) + 10  # behind a blank, at the start of a line, and those of the odd text


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_ids.read_tokens(spark, token_ids.write_tokens(docs, TokenParams(BYTES))).collect() == []
