"""Golden numbers and brute-force versions of the library's operators."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import binding as B
from plumbline.functions import pysource
from plumbline.functions import selection as S
from plumbline.functions.expressions import two_sided_binomial
from plumbline.operators import attempts as A
from plumbline.operators import paired as P
from plumbline.operators import splits

#: Published discordant counts and p-values.
PUBLISHED = [(125, 38, 4.96e-12), (56, 9, 2.05e-9), (71, 22, 3.48e-7), (23, 6, 0.00232), (21, 9, 0.0428), (7, 5, 0.774), (4, 1, 0.375), (0, 0, 1.0)]


def test_exact_tail(spark):
    rows = spark.createDataFrame(PUBLISHED, "w int, x int, p double").select("p", two_sided_binomial(F.col("w"), F.col("x")).alias("got")).collect()
    for r in rows:
        assert r.got == pytest.approx(r.p, rel=5e-3)


def test_required_discordant(spark):
    ratios = spark.createDataFrame([(0.8,), (0.75,), (0.7,)], "ratio double")
    assert {r.ratio: r.required for r in P.required_discordant(ratios).collect()} == {0.8: 12, 0.75: 17, 0.7: 25}


def test_paired_pilot(spark):
    """Twelve pairs as (baseline, attempts), (assisted, attempts)."""
    pairs = [(1, 2, 1, 1)] * 2 + [(1, 1, 1, 1), (1, 2, 1, 2)] + [(0, 2, 1, 1)] * 4 + [(1, 1, 0, 2)] + [(0, 2, 0, 2)] * 3
    rows = [(k, "f", bool(b), bool(a), bn, an, bool(b) and bn == 1, bool(a) and an == 1) for k, (b, bn, a, an) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "task_id int, source string, b_ok boolean, a_ok boolean, b_attempts long, a_attempts long, b_first boolean, a_first boolean")
    r = P.exact_tests(P.summarize(df)).first()
    assert (r.baseline_successes, r.assisted_successes, r.baseline_first_pass, r.assisted_first_pass) == (5, 8, 2, 7)
    assert (r.both, r.assisted_only, r.baseline_only, r.neither) == (4, 4, 1, 3)
    assert (r.mcnemar_p, r.sign_p) == (pytest.approx(0.375), pytest.approx(0.5))
    b = P.bootstrap_paired(df, samples=20).first()  # one source: every resample is the sample
    assert b.lower == b.upper == pytest.approx(b.estimate) and b.samples == 20


@pytest.mark.parametrize("text,index", [("3", 2), ("candidate 3", 2), (" Candidate 3: ", 2), ("3)", 2), ("3.", 2), ("three", None), ("5", None), ("0", None), ("3 4", None), ("", None), ("99999999999", None)])
def test_candidate_index(spark, text, index):
    assert spark.createDataFrame([(text,)], "t string").select(S.candidate_index(F.col("t"), F.lit(4))).first()[0] == index


def test_ranked_memory_replay(spark):
    """Ranking 1, 3, 2, 4, answer 3, the fourth not allowed: the second turn gets the right recommendation."""
    rows = [(1, "a", n, o) for n, o in ((1, "1"), (2, "1"), (3, "3"), (4, "3"))]
    df = spark.createDataFrame(rows, "task_id long, arm string, attempt_no int, output string").withColumns({
        "task": F.lit(S.SUPPORTED_TASKS[0]), "n_candidates": F.lit(4), "answer_index": F.lit(2), "ranking": F.array(*map(F.lit, (0, 2, 1, 3))), "allowed": F.array(*map(F.lit, (True, True, True, False)))})
    got = A.replay(df, ranking="ranking", allowed="allowed").orderBy("attempt_no").collect()
    assert [r.reason for r in got] == ["wrong_selection", "rejected_candidate", "ok"]
    assert [r.recommendation for r in got] == [0, 2, 2]
    assert A.replay(df, max_attempts=2).count() == 2


def binds(p, s, drop=False):
    """The binding rules, one step at a time."""
    only, either = list(p["positional_only"]), list(p["positional_or_keyword"])
    if drop:
        (only or either or [None]).pop(0)
    pos = only + either
    filled = [] if s["starred"] else pos[: s["positional"]]
    if s["positional"] > len(pos) and not p["has_vararg"]:
        return False
    for k in s["keywords"]:
        if k in only or k in filled or not (k in either or k in p["keyword_only"] or p["has_kwarg"]):
            return False
    for r in p["required"]:
        if r in filled or r in s["keywords"]:
            continue
        if r in pos and not (s["starred"] or r in either and s["double_starred"]):
            return False
        if r not in pos and r in p["keyword_only"] and not s["double_starred"]:
            return False
    return True


def test_bindable_is_the_rules(spark):
    rng, rows = random.Random(3), []
    for _ in range(1500):
        names = rng.sample("abcdefg", 6)
        i, j, k = sorted(rng.choices(range(7), k=3))
        p = {"positional_only": names[:i], "positional_or_keyword": names[i:j], "keyword_only": names[j:k], "has_vararg": rng.random() < 0.3, "has_kwarg": rng.random() < 0.3}
        p["required"] = [n for n in names[:k] if rng.random() < 0.5]
        s = {"positional": rng.randrange(5), "keywords": rng.sample("abcdefgh", rng.randrange(3)), "starred": rng.random() < 0.2, "double_starred": rng.random() < 0.2, "receiver": rng.random() < 0.5}
        rows.append((p, [s], binds(p, s) or s["receiver"] and binds(p, s, True)))
    df = spark.createDataFrame(rows, f"p {B.PARAMETERS}, s array<{B.SHAPE}>, want boolean")
    assert df.where(B.bindable(F.col("p"), F.col("s")) != F.col("want")).count() == 0
    assert df.limit(1).select(B.allowed(F.lit(None).cast(B.PARAMETERS), F.col("s"))).first()[0]


def test_balanced_split():
    sizes = [20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
    groups = [(f"s{k}", n, f"{k:016x}") for k, n in enumerate(sizes)]
    got = splits.assign_balanced(groups, {"train": 93 * 0.7, "validation": 93 * 0.15, "test": 93 * 0.15})
    filled = {s: sum(n for g, n, _ in groups if got[g] == s) for s in splits.SPLITS}
    assert set(got) == {g[0] for g in groups} and all(filled.values())
    assert abs(filled["train"] - 65.1) <= 20 and abs(filled["validation"] - 13.95) <= 20
    with pytest.raises(ValueError):
        splits.assign_balanced(groups[:2], {"train": 5, "validation": 5, "test": 5})


def test_hex_threshold():
    for f in (0.8, 0.8 + 0.1, 0.5, 1 / 3):
        t = int(splits.hex_threshold(f), 16)
        assert t / 2**64 >= f > (t - 1) / 2**64 or (t - 1) / 2**64 < f


def test_facts():
    text = "import os\nfrom a import b as c\ndef f(x, /, y, *, z=1): return g(x)\nasync def g(a): \n    def inner(): return f(1)\n    return c(a)\nclass K:\n    def m(self): return self.n()\n    def n(self): pass\n"
    rows = pysource.facts(text)
    assert [r["signature"] for r in rows if r["kind"] == "symbol"] == ["f(x, /, y, *, z)", "g(a)"]
    assert [(r["name"], r["callee"]) for r in rows if r["kind"] == "call" and not r["nested"]] == [("f", "g"), ("g", "c")]
    assert ("g", "f") in [(r["name"], r["callee"]) for r in rows if r["kind"] == "call" and r["nested"]]
    assert [(r["name"], r["callee"]) for r in rows if r["kind"] == "method_call"] == [("m", "n")]
    assert pysource.masked("def f(): return g('g')\n", "f", "g") is None
    assert pysource.candidate_parameters("p.py::f(a, b)\ndef f(a, b=1):\n    ret")["required"] == ["a"]
    assert pysource.candidate_parameters("f(a, b)\ndef f(a, b")["required"] == []


@pytest.mark.parametrize("text,want", [("```python\nx = 1\n```", "x = 1"), (" y ", "y"), ("```\n```", ""), ("a ```b```", "a ```b```")])
def test_unfenced(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.unfenced(F.col("t"))).first()[0] == want
