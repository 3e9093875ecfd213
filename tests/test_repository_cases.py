"""A small repository with the cases that template files lack: hidden aliases, stars, relative imports, doubled names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import pysource
from plumbline.functions import texts as X
from plumbline.functions.selection import stripped
from plumbline.operators import paired as P
from plumbline.operators import pools as N
from plumbline.operators import ranking as R
from plumbline.operators import repairs
from plumbline.operators import splits
from plumbline.operators import tasks as T
from plumbline.plans import arguments as G
from plumbline.sources import files as S

FILES = {
    "pkg/util.py": "def load(path):\n    return path\n\ndef save(path, data=None):\n    return data\n\ndef twice(a):\n    return a\n\ndef twice(b):\n    return b\n",
    "pkg/__init__.py": "def boot(x):\n    return x\n",
    "pkg/sub/deep.py": "from ..util import load as fetch\nfrom . import near\nfrom .near import close\n\ndef go(p):\n    return fetch(p)\n\ndef other(p):\n    return close(p)\n",
    "pkg/sub/near.py": "def close(p):\n    return p\n",
    "app.py": (
        "from pkg.util import *\nfrom pkg.util import load, save as keep\nfrom pkg.util import twice\nfrom pkg import boot\nfrom missing import gone\nimport pkg.sub.near\n\n"
        "SEEN = keep(1)\n\ndef load(x):\n    return x\n\ndef first(a):\n    return keep(a)\n\ndef second(a):\n    return load(a)\n\ndef third(a):\n    return twice(a)\n\n"
        "def fourth(a):\n    def inner():\n        return first(a)\n    return boot(inner())\n\ndef fifth(a):\n    return gone(a)\n\n"
        "class Box:\n    def one(self):\n        return Box.two(self)\n    def two(self):\n        return self.one() and cls.two()\n    @classmethod\n    def three(cls):\n        return cls.two(1)\n    @property\n    def four(self):\n        return self.two()\n"
        "    def doubled(self):\n        return 1\n    def doubled(self):\n        return 2\n"
    ),
    "src/lib.py": "def a(x):\n    return x\n",
    "lib.py": "def a(x):\n    return x\n",
    "uses.py": "from lib import a\n\ndef u(x):\n    return a(x)\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = spark.createDataFrame([("n", p, t) for p, t in FILES.items()], "namespace string, path string, content string")
    return S.readable(S.extract(rows)).cache()


@pytest.fixture(scope="module")
def parts(facts):
    symbols, calls, imports, reads = S.symbols(facts), S.calls(facts), S.imports(facts), S.name_reads(facts)
    return symbols, calls, imports, reads, T.imported_symbols(imports, symbols).cache()


def test_modules_and_aliases(parts):
    symbols, _, _, _, imported = parts
    # lib is found below two roots, twice stands twice in its file, missing is no file, near has no function of that name
    got = {(r.path, r.alias, r.target_path, r.name) for r in imported.collect()}
    assert got == {
        ("app.py", "load", "pkg/util.py", "load"), ("app.py", "keep", "pkg/util.py", "save"), ("app.py", "boot", "pkg/__init__.py", "boot"),
        ("pkg/sub/deep.py", "fetch", "pkg/util.py", "load"), ("pkg/sub/deep.py", "close", "pkg/sub/near.py", "close"),
    }
    assert {r.alias for r in T.unshadowed(imported, symbols).collect()} == {"keep", "boot", "fetch", "close"}


def test_edges(parts):
    symbols, calls, _, _, imported = parts
    got = {(r.path, r.caller, r.alias, r.target) for r in T.cross_file_edges(calls, imported, symbols).collect()}
    assert got == {("app.py", "first", "keep", "save"), ("app.py", "fourth", "boot", "boot"), ("pkg/sub/deep.py", "go", "fetch", "load"), ("pkg/sub/deep.py", "other", "close", "close")}
    own = {(r.caller, r.target) for r in T.single_target_callers(symbols, calls).collect()}
    assert own == {("second", "load")}


def test_nested_calls(facts):
    got = {(r.caller, r.target) for r in T.single_target_callers(S.symbols(facts), S.calls(facts, nested=True)).collect()}
    assert got == {("second", "load"), ("fourth", "first")}


def test_methods(facts):
    assert {(r.name, r.binding) for r in S.methods(facts).collect()} == {("one", "instance"), ("two", "instance"), ("three", "class")}
    assert {(r.caller, r.callee) for r in S.method_calls(facts).collect()} == {("one", "two"), ("two", "one"), ("three", "two")}


def test_reads_and_neighbourhoods(parts):
    symbols, calls, imports, reads, imported = parts
    tasks = T.with_task(T.cross_file_edges(calls, imported, symbols), "namespace", "path", "caller").cache()
    assert {(r.caller, r.alias) for r in T.read_outside(imported, reads, tasks).where("path = 'app.py'").collect()} >= {("first", "boot"), ("first", "keep"), ("fourth", "keep"), ("first", "load")}
    of = {r.task_id: r.caller for r in tasks.collect()}
    near = lambda v, hide=True: T.neighbourhood_files(tasks, imports, symbols, imported, reads, v, hide_target=hide)
    wide, strict = near("alias"), near("independent")
    files = lambda df: {(of[r.task_id], r.npath) for r in df.collect()}
    assert {("first", "pkg/util.py"), ("first", "pkg/__init__.py"), ("first", "pkg/sub/near.py"), ("fourth", "pkg/util.py")} <= files(wide)
    assert ("go", "pkg/util.py") not in files(wide) and ("go", "pkg/sub/near.py") in files(wide)
    assert files(strict) <= files(wide) and T.beyond(strict, wide).count() == 0 and T.beyond(wide, strict).count() > 0


def test_masked_decisions_and_texts(spark, facts, parts):
    symbols, calls, *_ = parts
    files = spark.createDataFrame([("n", p, t) for p, t in FILES.items()], "namespace string, path string, content string")
    edges = T.single_target_callers(symbols, calls)
    contexts = S.masked(edges.join(files, ["namespace", "path"]))
    got = T.masked_call_decisions(symbols, edges, contexts, 4).collect()
    assert len(got) == 4 and sum(r.is_target for r in got) == 1 and all(r.candidate.startswith(f"{r.cpath}::{r.signature}\ndef {r.name}(") for r in got)
    assert next(r for r in got if r.is_target).candidate == "app.py::load(x)\ndef load(x):\n    return x"


def test_targets_by_rendering(spark, parts):
    symbols, *_, imported = parts
    texts = symbols.withColumn("text", T.render(F.col("signature"), F.col("body"), 768))
    wanted = spark.createDataFrame([(1, "n", "app.py", "save(path, data)\ndef save(path, data=None):\n    return data"), (2, "n", "app.py", "nothing"), (3, "n", "uses.py", "a(x)\ndef a(x):\n    return x")], "task_id int, namespace string, path string, text string")
    assert [(r.task_id, r.alias) for r in T.target_aliases(wanted, imported, texts).collect()] == [(1, "keep")]
    pool = texts.select(F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("task_id"), F.concat_ws(":", "path", "name").alias("ord"), F.concat_ws(":", "path", "name").alias("sym_id"), "text")
    assert {r.task_id: r.sym_id for r in T.target_in_pool(wanted, pool).collect()} == {1: "pkg/util.py:save", 3: "lib.py:a"}
    wrong = spark.createDataFrame([(1, "nothing"), (1, "a(x)\ndef a(x):\n    return x"), (2, "no")], "task_id int, text string")
    assert {r.task_id: r.n for r in T.negatives_in_scope(wrong, pool.select("task_id", "text")).collect()} == {1: 1, 2: 0}


def test_task_census(spark):
    # 1: two members share the target's rendering; 2: the target alone binds; 3: not in scope; 4: nothing in any pool
    protocol = spark.createDataFrame([(t, h, h == "t") for t in (1, 2, 3, 4) for h in ("t", "w")] + [(1, "w", False)], "task_id int, rendering_hash string, is_target boolean")
    scope = [(1, 1, "t", 7, True, "local", True), (1, 2, "t", 8, True, "imported", False), (1, 3, "w", 7, False, "local", True), (2, 1, "t", 7, True, "imported", False), (2, 2, "o", 7, False, "local", True), (3, 1, "o", 7, True, "local", True)]
    scope = spark.createDataFrame(scope, "task_id int, ord int, rendering_hash string, shape int, bindable boolean, source string, elsewhere boolean")
    repository = spark.createDataFrame([(1, "t", True), (1, "t", False), (2, "t", False), (3, "t", True), (3, "w", True)], "task_id int, rendering_hash string, bindable boolean")
    got = {r.task_id: r.asDict() for r in N.task_census(protocol, scope, repository).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    pick = lambda t, *names: tuple(got[t][n] for n in names)
    counts = ("protocol_candidates", "protocol_negatives_in_scope", "scope_local", "scope_imported", "scope_size", "scope_bindable", "scope_shape_matched", "repository_size", "repository_bindable")
    assert [pick(t, *counts) for t in (1, 2, 3, 4)] == [(3, 2, 2, 1, 2, 1, 2, 1, 1), (2, 0, 1, 1, 2, 1, 2, 1, 0), (2, 0, 1, 0, 1, 1, 0, 2, 2), (2, 0, 0, 0, 0, 0, 0, 0, 0)]
    flags = ("scope_target", "scope_target_binds", "scope_target_unique", "target_independent", "repository_target", "repository_target_unique", "scope_solved", "filter_resolves", "filter_resolves_independently")
    assert [pick(t, *flags) for t in (1, 2, 3, 4)] == [
        (True, True, False, True, True, True, True, False, False), (True, True, True, False, True, False, True, True, False),
        (False, False, False, False, True, True, False, False, False), (False,) * 9,
    ]


def test_twin_of_the_target_is_no_candidate(spark):
    text = "def f(a):\n    return a\n\ndef f(a):\n    return a\n\ndef h(a):\n    return a\n\ndef h(a):\n    return a\n\ndef g(a):\n    return f(a)\n"
    x = S.readable(S.extract(spark.createDataFrame([("n", "m.py", text)], "namespace string, path string, content string"))).cache()
    symbols = S.symbols(x)
    got = T.call_decisions(symbols, T.single_target_callers(symbols, S.calls(x))).where("caller = 'g'").collect()
    assert sorted((r.name, r.ordinal, r.is_target) for r in got) == [("f", 1, True), ("g", 4, False), ("h", 2, False), ("h", 3, False)]


def test_histograms_and_baselines(spark):
    ranks = spark.createDataFrame([(1,), (8,), (9,), (None,)], "rank int")
    assert {r.bin: r.n for r in R.rank_histogram(ranks, [8, 1]).collect()} == {0: 1, 1: 1, 2: 1, None: 1}
    shown = [(1, True, True, True), (1, False, True, True), (1, False, False, False), (2, True, False, False), (2, False, True, False)]
    r = R.structural_baseline(spark.createDataFrame(shown, "task_id int, is_target boolean, same_file boolean, same_arity boolean")).first()
    assert (r.n, r.hits, r.accuracy) == (2, 0.5, 0.25)
    pairs = spark.createDataFrame([(True, True, 2, 1), (True, True, 3, 2), (True, True, 1, 1), (True, False, 3, 1)], "a_ok boolean, b_ok boolean, b_attempts int, a_attempts int")
    assert {r.turn_delta: r.n for r in P.turn_deltas(pairs).collect()} == {1: 2, 0: 1}


def test_paired_arms_of_plans(spark):
    arm = lambda *hits: spark.createDataFrame([(t, r, h == r) for t, h in hits for r in (1, 2, 3)], "task_id int, rank int, ok boolean")
    got = {r.task_id: tuple(r)[1:] for r in G.try_paired(arm((1, 1), (2, 3)), arm((1, 2), (2, 0)), 2).collect()}
    assert got == {1: (True, 1, True, 2), 2: (False, 2, False, 2)}


def test_excess_interval(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 40}", bool(rng.random() < 0.5), int(rng.integers(2, 6))) for k in range(800)]
    df = spark.createDataFrame(rows, "source string, ok boolean, pool int")
    want = np.mean([o - 1 / p for _, o, p in rows])
    a, b = [P.excess_interval(df, "ok", 1 / F.col("pool"), 2000, seed=1, law=law).first() for law in ("blocks", "draws")]
    assert abs(a.estimate - want) < 1e-12 and a.samples == b.samples == 2000
    assert abs(a.lower - b.lower) < 0.01 and abs(a.upper - b.upper) < 0.01 and a.lower < want < a.upper


def test_mlp_scores_are_the_plain_ones(spark):
    import math

    rng = np.random.default_rng(5)
    d, h = 3, 4
    f = 7 * d
    w = {"gamma": rng.normal(size=f).tolist(), "beta": rng.normal(size=f).tolist(), "w1": rng.normal(size=(h, f)).tolist(), "b1": rng.normal(size=h).tolist(), "w2": rng.normal(size=h).tolist(), "b2": 0.3}
    rows = [(k, 0, rng.normal(size=d).tolist(), rng.normal(size=d).tolist(), rng.normal(size=d).tolist()) for k in range(6)]
    got = {r.task_id: r.score for r in R.mlp_scores(spark.createDataFrame(rows, "task_id int, cand_idx int, context array<double>, question array<double>, candidate array<double>"), w).collect()}
    for k, _, c, q, x in rows:
        c, q, x = map(np.array, (c, q, x))
        v = np.concatenate([c, q, x, c * x, q * x, abs(c - x), abs(q - x)])
        v = (v - v.mean()) / math.sqrt(v.var() + 1e-5) * np.array(w["gamma"]) + np.array(w["beta"])
        hidden = np.array(w["w1"]) @ v + np.array(w["b1"])
        hidden = np.array([z * 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in hidden])
        assert abs(got[k] - (hidden @ np.array(w["w2"]) + w["b2"])) < 1e-9


def test_stacked(spark):
    rows = [("a", 1, k, k * 10) for k in (1, 0)] + [("a", 2, k, k) for k in (0, 1)]
    df = spark.createDataFrame(rows, "batch string, task_id int, cand_idx int, value int")
    r = T.stacked(df).first()
    assert (r.size, r.task_ids, r["values"]) == (2, [1, 2], [[0, 10], [0, 1]])
    with pytest.raises(Exception, match="mixed sizes"):
        T.stacked(df.where("NOT (task_id = 2 AND cand_idx = 1)")).collect()


@pytest.mark.parametrize("text,want", [
    ("f(a, b)\ndef f(a, b=lambda x: {1: x}):\n    return a", ["a"]), ("p.py::f(a)\nasync def f(\n    a: int,\n    *,\n    k: str = ':',\n) -> dict[str, int]: retu", ["a"]),
    ("f(a, b)\ndef f(a, b", []), ("f(a)\nclass f:", []), ("nothing", None), ("", None), ("f(a, /, *, k)\ndef f(a, /, *, k): return (", ["a", "k"]),
])
def test_headers(text, want):
    found = pysource.candidate_parameters(text)
    assert (found and found["required"]) == want


@pytest.mark.parametrize("text,plan", [
    ("candidate 1;\tkeep", (0, ["keep"])), ("candidate 1;\nkeep", (0, ["keep"])), ("`candidate 2; swap 3 1\t`", (1, ["swap", "1", "3"])), (" candidate 1; drop é ", None),
    ("candidate 1; drop né.", (0, ["drop", "né"])), ("candidate 1; keep; keep", None), ("candidate 5; keep", None), ("candidate 1; swap 2 2", None), ("", None),
])
def test_plans_with_white_space(spark, text, plan):
    r = spark.createDataFrame([(text,)], "t string").select(G.parse_plan(F.col("t"), F.lit(4)).alias("p")).first().p
    assert (r and (r.cand, r.op)) == plan


def test_stripped_is_pythons(spark):
    texts = [" a ", "\x1c b \x85", "", "\n\t", "c d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stripped(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)


def test_masked_names(spark):
    df = spark.createDataFrame([("@wrap(run)\nasync def run(x):\n    return run(x)", ["run(x)\nrun = 1"], ["no signature"])], "context string, good array<string>, bad array<string>")
    r = df.select(X.without_caller_name(F.col("context")).alias("c"), X.without_own_names(F.col("good")).alias("g")).first()
    assert r.c == "@wrap(run)\nasync def __CALLER__(x):\n    return run(x)" and r.g == ["__CANDIDATE__(x)\n__CANDIDATE__ = 1"]
    with pytest.raises(Exception, match="no signature"):
        df.select(X.without_own_names(F.col("bad"))).collect()


def test_verdicts_on_odd_answers(spark):
    context = "def run(self):\n    return self.__CALL_TARGET__(1, *self.rest)"
    candidates = ["a(self, x)\ndef a(self, x):\n    return x", "b(self, x, y)"]
    params = [pysource.candidate_parameters(c) for c in candidates]
    base = ("python.hard_masked_direct_call", context, candidates, params, 1)
    said = {"self.b(1, *self.rest)": "ok", "b(1, *self.rest)": "wrong_arguments", "self.a(1, *self.rest)": "wrong_target", "self.x.b(1)": "invalid_call_expression", "self.b(1, *self.rest, k=2)": "unbindable_call", "": "invalid_call_expression"}
    rows = [(*base, t, want) for t, want in said.items()] + [("other", *base[1:], "self.b(1)", "unsupported_task"), (*base[:1], "def run(: pass", *base[2:], "b()", "unsupported_task"), (*base, None, "invalid_call_expression")]
    kind = repairs.binding.PARAMETERS
    df = spark.createDataFrame(rows, f"task string, context string, candidates array<string>, params array<{kind}>, answer_index int, output string, want string")
    assert [(r.output, r.reason) for r in repairs.verify_calls(df).where("reason <> want").collect()] == []
    whole = {"def run(self):\n    return self.b(1, *self.rest)": "ok", "def run(self):\n    return self.a(1, *self.rest)": "wrong_target", "def run(self):\n    return 1": "unrelated_change", "x = 1": "invalid_python", "": "invalid_python"}
    df = spark.createDataFrame([(*base, t, want) for t, want in whole.items()], df.schema)
    assert [(r.output, r.reason) for r in repairs.verify_repairs(df).where("reason <> want").collect()] == []


def test_guards(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "validation")], "namespace string, split string")
    assert [r.namespace for r in splits.held_out(rows).collect()] == ["b"]
    with pytest.raises(ValueError, match="empty"):
        splits.held_out(rows.where("split <> 'test'"))
    with pytest.raises(Exception, match="not unseen"):
        splits.held_out(rows.unionByName(spark.createDataFrame([("b", "train")], rows.schema))).collect()
    with pytest.raises(ValueError, match="two namespaces"):
        splits.leave_one_out(rows.where("namespace = 'a'"))
    with pytest.raises(Exception, match="ratio not in"):
        P.required_discordant(spark.createDataFrame([(0.5,)], "ratio double")).collect()
    with pytest.raises(Exception, match="not significant up to"):
        P.required_discordant(spark.createDataFrame([(0.55,)], "ratio double"), limit=100).collect()


def test_blocks_draw_as_single_draws_do(spark):
    """Each replicate draws as many sources as there are; means and spread are those of drawing one by one."""
    rng = np.random.default_rng(5)
    rows = [("s" if k % 5 else None, f"f{k}", 1, int(v)) for k, v in enumerate(rng.integers(0, 50, 6000))]
    df = spark.createDataFrame(rows, "stratum string, source string, n long, v long")
    got = P.replicates(df, ["n", "v"], 400, 3).toPandas()
    for name, size in (("s", 4800), (None, 1200)):
        own = np.array([r[3] for r in rows if r[0] == name])
        one = got[got.stratum.isna()] if name is None else got[got.stratum == name]
        assert len(one) == 400 and set(one.n) == {size}
        assert abs(one.v.mean() - own.sum()) < 4 * own.std() * np.sqrt(size) / 20 and 0.85 < one.v.std() / (own.std() * np.sqrt(size)) < 1.15
    again = P.replicates(df.repartition(9, "source"), ["n", "v"], 400, 3).toPandas()
    key = lambda x: sorted(map(repr, x[["b", "stratum", "n", "v"]].itertuples(index=False)))
    assert key(again) == key(got)


def test_intervals_of_both_laws_agree(spark):
    rng = np.random.default_rng(8)
    rows = [("k", f"f{k % 300}", bool(rng.random() < 0.5), bool(rng.random() < 0.6), 2, 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "namespace string, source string, b_ok boolean, a_ok boolean, b_attempts long, a_attempts long")
    a, b = (P.bootstrap_by(df, "namespace", samples=2000, law=law).first() for law in ("blocks", "draws"))
    assert a.estimate == b.estimate and a.lower == pytest.approx(b.lower, abs=0.006) and a.upper == pytest.approx(b.upper, abs=0.006)


def test_coverage_over_many_margins(spark):
    rng = np.random.default_rng(2)
    rows = [(float(m), bool(h)) for m, h in zip(rng.normal(size=3000).round(3), rng.random(3000) < 0.7, strict=True)]
    got = {r.share: (r.answered, r.accuracy) for r in R.coverage_curve(spark.createDataFrame(rows, "margin double, hit boolean"), [0.1, 0.5, 1.0]).collect()}
    rows.sort(key=lambda r: -r[0])
    for share, (answered, accuracy) in got.items():
        n = int(np.ceil(share * 3000))
        while n < 3000 and rows[n][0] == rows[n - 1][0]:
            n += 1
        assert answered == n and accuracy == pytest.approx(np.mean([h for _, h in rows[:n]]))
