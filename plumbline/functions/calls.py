"""Facts of answers that are code: repaired functions and call expressions, read with the standard library's parser.

Workers only read what stands in a text; which verdict follows is decided in column expressions.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.pysource import FUNCTIONS, MARKER

REPAIR = "whole boolean, head boolean, placeholder boolean, same boolean, called array<string>"
CALL = "sites int, callee string, receiver boolean, positional int, keywords array<string>, starred boolean, double_starred boolean, same boolean"
SITE = "args array<struct<text:string,starred:boolean>>, keywords array<struct<name:string,value:string>>, receiver boolean"

BAD_TEXT = (SyntaxError, ValueError, RecursionError)


def name_of(x) -> str | None:
    """What a plain name or the last part of a dotted one says."""
    return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None


def resolved(context: str, target: str) -> ast.Module:
    """The context's tree with the target's name wherever the marker stood, as parsing its rendering gives it."""
    tree = ast.parse(context)
    for x in ast.walk(tree):
        if name_of(x) == MARKER:
            setattr(x, "id" if isinstance(x, ast.Name) else "attr", target)
    return ast.parse(ast.unparse(tree))


def lone_function(tree: ast.Module):
    return tree.body[0] if len(tree.body) == 1 and isinstance(tree.body[0], FUNCTIONS) else None


def repair_facts(context: str, target: str, code: str) -> tuple:
    """REPAIR: both are one function each; same name and kind; a marker is left; same trees; names that the answer calls."""
    try:
        want, got = lone_function(resolved(context, target)), lone_function(ast.parse(code))
    except BAD_TEXT:
        want = got = None
    if want is None or got is None:
        return False, None, None, None, None
    inner = list(ast.walk(got))
    called = sorted({n for x in inner if isinstance(x, ast.Call) and (n := name_of(x.func))})
    return True, (want.name, type(want)) == (got.name, type(got)), any(name_of(x) == MARKER for x in inner), ast.dump(want) == ast.dump(got), called


def marked_calls(tree) -> list[ast.Call]:
    return [x for x in ast.walk(tree) if isinstance(x, ast.Call) and name_of(x.func) == MARKER]


def read_call(code: str) -> ast.Call | None:
    """The call of a plain name, or of an attribute of one, that the text is; None for anything else."""
    try:
        x = ast.parse(code, mode="eval").body
    except BAD_TEXT:
        return None
    plain = isinstance(x, ast.Call) and (isinstance(x.func, ast.Name) or isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name))
    return x if plain else None


def with_call(context: str, call: ast.Call) -> ast.Module:
    """The context's tree with the call in place of the marked one, as parsing its rendering gives it."""
    tree = ast.parse(context)
    for owner in ast.walk(tree):
        for field, value in ast.iter_fields(owner):
            if isinstance(value, list):
                setattr(owner, field, [call if isinstance(v, ast.Call) and name_of(v.func) == MARKER else v for v in value])
            elif isinstance(value, ast.Call) and name_of(value.func) == MARKER:
                setattr(owner, field, call)
    return ast.parse(ast.unparse(tree))


def call_facts(context: str, target: str, code: str) -> tuple:
    """CALL: marked calls of the context; the answer's callee and shape; whether it restores the call of the target."""
    try:
        sites = len(marked_calls(ast.parse(context)))
    except BAD_TEXT:
        sites = 0
    call = read_call(code)
    if call is None or sites != 1:
        return sites, None, None, None, None, None, None, None
    star = [isinstance(a, ast.Starred) for a in call.args]
    shape = star.count(False), sorted({k.arg for k in call.keywords if k.arg}), any(star), any(k.arg is None for k in call.keywords)
    try:
        same = ast.dump(resolved(context, target)) == ast.dump(with_call(context, call))
    except BAD_TEXT:
        return sites, None, None, None, None, None, None, None
    return sites, name_of(call.func), isinstance(call.func, ast.Attribute), *shape, same


def marked_site(context: str) -> tuple:
    """SITE: arguments and keywords of the context's only marked call; nulls if there is none or more than one."""
    try:
        found = marked_calls(ast.parse(context))
    except BAD_TEXT:
        found = []
    if len(found) != 1:
        return None, None, None
    args = [{"text": ast.unparse(a.value if isinstance(a, ast.Starred) else a), "starred": isinstance(a, ast.Starred)} for a in found[0].args]
    return args, [{"name": k.arg, "value": ast.unparse(k.value)} for k in found[0].keywords], isinstance(found[0].func, ast.Attribute)


def facts_of(helper, schema: str, *texts: Column) -> Column:
    """A helper's facts of these texts as a struct column, in Arrow batches; null texts are empty."""
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [helper(*(t or "" for t in row)) for row in frame.itertuples(index=False)]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    of.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(of, schema)(F.struct(*[t.alias(f"t{k}") for k, t in enumerate(texts)]))
