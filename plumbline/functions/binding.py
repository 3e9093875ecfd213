"""Call-site bindability as column expressions: can these parameters take this call?

parameters: struct<positional_only, positional_or_keyword, keyword_only, required: array<string>, has_vararg, has_kwarg: boolean>
shape: struct<positional: int, keywords: array<string>, starred, double_starred, receiver: boolean>

What is unknown speaks for the candidate: a starred argument may fill any positional, a double-starred one any name.
A positional-only name given as a keyword is refused even where the candidate takes arbitrary keywords.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.expressions import let

PARAMETERS = "struct<positional_only:array<string>,positional_or_keyword:array<string>,keyword_only:array<string>,required:array<string>,has_vararg:boolean,has_kwarg:boolean>"
SHAPE = "struct<positional:int,keywords:array<string>,starred:boolean,double_starred:boolean,receiver:boolean>"


def _rest(names: Column) -> Column:
    return F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))


def binds(p: Column, s: Column, drop_receiver: bool = False) -> Column:
    only, either = p["positional_only"], p["positional_or_keyword"]
    if drop_receiver:
        only, either = F.when(F.size(only) > 0, _rest(only)).otherwise(only), F.when(F.size(only) > 0, either).otherwise(_rest(either))

    def with_names(n: Column) -> Column:
        positional = F.concat(n["only"], n["either"])
        filled = F.when(s["starred"], F.array().cast("array<string>")).otherwise(F.slice(positional, 1, s["positional"]))

        def check(x: Column) -> Column:
            has = F.array_contains
            named = F.forall(s["keywords"], lambda k: ~has(n["only"], k) & ~has(x["filled"], k) & (has(n["either"], k) | has(p["keyword_only"], k) | p["has_kwarg"]))
            supplied = lambda r: (
                F.when(has(x["positional"], r), s["starred"] | (has(n["either"], r) & s["double_starred"])).when(has(p["keyword_only"], r), s["double_starred"]).otherwise(F.lit(True))
            )
            required = F.forall(p["required"], lambda r: has(x["filled"], r) | has(s["keywords"], r) | supplied(r))
            return ((s["positional"] <= F.size(x["positional"])) | p["has_vararg"]) & named & required

        return let(F.struct(positional.alias("positional"), filled.alias("filled")), check)

    return let(F.struct(only.alias("only"), either.alias("either")), with_names)


def bindable(p: Column, shapes: Column) -> Column:
    """Every call site must bind; a call on a receiver may read the candidate as bound or static."""
    return F.forall(shapes, lambda s: binds(p, s) | (s["receiver"] & binds(p, s, drop_receiver=True)))


def allowed(p: Column, shapes: Column) -> Column:
    """As bindable(); an unreadable signature, or no call site, is allowed."""
    return F.coalesce(bindable(p, shapes), F.lit(True))


def allowed_reason(p: Column, shapes: Column) -> tuple[Column, Column]:
    """(allowed, reason): as allowed(), and why: what could not be looked at, or what refused ('' if all sites bind)."""
    ok = allowed(p, shapes)
    blind = F.when(shapes.isNull() | (F.size(shapes) == 0), F.lit("no call site")).when(p.isNull(), F.lit("unreadable signature"))
    return ok, F.coalesce(blind, F.when(ok, F.lit("")).otherwise(F.lit("call site does not bind")))


def requires(text: Column, literal: str, fold: bool = False) -> Column:
    return F.contains(F.lower(text), F.lit(literal.lower())) if fold else F.contains(text, F.lit(literal))


def rejects(text: Column, literal: str, fold: bool = False) -> Column:
    return ~requires(text, literal, fold)


def conjunction(*named: tuple[str, Column]) -> tuple[Column, Column]:
    """(allowed, reason): all constraints hold, and the first that does not ('' if none)."""
    ok, reason = F.lit(True), F.lit(None).cast("string")
    for name, c in named:
        ok = ok & c
        reason = F.coalesce(reason, F.when(~c, F.lit(name)))
    return ok, F.coalesce(reason, F.lit(""))
