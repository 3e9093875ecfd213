"""Judging answers that are code: a repaired function, or the call expression that belongs in a masked place.

answers: task, context, candidates, answer_index, output; for calls also params, the candidates' parameters (null where
unreadable).  A worker reads each answer's facts once; resolution, bindability and verdict are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import binding, calls
from plumbline.functions.selection import OK, SUPPORTED_TASKS, UNSUPPORTED, stripped, unfenced
from plumbline.functions.texts import candidate_symbol

#: Verdict reasons.
INVALID_PYTHON, WRONG_FUNCTION, PLACEHOLDER, WRONG_TARGET, UNRELATED = "invalid_python", "wrong_function", "placeholder_remaining", "wrong_target", "unrelated_change"
INVALID_CALL, UNKNOWN, AMBIGUOUS, UNBINDABLE, WRONG_ARGUMENTS = "invalid_call_expression", "unknown_target", "ambiguous_target", "unbindable_call", "wrong_arguments"


def symbols_of(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: candidate_symbol(c))


def matching(candidates: Column, callee: Column) -> Column:
    """Indices of all candidates of that name: none, one or many; the label has no say."""
    return F.filter(F.transform(symbols_of(candidates), lambda s, i: F.when(s == callee, i)), lambda i: i.isNotNull())


def verify_repairs(answers: DataFrame) -> DataFrame:
    """answers with reason: the output must be the caller with the target in the masked place, layout aside."""
    target = candidate_symbol(F.get("candidates", F.col("answer_index")))
    x = answers.withColumn("_f", calls.facts_of(calls.repair_facts, calls.REPAIR, F.col("context"), target, unfenced(F.col("output"))))
    named = F.array_intersect("_f.called", symbols_of(F.col("candidates")))
    reason = (
        F.when(~F.col("task").isin(*SUPPORTED_TASKS), UNSUPPORTED).when(~F.col("_f.whole"), INVALID_PYTHON).when(~F.col("_f.head"), WRONG_FUNCTION)
        .when(F.col("_f.placeholder"), PLACEHOLDER).when(F.col("_f.same"), OK).when((F.size(named) > 0) & ~F.array_contains(named, target), WRONG_TARGET).otherwise(UNRELATED)
    )
    return x.withColumn("reason", reason).drop("_f")


def call_text(output: Column) -> Column:
    """The code of an answer that should be one call: without fence, backticks and a closing semicolon."""
    bare = stripped(F.regexp_replace(stripped(unfenced(output)), r"\A`+|`+\z", ""))
    return stripped(F.regexp_replace(bare, r";\z", ""))


def verify_calls(answers: DataFrame) -> DataFrame:
    """answers with target_index (null unless one candidate has the callee's name) and reason."""
    target = candidate_symbol(F.get("candidates", F.col("answer_index")))
    x = answers.withColumn("_f", calls.facts_of(calls.call_facts, calls.CALL, F.col("context"), target, call_text(F.col("output"))))
    x = x.withColumn("_at", matching(F.col("candidates"), F.col("_f.callee")))
    x = x.withColumn("target_index", F.when(F.size("_at") == 1, F.get("_at", F.lit(0))))
    shape = F.struct(*[F.col(f"_f.{c}").alias(c) for c in ("positional", "keywords", "starred", "double_starred", "receiver")])
    fits = binding.allowed(F.get("params", F.col("target_index")), F.array(shape))
    reason = (
        F.when(~F.col("task").isin(*SUPPORTED_TASKS) | (F.col("_f.sites") != 1), UNSUPPORTED).when(F.col("_f.callee").isNull(), INVALID_CALL).when(F.size("_at") == 0, UNKNOWN)
        .when(F.size("_at") > 1, AMBIGUOUS).when(~fits, UNBINDABLE).when(F.col("_f.same"), OK).when(F.col("target_index") != F.col("answer_index"), WRONG_TARGET).otherwise(WRONG_ARGUMENTS)
    )
    seen = F.when(~reason.isin(UNSUPPORTED, INVALID_CALL), F.col("target_index"))
    return x.withColumns({"reason": reason, "target_index": seen}).drop("_f", "_at")
