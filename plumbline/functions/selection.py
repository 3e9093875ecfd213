"""Reading recorded answers: candidate indices, code fences, verdict reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.expressions import let

#: Task families that structured selection supports, and verdict reasons.
SUPPORTED_TASKS = ("python.hard_masked_direct_call", "python.hard_masked_same_class_call", "python.hard_masked_cross_file_call")
OK, UNSUPPORTED, UNPARSEABLE, REJECTED, WRONG = "ok", "unsupported_task", "unparseable_selection", "rejected_candidate", "wrong_selection"


def stripped(text: Column) -> Column:
    """Without white space, that of Unicode too, at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def candidate_index(output: Column, n_candidates: Column) -> Column:
    """The 0-based index that a text names by its 1-based number, or null."""
    digits = F.regexp_extract(stripped(output), r"(?i)\A(?:candidate\s*)?(\d+)\s*[:.)]?\z", 1)
    value = digits.try_cast("int")
    return F.when(value.between(1, n_candidates), value - 1)


def unfenced(text: Column) -> Column:
    """What stands between a fence that begins a text and its last fence, which may be nothing; else the trimmed text."""
    fence = "(?s)\\A```[^\\n]*\\n(.*)```"
    return let(stripped(text), lambda s: F.when(s.rlike(fence), stripped(F.regexp_extract(s, fence, 1))).otherwise(s))


def selection_reason(task: Column, selected: Column, answer: Column) -> Column:
    """Verdict of a plain selection: the task is looked at first."""
    return F.when(~task.isin(*SUPPORTED_TASKS), UNSUPPORTED).when(selected.isNull(), UNPARSEABLE).when(selected != answer, WRONG).otherwise(OK)


def memory_reason(task: Column, selected: Column, answer: Column, rejected: Column) -> Column:
    """Verdict of a selection with rejected candidates: an unreadable answer is looked at first."""
    return F.when(selected.isNull(), UNPARSEABLE).when(F.array_contains(rejected, selected), REJECTED).otherwise(selection_reason(task, selected, answer))
