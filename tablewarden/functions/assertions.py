"""The assertion grammar ``result <op> <number>`` for constants and for columns of text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The comparison operators and the unsigned numeric literal that are accepted; True
# and False stand for 1 and 0. A sign, `and`/`or`, `is None`, chained comparisons and names on the
# right are errors.
OPERATORS = ("==", "!=", "<=", ">=", "<", ">")
ASSERTION_PATTERN = (
    r"^\s*result\s*(==|!=|<=|>=|<|>)\s*"
    r"([0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|True|False)\s*$"
)
TRUTH = {"True": 1.0, "False": 0.0}


def compare(left: Column, op: str, right) -> Column:
    if op in ("=", "=="):
        return left == right
    if op == "!=":
        return left != right
    if op == "<":
        return left < right
    if op == "<=":
        return left <= right
    if op == ">":
        return left > right
    if op == ">=":
        return left >= right
    raise ValueError(f"unsupported operator {op!r}")


@dataclass(frozen=True)
class Assertion:
    op: str
    value: float

    def holds(self, result: Column) -> Column:
        """NULL stands for a value that is no number: it differs from every number, and that is
        all that can be said of it."""
        return F.coalesce(compare(result, self.op, F.lit(self.value)), F.lit(self.op == "!="))


def parse_assertion(text: str) -> Assertion:
    found = re.match(ASSERTION_PATTERN, text)
    if not found:
        raise ValueError(f"assertion must be 'result <op> <number>', got {text!r}")
    literal = found.group(2)
    return Assertion(found.group(1), TRUTH[literal] if literal in TRUTH else float(literal))


def assertion_op(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ASSERTION_PATTERN, 1), F.lit(""))


def assertion_holds(text: Column, result: Column) -> Column:
    """Assertion text held in a column. NULL where the text is outside the grammar."""
    op = assertion_op(text)
    literal = F.regexp_extract(text, ASSERTION_PATTERN, 2)
    bound = literal.try_cast("double")
    for word, number in TRUTH.items():
        bound = F.when(literal == word, number).otherwise(bound)
    outcome = F.lit(None).cast("boolean")
    for symbol in OPERATORS:
        outcome = F.when(op == symbol, compare(result, symbol, bound)).otherwise(outcome)
    return outcome
