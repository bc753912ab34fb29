"""Users' SELECTs over named DataFrames: binding of table names, and answers that fail alone."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT_ONCE = 4


@dataclass(frozen=True)
class Answer:
    """First column of a query's first row. ``value`` is NULL unless it is a number or a boolean."""

    rows: int = 0
    value: float | None = None
    shown: str | None = None
    error: str | None = None


def _each(items: JavaObject) -> list:
    found, it = [], items.iterator()
    while it.hasNext():
        found.append(it.next())
    return found


def _relations(plan: JavaObject, hidden: frozenset[str] = frozenset(), aliased: bool = False) -> list[tuple[list[str], int, bool]]:
    """Name parts, place in the text and whether an alias follows, of every table a parsed query names."""
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        parts = [str(p) for p in _each(plan.multipartIdentifier())]
        return [] if len(parts) == 1 and parts[0].lower() in hidden else [(parts, plan.origin().startIndex().get(), aliased)]
    found = []
    if kind == "UnresolvedWith":
        for named in _each(plan.cteRelations()):
            found += _relations(named._2(), hidden, True)
            hidden = hidden | {named._1().lower()}
    for child in [*_each(plan.children()), *_each(plan.subqueries())]:
        found += _relations(child, hidden, kind == "SubqueryAlias")
    return found


def _match(parts: list[str], tables: Mapping[str, DataFrame]) -> str | None:
    """The table meant: its whole name, else the only one whose last part is the same and whose name is shorter or longer."""
    whole = ".".join(parts).lower()
    for name in tables:
        if name.lower() == whole:
            return name
    alike = [n for n in tables if n.lower().endswith(f".{whole}") or whole.endswith(f".{n.lower()}")]
    return alike[0] if len(alike) == 1 else None


def bind(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """The query with its tables as placeholders, and what they stand for.

    ``{name}`` is taken as it is. Otherwise Spark's own parser says where tables are named; ``orders`` and ``public.orders``
    both find a table given under either name. Names that are not given are left for the catalog.
    """
    braced = {n: df for n, df in tables.items() if "{" + n + "}" in text}
    if braced or "{" in text:
        return text, braced
    used: dict[str, DataFrame] = {}
    for parts, start, aliased in sorted(_relations(spark._jsparkSession.sessionState().sqlParser().parsePlan(text)), key=lambda r: -r[1]):
        name = _match(parts, tables)
        if name is not None:
            place = f"given_{len(used)}"
            used[place] = tables[name]
            written = re.match(r"(?:`[^`]+`|\w+)(?:\s*\.\s*(?:`[^`]+`|\w+))*", text[start:])
            text = text[:start] + "{" + place + "}" + ("" if aliased else f" AS `{parts[-1]}`") + text[start + written.end():]
    return text, used


def ask(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> Answer:
    """Run one query; whatever goes wrong becomes the answer's error."""
    try:
        query, used = bind(spark, text, tables)
        answer = spark.sql(query, **used)
        first = answer.select(F.col(f"`{answer.columns[0]}`").alias("v")) if len(set(answer.columns)) == len(answer.columns) else answer.toDF(*[f"c{i}" for i in range(len(answer.columns))]).select(F.col("c0").alias("v"))
        row = first.limit(1).select("v", F.to_json(F.array("v")).alias("j") if first.schema["v"].dataType.typeName() in ("array", "struct", "map") else F.col("v").cast("string").alias("j")).first()
    except (PySparkException, Py4JError, KeyError, ValueError, IndexError) as problem:
        return Answer(error=next((line for line in str(problem).splitlines() if line.strip()), type(problem).__name__)[:500])
    if row is None:
        return Answer()
    try:
        number = None if row["v"] is None or isinstance(row["v"], str) else float(row["v"])
    except (TypeError, ValueError):
        number = None
    return Answer(1, number, row["j"])


def ask_all(spark: SparkSession, texts: Sequence[str], tables: Mapping[str, DataFrame]) -> list[Answer]:
    """All answers, a few queries at a time; one that fails leaves the others alone."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda t: ask(spark, t, tables), texts))
