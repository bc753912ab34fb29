"""Data contracts: column, volume and SQL rules of a table, judged in as few scans as possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.assertions import assertion_holds, assertion_op
from tablewarden.operators.freshness import Watch, poll
from tablewarden.plans.answers import Answer, ask_all
from tablewarden.plans.newest import newest
from tablewarden.plans.rules import Rule, evaluate, repeated_values, rule_row
from tablewarden.session import small_frame

# Contract type names and the Spark types that satisfy them.
TYPE_ALIASES = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "bigint": (T.LongType,),
    "varchar": (T.StringType,),
    "text": (T.StringType,),
    "string": (T.StringType,),
    "numeric": (T.NumericType,),
    "decimal": (T.DecimalType,),
    "double": (T.DoubleType,),
    "float": (T.FloatType, T.DoubleType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
}


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str | None = None
    nullable: bool = True
    unique: bool = False
    allowed_values: tuple = ()
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class SqlRule:
    name: str
    sql: str
    assertion: str = "result == 0"


@dataclass(frozen=True)
class Contract:
    id: str
    table: str
    version: str = "unknown"
    columns: tuple[ColumnRule, ...] = ()
    min_rows: int | None = None
    rules: tuple[SqlRule, ...] = ()
    freshness_column: str | None = None
    freshness_warn: str = "1h"
    freshness_fail: str = "2h"


def type_satisfied(expected: str, actual: T.DataType) -> bool:
    base = expected.lower().replace("(", " ").split()[0]
    known = TYPE_ALIASES.get(base)
    return isinstance(actual, known) if known else actual.simpleString().startswith(base)


def outside(column: str, data_type: T.DataType, allowed: Sequence) -> Column:
    """Non-null and not in the list. Listed values are read as text in the column's type; one
    that does not fit the type can match nothing."""
    texts = [str(v) for v in allowed]
    if isinstance(data_type, T.StringType):
        listed = F.col(column).isin(*texts)
    else:
        values = F.array_compact(F.array(*[F.lit(t).try_cast(data_type) for t in texts]))
        listed = F.array_contains(values, F.col(column))
    return F.col(column).isNotNull() & ~listed


def _zero(value: Column) -> Column:
    return value == 0


def _detail(rule: Rule, value: Column) -> list[Column]:
    return [F.concat(F.lit(f"{rule.name}: "), value.cast("bigint").cast("string")).alias("detail")]


def _tags(c: Contract) -> dict[str, str | None]:
    return {"contract_id": c.id, "version": c.version, "table_name": c.table}


def _fixed(spark: SparkSession, failures: list[tuple]) -> DataFrame:
    rows = small_frame(spark, failures, "rule string, contract_id string, version string, table_name string, detail string")
    return rows.select("rule", "contract_id", "version", "table_name", F.lit(None).cast("double").alias("metric_value"),
                       F.lit(False).alias("passed"), "detail")


def validate(spark: SparkSession, contracts: Sequence[Contract], tables: Mapping[str, DataFrame],
             contract_id: str | None = None) -> DataFrame:
    """A row per emitted rule: (rule, contract_id, version, table_name, metric_value, passed, detail).

    Existence and type rules appear only when broken, and a missing column has no other rules.
    All contracts on a table share one scan for their counting rules; each unique column adds a
    count per value and each SQL rule its own query. A table that cannot be resolved gives one
    failed ``schema_fetch`` row.
    """
    fused: dict[str, list[Rule]] = {}
    failures: list[tuple] = []
    parts: list[DataFrame] = []
    asked: list[tuple[Contract, SqlRule]] = []
    for c in contracts:
        if contract_id is not None and c.id != contract_id:
            continue
        who = (c.id, c.version, c.table)
        if c.table not in tables:
            failures.append(("schema_fetch", *who, f"no table {c.table}"))
            continue
        df, tags = tables[c.table], _tags(c)
        types = {f.name: f.dataType for f in df.schema.fields}
        mine = fused.setdefault(c.table, [])
        for col in c.columns:
            if col.name not in types:
                failures.append((f"column_exists:{col.name}", *who, f"no column {col.name}"))
                continue
            if col.type and not type_satisfied(col.type, types[col.name]):
                failures.append((f"column_type:{col.name}", *who,
                                 f"expected {col.type}, found {types[col.name].simpleString()}"))
            v = F.col(col.name)
            if not col.nullable:
                mine.append(Rule(f"not_null:{col.name}", F.count_if(v.isNull()), _zero, tags))
            if col.allowed_values:
                mine.append(Rule(f"allowed_values:{col.name}",
                                 F.count_if(outside(col.name, types[col.name], col.allowed_values)), _zero, tags))
            if col.min is not None:
                mine.append(Rule(f"min_value:{col.name}", F.count_if(v < col.min), _zero, tags))
            if col.max is not None:
                mine.append(Rule(f"max_value:{col.name}", F.count_if(v > col.max), _zero, tags))
            if col.unique:
                rule = Rule(f"unique:{col.name}", F.col("repeated"), _zero, tags)
                counted = repeated_values(df, col.name, keep_null_group=True)
                parts.append(counted.select(F.inline(F.array(rule_row(rule, F.col("repeated"), _detail)))))
        if c.min_rows is not None:
            mine.append(Rule("min_rows", F.count(F.lit(1)), lambda n, least=c.min_rows: n >= least, tags))
        asked += [(c, r) for r in c.rules]
    parts += [evaluate(tables[t], rules, _detail) for t, rules in fused.items() if rules]
    if asked:
        parts.append(_sql_rules(spark, asked, tables))
    if failures or not parts:
        parts.append(_fixed(spark, failures))
    return reduce(DataFrame.unionByName, parts)


def _sql_rules(spark: SparkSession, asked: Sequence[tuple[Contract, SqlRule]], tables: Mapping[str, DataFrame]) -> DataFrame:
    """First value of each SELECT, NULL counted as 0, against its assertion.

    Each query fails alone; ``detail`` begins with ``error:`` where the rule, not the data, is at fault.
    """
    usable = [r.sql.strip().lower().startswith(("select", "with")) for _, r in asked]
    answers = iter(ask_all(spark, [r.sql for (_, r), ok in zip(asked, usable) if ok], tables))
    rows = []
    for (c, r), ok in zip(asked, usable):
        a = next(answers) if ok else Answer(error="a SQL rule must start with SELECT or WITH")
        rows.append((r.name, c.id, c.version, c.table, r.assertion, a.value if a.shown is not None else (None if a.error else 0.0), a.shown, a.error))
    frame = small_frame(spark, rows, "rule string, contract_id string, version string, table_name string, assertion string, metric_value double, shown string, error string")
    text, value = F.col("assertion"), F.col("metric_value")
    known = assertion_op(text).isNotNull()
    judged = F.coalesce(assertion_holds(text, value), value.isNull() & (assertion_op(text) == "!="), F.lit(False))
    detail = (F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(~known, F.concat(F.lit("error: not an assertion: "), text))
              .otherwise(F.concat(F.lit("SQL returned "), F.coalesce("shown", F.lit("0")))))
    passed = F.col("error").isNull() & known & judged
    return frame.select("rule", "contract_id", "version", "table_name", F.when(known & F.col("error").isNull(), value).alias("metric_value"), passed.alias("passed"), detail.alias("detail"))


def summarise(rule_rows: DataFrame) -> DataFrame:
    """One row per contract; it passes when every emitted rule does."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("rule", "detail"))))
    return rule_rows.groupBy("contract_id", "version", "table_name").agg(
        F.min("passed").alias("passed"), F.count(F.lit(1)).alias("total_rules"),
        F.count_if("passed").alias("passed_rules"), failed.alias("violations"))


def freshness(contracts: Sequence[Contract], tables: Mapping[str, DataFrame], as_of: datetime | str) -> DataFrame:
    """The freshness promise of each contract that makes one."""
    return poll([Watch(c.table, tables[c.table], c.freshness_column, c.freshness_warn, c.freshness_fail)
                 for c in contracts if c.freshness_column and c.table in tables], as_of)


def results(history: DataFrame, contract_id: str | None = None, table: str | None = None, limit: int = 50) -> DataFrame:
    where = F.lit(True)
    if contract_id is not None:
        where = where & (F.col("contract_id") == contract_id)
    if table is not None:
        where = where & (F.col("table_name") == table)
    return newest(history, "validated_at", limit, where)
