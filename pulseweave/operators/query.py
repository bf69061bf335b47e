"""Document queries: filters, projection, order, paging, relations and edits.

``apply_filter`` takes the filter grammar ``{where, fields, order, limit,
offset, include}`` and gives one lazy DataFrame, so that predicates and columns reach the
scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPARE = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "between": lambda c, v: c.between(v[0], v[1]),
    "inq": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)),
    "neq": lambda c, v: c.isNotNull() if v is None else ~c.eqNullSafe(F.lit(v)),
    "like": lambda c, v: c.like(v),
    "regexp": lambda c, v: c.rlike(v),
}


def predicate(where: Mapping[str, Any]) -> Column:
    """One Column for a ``where`` mapping; its entries are joined with AND."""
    parts: list[Column] = []
    for key, want in where.items():
        if key in ("or", "and"):
            op = (lambda a, b: a | b) if key == "or" else (lambda a, b: a & b)
            parts.append(reduce(op, [predicate(w) for w in want]))
        elif isinstance(want, Mapping):
            parts.extend(_COMPARE[name](F.col(key), value) for name, value in want.items())
        elif want is None:
            parts.append(F.col(key).isNull())
        else:
            parts.append(F.col(key) == F.lit(want))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def order_columns(order: str | Sequence[str]) -> list[Column]:
    """``'time desc'`` style order clauses; a clause without a word is ascending."""
    clauses = [order] if isinstance(order, str) else list(order)
    out = []
    for clause in clauses:
        name, _, way = clause.partition(" ")
        col = F.col(name)
        out.append(col.desc() if way.strip().lower() == "desc" else col.asc())
    return out


@dataclass(frozen=True)
class Relation:
    """Children of a table's rows, for ``include``; see ``include_relation``."""

    children: DataFrame
    parent_key: str
    child_key: str
    max_children: int | None = None


def apply_filter(df: DataFrame, spec: Mapping[str, Any], relations: Mapping[str, Relation] | None = None) -> DataFrame:
    """The rows that a filter asks for; ``include`` names one of ``relations`` or several.

    Relations join the rows that are left after order and limit; ``fields`` apply to
    these rows, and relations come on top.
    """
    if spec.get("where"):
        df = df.where(predicate(spec["where"]))
    if spec.get("order"):
        df = df.orderBy(*order_columns(spec["order"]))
    if spec.get("offset"):
        df = df.offset(int(spec["offset"]))
    if spec.get("limit"):
        df = df.limit(int(spec["limit"]))
    if spec.get("fields"):
        wanted = list(spec["fields"])
        keys = [(relations or {})[name].parent_key for name in _included(spec)]
        df = df.select(*wanted, *[k for k in dict.fromkeys(keys) if k not in wanted])
    for name in _included(spec):
        r = (relations or {})[name]
        df = include_relation(df, r.children, r.parent_key, r.child_key, name, r.max_children)
    return df


def _included(spec: Mapping[str, Any]) -> list[str]:
    names = spec.get("include") or []
    return [names] if isinstance(names, str) else list(names)


def count_where(df: DataFrame, where: Mapping[str, Any]) -> DataFrame:
    return df.where(predicate(where)).agg(F.count("*").alias("count"))


def find_first(df: DataFrame, where: Mapping[str, Any], order: str | Sequence[str]) -> DataFrame:
    return apply_filter(df, {"where": where, "order": order, "limit": 1})


def keyset_page(
    df: DataFrame,
    key: str,
    after: Any = None,
    page_size: int = 100,
    where: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The page of rows that follows ``after`` in key order (the first page if None)."""
    if where:
        df = df.where(predicate(where))
    if after is not None:
        df = df.where(F.col(key) > F.lit(after))
    return df.orderBy(key).limit(page_size)


def in_table(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """IN list given as a table of any size."""
    wanted = keys.select(F.col(key).alias("_wanted"))
    return df.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")


def include_relation(
    parents: DataFrame,
    children: DataFrame,
    parent_key: str,
    child_key: str,
    name: str,
    max_children: int | None = None,
) -> DataFrame:
    """Parents with their children.

    With ``max_children`` (a relation whose fan-out is fixed by configuration)
    the children are nested in an array column. Without it every child stays a
    row of its own in a struct column, so that no parent is gathered in one task.
    """
    if max_children is not None:
        # Counted before anything is gathered.
        crowded = children.groupBy(child_key).agg(F.count("*").alias("n")).where(F.col("n") > max_children)
        crowded = crowded.join(parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_semi")
        if not crowded.isEmpty():
            raise ValueError(f"more than {max_children} {name} under one parent")
    child = F.struct(*[F.col(f"c.{c}") for c in children.columns if c != child_key])
    joined = parents.alias("p").join(
        children.alias("c"), F.col(f"p.{parent_key}") == F.col(f"c.{child_key}"), "left"
    )
    flat = joined.select("p.*", F.when(F.col(f"c.{child_key}").isNotNull(), child).alias(name))
    if max_children is None:
        return flat
    return flat.groupBy(*parents.columns).agg(F.array_sort(F.collect_list(name)).alias(name))


def find_or_create(existing: DataFrame, defaults: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows plus the default rows whose key is not there yet."""
    missing = defaults.join(existing.select(*key), list(key), "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)


def upsert_by_key(df: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with those of ``updates`` put in their place by key.

    ``updates`` holds one row per key; ``latest_by_key`` makes it so.
    """
    kept = df.join(updates.select(*key), list(key), "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def update_all(df: DataFrame, where: Mapping[str, Any], values: Mapping[str, Any]) -> DataFrame:
    cond = predicate(where)
    changed = {
        name: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(name))
        for name, v in values.items()
    }
    return df.withColumns(changed)


def destroy_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def destroy_all(df: DataFrame) -> DataFrame:
    return df.limit(0)


def typed_settings(settings: DataFrame, object_schema: str = "map<string,string>") -> DataFrame:
    """Setting rows (key, type, value) with one typed column per declared type."""
    kind, value = F.col("type"), F.col("value")
    leading_int = F.regexp_extract(value, r"^\s*([+-]?\d+)", 1)
    leading_num = F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return (
        settings.withColumn("_i", leading_int)
        .withColumn("_f", leading_num)
        .select(
            "key",
            "type",
            F.when(kind == "boolean", value != "false").alias("bool_value"),
            F.when(kind == "int", F.expr("try_cast(_i as bigint)")).alias("int_value"),
            F.when(kind == "float", F.expr("try_cast(_f as double)")).alias("float_value"),
            F.when(kind == "object", F.from_json(value, object_schema)).alias("object_value"),
            F.when(~kind.isin("boolean", "int", "float", "object"), value).alias("string_value"),
        )
    )


def created_stamp(df: DataFrame, column: str = "created") -> DataFrame:
    """Creation time of rows that carry none yet."""
    now = F.current_timestamp()
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), now))
    return df.withColumn(column, now)
