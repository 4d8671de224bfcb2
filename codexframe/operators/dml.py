"""Writes as copy-on-write plans: each takes a table and returns the table after the statement."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.schemas import CASCADES


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    out = a[key[0]] == b[key[0]]
    for k in key[1:]:
        out = out & (a[k] == b[k])
    return out


def insert(table: DataFrame, rows: DataFrame, key: list[str], skip_duplicates: bool = False) -> DataFrame:
    """``table`` and ``rows``. With ``skip_duplicates`` rows of an existing key, or of one given before, are left out.

    Without it a key conflict is for the caller to rule out: see :func:`conflicts`.
    """
    rows = rows.select(*table.columns)
    if skip_duplicates:
        first = Window.partitionBy(*key).orderBy(*[F.col(c) for c in table.columns])
        rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        rows = rows.join(table.select(*key), key, "left_anti").select(*table.columns)
    return table.unionByName(rows)


def conflicts(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``rows`` that an insert would break: in the table already, or given twice."""
    twice = rows.groupBy(*key).count().where("count > 1").select(*key)
    return rows.select(*key).join(table.select(*key), key, "left_semi").unionByName(twice).distinct()


def _new_value(name: str, change: Any) -> Column:
    if isinstance(change, Column):
        return change
    if not isinstance(change, dict):
        return F.lit(change)
    ((op, value),) = change.items()
    old, value = F.col(name), value if isinstance(value, Column) else F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
    if op == "set":
        return value
    if op == "push":
        return F.concat(old, value if isinstance(change["push"], list) else F.array(value))
    return {"increment": old + value, "decrement": old - value, "multiply": old * value, "divide": old / value}[op]


def update(table: DataFrame, where: Column, changes: dict[str, Any], limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Matching rows with ``changes``: a value, a column, or ``{"increment": 1}``, ``decrement, multiply,
    divide, set, push``. ``limit`` changes the first matching rows in the order of ``order_by`` only.
    All new values are worked out from the old row.
    """
    hit = F.coalesce(where, F.lit(False))
    df = table
    if limit is not None:
        if not order_by:
            raise ValueError("limit needs order_by")
        chosen = table.where(hit).orderBy(*order_by).limit(limit).select(*order_by).withColumn("__hit", F.lit(True))
        df = table.join(chosen, order_by, "left")
        hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = []
    for c in table.columns:
        out.append(F.when(hit, _new_value(c, changes[c]).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c))
    return df.select(*out)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], changes: list[str] | None = None) -> DataFrame:
    """Insert ``rows`` of new keys; where the key exists, take ``changes`` (all other columns) from the row.

    Rows should have distinct keys: of several, the last in the order of all columns counts.
    """
    rows = rows.select(*table.columns)
    last = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in table.columns if c not in key] or [F.lit(1)])
    rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    changes = [c for c in table.columns if c not in key] if changes is None else changes
    old, new = table.alias("o").withColumn("__old", F.lit(True)), rows.alias("n").withColumn("__new", F.lit(True))
    new = new.select(*[F.col(c).alias(f"__n_{c}") for c in table.columns], "__new")
    on = F.lit(True)
    for k in key:
        on = on & (old[k] == new[f"__n_{k}"])
    both = old.join(new, on, "full_outer")
    out = []
    for c in table.columns:
        take_new = F.col("__old").isNull() | (F.col("__new").isNotNull() & F.lit(c in changes))
        out.append(F.when(take_new, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def delete(table: DataFrame, where: Column) -> DataFrame:
    """``table`` without the rows that match; rows for which the condition is null stay."""
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return table.join(keys.select(on) if isinstance(on, str) else keys.select(*on), on, "left_anti").select(*table.columns)


def delete_cascade(tables: dict[str, DataFrame], name: str, ids: DataFrame, key: str = "id", cascades=CASCADES) -> dict[str, DataFrame]:
    """All tables after rows of one are deleted: what refers to them goes too, level by level."""
    out = dict(tables)
    gone = {name: [ids.select(F.col(ids.columns[0]).alias(key))]}
    todo = [name]
    while todo:
        parent = todo.pop(0)
        dead = gone[parent].pop()
        for child, foreign, to in cascades:
            if to == parent and child in out:
                lost = out[child].join(dead.select(F.col(key).alias(foreign)), foreign, "left_semi")
                out[child] = out[child].join(dead.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*tables[child].columns)
                if key in out[child].columns and any(c[2] == child for c in cascades):
                    gone.setdefault(child, []).append(lost.select(key))
                    todo.append(child)
        if parent in out:
            out[parent] = delete_keys(out[parent], dead, key)
    return out


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Delete-then-insert by parent: children of the parents that ``fresh`` covers are its rows only."""
    return delete_keys(children, fresh.select(parent).distinct(), parent).unionByName(fresh.select(*children.columns))


def exclusive_flag(table: DataFrame, owner_col: str, owner: Any, chosen: Column, flag: str = "is_active") -> DataFrame:
    """The owner's flag is on for the chosen row alone; other owners' rows stay."""
    return table.withColumn(flag, F.when(F.col(owner_col) == owner, F.coalesce(chosen, F.lit(False))).otherwise(F.col(flag)))


def connect(children: DataFrame, ids: DataFrame, foreign: str, parent: Any, key: str = "id") -> DataFrame:
    """Children with these ids now belong to ``parent``."""
    known = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__hit", F.lit(True))
    joined = children.join(known, key, "left")
    value = F.when(F.col("__hit"), F.lit(parent).cast(children.schema[foreign].dataType)).otherwise(F.col(foreign))
    return joined.withColumn(foreign, value).select(*children.columns)


def disconnect(children: DataFrame, ids: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children with these ids belong to no parent."""
    return connect(children, ids, foreign, None, key)


def set_children(children: DataFrame, ids: DataFrame, foreign: str, parent: Any, key: str = "id") -> DataFrame:
    """The parent's children are exactly those with these ids."""
    freed = children.withColumn(foreign, F.when(F.col(foreign) == parent, F.lit(None).cast(children.schema[foreign].dataType)).otherwise(F.col(foreign)))
    return connect(freed, ids, foreign, parent, key)


def connect_or_create(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows whose key it lacks; those it has stay as they are."""
    return insert(table, rows, key, skip_duplicates=True)


def create_nested(parents: DataFrame, new_parents: DataFrame, children: DataFrame, new_children: DataFrame, foreign: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Parents and their children in one write; children of parents not written are refused (left out)."""
    written = new_children.join(new_parents.select(F.col(key).alias(foreign)), foreign, "left_semi")
    return insert(parents, new_parents, [key]), insert(children, written, [key])
