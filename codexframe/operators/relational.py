"""Typed reads over related tables: filters, relation quantifiers, paging, aggregates.

Arguments are plain dictionaries, as a client sends them; each compiles to DataFrame expressions, so
filters and column selection reach the scan. A relation predicate becomes a semi-join flag, which also
works below OR.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Where = dict[str, Any]
#: A key of one column, or of several.
Key = str | tuple[str, ...]


@dataclass
class Relation:
    """``many``: ``model`` has ``foreign_key`` to our key; else we hold ``foreign_key`` to its key.

    To a key of several columns a foreign key has as many, in the same order.
    """

    model: Model
    foreign_key: Key
    many: bool = True


@dataclass
class Model:
    """A table with its unique key and relations."""

    df: DataFrame
    key: Key
    relations: dict[str, Relation] = field(default_factory=dict)


class NotFound(LookupError):
    """A read that must find a row found none."""


_FLAG = itertools.count()


def _scalar(column: Column, test: Any) -> Column:
    if not isinstance(test, dict):
        return column.isNull() if test is None else column == test
    fold = test.get("mode") == "insensitive"
    low = lambda x: F.lower(x if isinstance(x, Column) else F.lit(x)) if fold else x
    mine = F.lower(column) if fold else column
    parts = []
    for op, value in test.items():
        if op == "mode":
            continue
        if op == "equals":
            parts.append(column.isNull() if value is None else mine == low(value))
        elif op == "not":
            if value is None:
                parts.append(column.isNotNull())
            else:
                parts.append(~_scalar(column, {**value, **({"mode": "insensitive"} if fold else {})} if isinstance(value, dict) else {"equals": value, **({"mode": "insensitive"} if fold else {})}))
        elif op in ("in", "notIn"):
            inside = mine.isin([v.lower() if fold and isinstance(v, str) else v for v in value])
            parts.append(inside if op == "in" else ~inside)
        elif op in ("lt", "lte", "gt", "gte"):
            other = low(value)
            parts.append({"lt": mine < other, "lte": mine <= other, "gt": mine > other, "gte": mine >= other}[op])
        elif op == "contains":
            parts.append(mine.contains(low(value)))
        elif op == "startsWith":
            parts.append(mine.startswith(low(value)))
        elif op == "endsWith":
            parts.append(mine.endswith(low(value)))
        elif op == "has":
            parts.append(F.array_contains(column, value))
        elif op == "hasEvery":
            parts.append(F.size(F.array_except(F.array(*[F.lit(v) for v in value]), column)) == 0 if value else F.lit(True))
        elif op == "hasSome":
            parts.append(F.arrays_overlap(column, F.array(*[F.lit(v) for v in value])) if value else F.lit(False))
        elif op == "isEmpty":
            parts.append((F.size(column) == 0) == F.lit(value))
        else:
            raise ValueError(f"unknown filter {op!r}")
    return _all(parts)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _left(df: DataFrame, on: Key, right: DataFrame, key: Key) -> DataFrame:
    """``df`` left joined with ``right`` where ``on`` equals its ``key``, which is left out."""
    hidden = {name: f"__k{next(_FLAG)}" for name in _names(key)}
    right = right.withColumnsRenamed(hidden)
    return df.join(right, _all([df[a] == right[hidden[b]] for a, b in zip(_names(on), _names(key), strict=True)]), "left").drop(*hidden.values())


def _flagged(df: DataFrame, keys: DataFrame, on: Key) -> tuple[DataFrame, Column]:
    """``df`` with a flag: whether its columns ``on`` are among the rows of ``keys``, column by column."""
    name = f"__flag{next(_FLAG)}"
    known = keys.toDF(*[f"{name}k{i}" for i in range(len(keys.columns))])
    known = known.where(_all([F.col(c).isNotNull() for c in known.columns])).distinct()
    joined = _left(df, on, known.withColumn(name, F.lit(True)), tuple(known.columns))
    return joined, F.coalesce(F.col(name), F.lit(False))


def matching(model: Model, where: Where | None) -> DataFrame:
    """The rows of a model that fulfil ``where``, in its columns."""
    df, condition = _compile(model.df, model, where or {})
    return df.where(condition).select(*model.df.columns)


def _compile(df: DataFrame, model: Model, where: Where) -> tuple[DataFrame, Column]:
    parts: list[Column] = []
    for name, test in where.items():
        if name in ("AND", "OR", "NOT"):
            found = []
            for sub in test if isinstance(test, list) else [test]:
                df, c = _compile(df, model, sub)
                found.append(c)
            if name == "OR":
                either = F.lit(False)
                for c in found:
                    either = either | c
                parts.append(either)
            else:
                parts.append(_all(found) if name == "AND" else _all([~c for c in found]))
        elif name in model.relations:
            relation = model.relations[name]
            other = relation.model
            if relation.many:
                for quantifier, sub in test.items():
                    if quantifier == "every":
                        hit, c = _compile(other.df, other, sub)
                        keys = hit.where(~F.coalesce(c, F.lit(False))).select(*_names(relation.foreign_key))
                    else:
                        keys = matching(other, sub).select(*_names(relation.foreign_key))
                    df, flag = _flagged(df, keys, model.key)
                    parts.append(flag if quantifier == "some" else ~flag)
            else:
                quantified = set(test) <= {"is", "isNot"} if isinstance(test, dict) and test else False
                for quantifier, sub in test.items() if quantified else [("is", test)]:
                    if sub is None:
                        missing = ~_all([F.col(c).isNotNull() for c in _names(relation.foreign_key)])
                        parts.append(missing == F.lit(quantifier == "is"))
                        continue
                    df, flag = _flagged(df, matching(other, sub).select(*_names(other.key)), relation.foreign_key)
                    parts.append(flag if quantifier == "is" else ~flag)
        else:
            parts.append(_scalar(F.col(name), test))
    return df, _all(parts)


def _direction(spec: Any) -> tuple[bool, bool]:
    """``(descending, nulls first)``; by default nulls count as largest."""
    spec = {"sort": spec} if isinstance(spec, str) else spec
    down = spec["sort"] == "desc"
    return down, spec.get("nulls", "first" if down else "last") == "first"


def _ordering(df: DataFrame, model: Model, order_by: list[dict]) -> tuple[DataFrame, list[tuple[str, bool, bool]]]:
    keys: list[tuple[str, bool, bool]] = []
    for item in order_by:
        ((name, spec),) = item.items()
        if name in model.relations:
            relation, hidden = model.relations[name], f"__order{next(_FLAG)}"
            ((sub, sub_spec),) = spec.items()
            if sub == "_count":
                counts = relation.model.df.groupBy(*_names(relation.foreign_key)).agg(F.count(F.lit(1)).alias(hidden))
                df = _left(df, model.key, counts, relation.foreign_key)
                df = df.withColumn(hidden, F.coalesce(hidden, F.lit(0)))
            else:
                other = relation.model.df.select(*_names(relation.model.key), F.col(sub).alias(hidden))
                df = _left(df, relation.foreign_key, other, relation.model.key)
            keys.append((hidden, *_direction(sub_spec)))
        else:
            keys.append((name, *_direction(spec)))
    # a total order, so that pages don't overlap
    keys += [(c, False, False) for c in _names(model.key) if c not in [k for k, _, _ in keys]]
    return df, keys


def _sorted(keys: list[tuple[str, bool, bool]], reverse: bool = False) -> list[Column]:
    out = []
    for name, down, first in keys:
        c = F.col(name)
        down, first = down != reverse, first != reverse
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def _from_cursor(df: DataFrame, keys: list[tuple[str, bool, bool]], cursor: dict, backwards: bool) -> DataFrame:
    """Rows at or after the cursor's row in the order; none if there is no such row."""
    at = df.where(_all([F.col(k) == v for k, v in cursor.items()])).limit(1)
    at = at.select(*[F.col(name).alias(f"__c{i}") for i, (name, _, _) in enumerate(keys)])
    same, after = F.lit(True), F.lit(False)
    for i, (name, down, first) in enumerate(keys):
        mine, its = F.col(name), F.col(f"__c{i}")
        down, first = down != backwards, first != backwards
        beyond = (mine < its) if down else (mine > its)
        beyond = F.coalesce(beyond, F.lit(False)) | ((its.isNull() & mine.isNotNull()) if first else (its.isNotNull() & mine.isNull()))
        after, same = after | (same & beyond), same & mine.eqNullSafe(its)
    return df.join(F.broadcast(at), after | same).drop(*[f"__c{i}" for i in range(len(keys))])  # one row


def find_many(
    model: Model,
    where: Where | None = None,
    order_by: list[dict] | None = None,
    take: int | None = None,
    skip: int = 0,
    cursor: dict | None = None,
    distinct: list[str] | None = None,
    select: list[str] | None = None,
    omit: list[str] | None = None,
    include: dict[str, Any] | None = None,
) -> DataFrame:
    """Rows in order, from ``cursor`` on, after ``skip``, ``take`` at most; a negative ``take`` reads backwards.

    ``cursor`` names a row by its key, or any columns that do; the page starts there in the order of
    ``order_by`` and then of the whole key, compared as one row value. ``distinct`` keeps the first row, in the order,
    of each combination. ``include`` nests relations to any depth: a to-one as a struct, a to-many as an
    array (``{"where": {...}, "order_by": [...], "take": n, "select": [...], "include": {...}}``), and ``_count`` with a list of
    relations as numbers.
    """
    df, keys = _ordering(matching(model, where), model, order_by or [])
    backwards = take is not None and take < 0
    if cursor:
        df = _from_cursor(df, keys, cursor, backwards)
    if distinct:
        first = Window.partitionBy(*distinct).orderBy(*_sorted(keys, backwards))
        df = df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if skip or take is not None:
        df = df.orderBy(*_sorted(keys, backwards))
        df = df.offset(skip) if skip else df
        df = df.limit(abs(take)) if take is not None else df
    df = _included(df, model, include)
    hidden = [c for c in df.columns if c.startswith("__")]
    if order_by is not None or take is not None:
        df = df.orderBy(*_sorted(keys))
    names = select or [c for c in df.columns if c not in (omit or []) and c not in hidden]
    return df.select(*names)


def _included(df: DataFrame, model: Model, include: dict[str, Any] | None) -> DataFrame:
    for name, options in (include or {}).items():
        df = _counted(df, model, options) if name == "_count" else _nested(df, model, name, options if isinstance(options, dict) else {})
    return df


def _counted(df: DataFrame, model: Model, names: list[str]) -> DataFrame:
    for name in names:  # each child is counted before it is joined, so counts don't multiply
        relation = model.relations[name]
        counts = relation.model.df.groupBy(*_names(relation.foreign_key)).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        df = _left(df, model.key, counts, relation.foreign_key).withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return df


def _nested(df: DataFrame, model: Model, name: str, options: dict) -> DataFrame:
    """One relation as a column, from the bottom up: a level is whole, one row a parent, before the level above takes it.

    A level's own filter, order and ``take`` come before its includes, so those are read for the rows that stay.
    """
    relation = model.relations[name]
    other, below = relation.model, options.get("include") or {}
    rows = matching(other, options.get("where"))
    added = [f"n_{c}" for c in below.get("_count", [])] + [c for c in below if c != "_count"]
    fields = [*(options.get("select") or other.df.columns), *added]
    if not relation.many:
        keys = [F.col(c).alias(f"__one{i}") for i, c in enumerate(_names(other.key))]
        one = _included(rows, other, below).select(*keys, F.struct(*fields).alias(name))
        return _left(df, relation.foreign_key, one, tuple(c for c in one.columns if c != name))
    rows, keys = _ordering(rows, other, options.get("order_by") or [])
    parent = _names(relation.foreign_key)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*parent).orderBy(*_sorted(keys))))
    if "take" in options:
        ranked = ranked.where(F.col("__n") <= options["take"])
    items = F.sort_array(F.collect_list(F.struct("__n", F.struct(*fields).alias("row"))))
    lists = _included(ranked, other, below).groupBy(*parent).agg(F.transform(items, lambda x: x["row"]).alias(name))
    joined = _left(df, model.key, lists, relation.foreign_key)
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def find_first(model: Model, where: Where | None = None, order_by: list[dict] | None = None, **more) -> DataFrame:
    return find_many(model, where, order_by, take=1, **more)


def find_unique(model: Model, key: dict[str, Any], **more) -> DataFrame:
    """The row with a unique key (of one or more columns), or none."""
    return find_many(model, key, **more).limit(1)


def or_throw(found: DataFrame) -> DataFrame:
    """The same rows; raises :class:`NotFound` if there are none."""
    if found.isEmpty():
        raise NotFound("no row found")
    return found


def count(model: Model, where: Where | None = None, select: list[str] | None = None) -> DataFrame:
    """One row: ``_all``, and the non-null count of each selected column."""
    chosen = [F.count(F.lit(1)).alias("_all")] + [F.count(c).alias(c) for c in select or [] if c != "_all"]
    return matching(model, where).agg(*chosen)


_AGGREGATES = {"_count": F.count, "_avg": F.avg, "_sum": F.sum, "_min": F.min, "_max": F.max}


def _aggregates(wanted: dict[str, list[str]]) -> list[Column]:
    out = []
    for kind, names in wanted.items():
        for name in names:
            out.append(F.count(F.lit(1)).alias("count_all") if name == "_all" else _AGGREGATES[kind](name).alias(f"{kind[1:]}_{name}"))
    return out


def aggregate(model: Model, wanted: dict[str, list[str]], where: Where | None = None, **page) -> DataFrame:
    """One row of ``count_x, avg_x, sum_x, min_x, max_x`` (``_all``: ``count_all``), over a page if one is given."""
    rows = find_many(model, where, **page) if page else matching(model, where)
    return rows.agg(*_aggregates(wanted))


def group_by(
    model: Model,
    by: list[str],
    wanted: dict[str, list[str]],
    where: Where | None = None,
    having: dict[str, dict[str, Any]] | None = None,
    order_by: list[dict] | None = None,
    take: int | None = None,
    skip: int = 0,
) -> DataFrame:
    """Aggregates per group. ``having``: ``{column: {"_avg": {"gt": 3}}}`` or a filter on a group column."""
    if not by:
        raise ValueError("by must name a column")
    if (take is not None or skip) and not order_by:
        raise ValueError("take and skip need order_by")
    tests, extra = [], []
    for name, test in (having or {}).items():
        if set(test) <= set(_AGGREGATES):
            for kind, bound in test.items():
                hidden = f"__h{len(extra)}"
                extra.append(_AGGREGATES[kind](name).alias(hidden))
                tests.append(_scalar(F.col(hidden), bound))
        elif name in by:
            tests.append(_scalar(F.col(name), test))
        else:
            raise ValueError(f"having may name {name!r} only within an aggregate")
    groups = matching(model, where).groupBy(*by).agg(*_aggregates(wanted), *extra).where(_all(tests))
    keys = []
    for item in order_by or []:
        ((name, spec),) = item.items()
        if isinstance(spec, dict) and "sort" not in spec:  # {"_count": {"x": "desc"}}
            raise ValueError("order_by takes a column or an aggregate's name")
        if name not in groups.columns:
            raise ValueError(f"order_by column {name!r} is not in the result")
        keys.append((name, *_direction(spec)))
    if keys:
        keys += [(k, False, False) for k in by if k not in [n for n, _, _ in keys]]
        groups = groups.orderBy(*_sorted(keys))
        groups = groups.offset(skip) if skip else groups
        groups = groups.limit(take).orderBy(*_sorted(keys)) if take is not None else groups
    return groups.drop(*[c for c in groups.columns if c.startswith("__h")])


def raw_query(tables: dict[str, DataFrame], sql: str, args: dict[str, Any] | list[Any] | None = None) -> DataFrame:
    """SQL with bound parameters over named tables; values never become part of the text."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)
