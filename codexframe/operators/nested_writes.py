"""Writes over a tree of related tables: parents first, then what each verb does to their children, level by level."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.operators import dml

#: The order in which a level's verbs take effect; each sees the rows that those before it left.
VERBS = ("deleteMany", "updateMany", "upsert", "create")
_IN = "__in_scope"


@dataclass(frozen=True)
class Table:
    """A table's unique key, and its children: relation name to ``(table, foreign key)``."""

    key: str
    children: dict[str, tuple[str, str]]


def _scoped(rows: DataFrame, foreign: str, parents: DataFrame) -> DataFrame:
    """``rows`` with a flag: whether they belong to one of the parents (one column of keys)."""
    known = parents.toDF("__p").where("__p is not null").distinct().withColumn(_IN, F.lit(True))
    return rows.join(known, rows[foreign] == known["__p"], "left").drop("__p").withColumn(_IN, F.coalesce(_IN, F.lit(False)))


def write(tables: dict[str, DataFrame], model: dict[str, Table], name: str, where: Column, plan: dict[str, Any]) -> dict[str, DataFrame]:
    """Every table after one nested write to the rows of ``name`` that match ``where``.

    ``plan``: ``{"update": {column: change}, "children": {relation: steps}}``, with changes as in :func:`dml.update`.
    ``steps`` of a relation take effect on the children of the chosen rows alone, in order of ``VERBS``:
    ``deleteMany`` (conditions; their own descendants go too), ``updateMany`` (pairs of condition and changes),
    ``upsert`` and ``create`` (tables of rows; rows of other parents are refused, that is, left out; a created row whose key exists
    is skipped), and last ``each`` (pairs of condition and a further ``plan`` for the children that match it then).

    Rows are chosen before the update, so changing what ``where`` looks at doesn't lose the children. Only keys
    go from one level to the next, as a join; nothing is written until a returned table is.
    """
    return _write(tables, model, name, tables[name].where(F.coalesce(where, F.lit(False))).select(model[name].key), plan)


def _write(tables: dict[str, DataFrame], model: dict[str, Table], name: str, chosen: DataFrame, plan: dict[str, Any]) -> dict[str, DataFrame]:
    out, table = dict(tables), model[name]
    if plan.get("update"):
        marked = _scoped(out[name], table.key, chosen)
        out[name] = dml.update(marked, F.col(_IN), plan["update"]).drop(_IN)
    for relation, steps in plan.get("children", {}).items():
        child, foreign = table.children[relation]
        unknown = set(steps) - {*VERBS, "each"}
        if unknown:
            raise ValueError(f"unknown verbs {sorted(unknown)}")
        for verb in VERBS:
            for step in steps.get(verb, []):
                out = _step(out, model, child, foreign, chosen, verb, step)
        for condition, below in steps.get("each", []):
            met = _scoped(out[child], foreign, chosen).where(F.col(_IN) & F.coalesce(condition, F.lit(False)))
            out = _write(out, model, child, met.select(model[child].key), below)
    return out


def _step(tables: dict[str, DataFrame], model: dict[str, Table], child: str, foreign: str, chosen: DataFrame, verb: str, step: Any) -> dict[str, DataFrame]:
    key, rows = model[child].key, tables[child]
    if verb in ("upsert", "create"):
        mine = step.join(chosen.toDF("__p").distinct(), F.col(foreign) == F.col("__p"), "left_semi")
        if verb == "create":
            return {**tables, child: dml.insert(rows, mine, [key], skip_duplicates=True)}
        others = _scoped(rows, foreign, chosen).where(~F.col(_IN)).select(key)
        return {**tables, child: dml.upsert(rows, mine.join(others, key, "left_anti"), [key])}
    marked = _scoped(rows, foreign, chosen)
    if verb == "updateMany":
        condition, changes = step
        return {**tables, child: dml.update(marked, F.col(_IN) & condition, changes).drop(_IN)}
    gone = marked.where(F.col(_IN) & F.coalesce(step, F.lit(False))).select(key)
    return _without(tables, model, child, gone)


def _without(tables: dict[str, DataFrame], model: dict[str, Table], name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of these keys and their descendants."""
    out, key = dict(tables), model[name].key
    for child, foreign in model[name].children.values():
        orphans = out[child].join(keys.toDF("__p").distinct(), F.col(foreign) == F.col("__p"), "left_semi").select(model[child].key)
        out = _without(out, model, child, orphans)
    return {**out, name: dml.delete_keys(out[name], keys, key)}
