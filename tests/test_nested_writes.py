"""Nested writes touch the chosen rows' descendants and nothing else."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codexframe.operators.nested_writes import Table, write

MODEL = {"shelf": Table("s", {"books": ("book", "shelf")}), "book": Table("b", {"notes": ("note", "book")}), "note": Table("n", {})}


def tables(spark):
    return {
        "shelf": spark.createDataFrame([(i, i) for i in range(3)], "s int, size int"),
        "book": spark.createDataFrame([(i, i % 3, i) for i in range(9)] + [(90, None, 1)], "b int, shelf int, pages int"),
        "note": spark.createDataFrame([(i, i % 9, 0) for i in range(18)] + [(99, None, 0)], "n int, book int, stars int"),
    }


def rows(done):
    return {name: sorted((tuple(r) for r in df.collect()), key=str) for name, df in done.items()}


def test_each_verb_stays_within_its_parents(spark):
    before = tables(spark)
    steps = {
        "deleteMany": [F.col("pages") == 4],  # book 4, with its notes 4 and 13
        "updateMany": [(F.col("pages") >= 0, {"pages": {"increment": 10}})],
        "upsert": [spark.createDataFrame([(7, 1, 70), (50, 1, 50), (51, 2, 51), (8, 1, 80)], "b int, shelf int, pages int")],  # 51 is another shelf's, and 8 is there
        "create": [spark.createDataFrame([(60, 1, 60), (61, None, 61), (7, 1, 0)], "b int, shelf int, pages int")],
        "each": [(F.col("pages") > 60, {"update": {"pages": 99}, "children": {"notes": {"updateMany": [(F.lit(True), {"stars": 5})]}}})],
    }
    # the choice is made before the update takes away what it looks at
    done = rows(write(before, MODEL, "shelf", F.col("size") == 1, {"update": {"size": -1}, "children": {"books": steps}}))
    assert done["shelf"] == sorted([(0, 0), (1, -1), (2, 2)], key=str)
    others = [(i, i % 3, i) for i in range(9) if i % 3 != 1] + [(90, None, 1)]
    assert done["book"] == sorted([*others, (1, 1, 11), (7, 1, 99), (50, 1, 50), (60, 1, 60)], key=str)
    notes = [(i, i % 9, 5 if i % 9 == 7 else 0) for i in range(18) if i % 9 != 4] + [(99, None, 0)]
    assert done["note"] == sorted(notes, key=str)


def test_no_row_chosen_and_unknown_verbs(spark):
    before = tables(spark)
    plan = {"update": {"size": 0}, "children": {"books": {"deleteMany": [F.lit(True)]}}}
    assert rows(write(before, MODEL, "shelf", F.col("size") > 10, plan)) == rows(before)
    assert rows(write(before, MODEL, "shelf", F.lit(None).cast("boolean"), plan)) == rows(before)
    everything = rows(write(before, MODEL, "shelf", F.lit(True), plan))
    assert everything["book"] == [(90, None, 1)] and everything["note"] == [(99, None, 0)]
    with pytest.raises(ValueError, match="unknown verbs"):
        write(before, MODEL, "shelf", F.lit(True), {"children": {"books": {"dropMany": []}}})
