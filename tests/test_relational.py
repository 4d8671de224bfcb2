from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codexframe.operators import dml
from codexframe.operators.relational import Model, NotFound, Relation, find_first, find_many, find_unique, group_by, matching, or_throw
from codexframe.sources.tables import SnapshotStore


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", 30, ["a", "b"]), (2, "bob", None, []), (3, "Cy", 25, ["b"]), (4, "dee", 30, None)]
    pets = [(10, 1, "cat"), (11, 1, "dog"), (12, 3, "cat"), (13, None, "fish")]
    owners = Model(spark.createDataFrame(rows, "id long, name string, age int, tags array<string>"), "id")
    animals = Model(spark.createDataFrame(pets, "id long, owner_id long, kind string"), "id")
    owners.relations = {"pets": Relation(animals, "owner_id")}
    animals.relations = {"owner": Relation(owners, "owner_id", many=False)}
    return owners, animals


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({}, [1, 2, 3, 4]),
        ({"age": 30}, [1, 4]),
        ({"age": None}, [2]),
        ({"age": {"not": 30}}, [3]),
        ({"age": {"not": {"gt": 26}}}, [3]),
        ({"age": {"notIn": [25]}}, [1, 4]),
        ({"age": {"gte": 25, "lt": 30}}, [3]),
        ({"name": {"startsWith": "A"}}, [1]),
        ({"name": {"contains": "E", "mode": "insensitive"}}, [4]),
        ({"tags": {"has": "b"}}, [1, 3]),
        ({"tags": {"hasEvery": ["a", "b"]}}, [1]),
        ({"tags": {"isEmpty": True}}, [2]),
        ({"OR": [{"age": 25}, {"name": "bob"}]}, [2, 3]),
        ({"NOT": [{"id": 1}, {"id": 2}]}, [3, 4]),
        ({"pets": {"some": {"kind": "cat"}}}, [1, 3]),
        ({"pets": {"none": {"kind": "dog"}}}, [2, 3, 4]),
        ({"pets": {"every": {"kind": "cat"}}}, [2, 3, 4]),
        ({"OR": [{"pets": {"some": {"kind": "dog"}}}, {"age": None}]}, [1, 2]),
    ],
)
def test_filters(people, where, want):
    assert sorted(ids(matching(people[0], where))) == want


def test_parent_conditions(people):
    assert sorted(ids(matching(people[1], {"owner": {"age": 30}}))) == [10, 11]
    assert sorted(ids(matching(people[1], {"owner": {"is": None}}))) == [13]
    assert sorted(ids(matching(people[1], {"owner": {"isNot": {"age": 30}}}))) == [12, 13]


def test_order_pages_and_cursors(people):
    owners, _ = people
    by_age = [{"age": "desc"}]
    assert ids(find_many(owners, order_by=by_age)) == [2, 1, 4, 3]  # nulls count as largest
    assert ids(find_many(owners, order_by=[{"age": {"sort": "desc", "nulls": "last"}}])) == [1, 4, 3, 2]
    assert ids(find_many(owners, order_by=by_age, skip=1, take=2)) == [1, 4]
    assert ids(find_many(owners, order_by=by_age, take=-2)) == [4, 3]
    assert ids(find_many(owners, order_by=by_age, cursor={"id": 1})) == [1, 4, 3]
    assert ids(find_many(owners, order_by=by_age, cursor={"id": 1}, skip=1, take=1)) == [4]
    assert ids(find_many(owners, order_by=by_age, cursor={"id": 4}, take=-2)) == [1, 4]
    assert ids(find_many(owners, order_by=by_age, cursor={"id": 99})) == []
    assert ids(find_many(owners, order_by=[{"pets": {"_count": "desc"}}])) == [1, 3, 2, 4]
    assert sorted(ids(find_many(owners, distinct=["age"], order_by=[{"id": "desc"}]))) == [2, 3, 4]
    assert ids(find_first(owners, {"age": 30}, [{"id": "desc"}])) == [4]


def test_includes_and_unique(people):
    owners, animals = people
    rows = {r.id: r for r in find_many(owners, include={"pets": {"order_by": [{"kind": "desc"}], "take": 1}, "_count": ["pets"]}).collect()}
    assert [p.kind for p in rows[1].pets] == ["dog"] and rows[2].pets == [] and rows[1].n_pets == 2
    assert {r.id: r.owner and r.owner.name for r in find_many(animals, include={"owner": {}}).collect()}[13] is None
    assert find_unique(owners, {"id": 3}, select=["name"]).first().name == "Cy"
    assert "age" not in find_many(owners, omit=["age"]).columns
    with pytest.raises(NotFound):
        or_throw(find_unique(owners, {"id": 9}))


def test_group_by_rules(people):
    owners, _ = people
    for bad in ({"by": []}, {"by": ["age"], "take": 1}, {"by": ["age"], "having": {"name": {"gt": "a"}}}, {"by": ["age"], "order_by": [{"name": "asc"}]}):
        with pytest.raises(ValueError, match="."):
            group_by(owners, wanted={"_count": ["_all"]}, **bad)
    rows = group_by(owners, ["age"], {"_count": ["_all"], "_max": ["id"]}, having={"id": {"_max": {"gt": 2}}}, order_by=[{"count_all": "desc"}]).collect()
    assert [(r.age, r.count_all, r.max_id) for r in rows] == [(30, 2, 4), (25, 1, 3)]


def test_writes(people, spark):
    df = people[0].df.select("id", "name", "age")
    row = lambda *r: spark.createDataFrame([r], "id long, name string, age int")
    state = lambda t: sorted(tuple(r) for r in t.collect())
    once = dml.upsert(df, row(1, "Eve", 1).unionByName(row(9, "New", 2)), ["id"], ["name"])
    assert state(once) == [(1, "Eve", 30), (2, "bob", None), (3, "Cy", 25), (4, "dee", 30), (9, "New", 2)]
    assert state(dml.upsert(once, row(1, "Eve", 1), ["id"], ["name"])) == state(once)
    assert state(dml.insert(df, row(1, "x", 0), ["id"], skip_duplicates=True)) == state(df)
    assert state(dml.conflicts(df, row(1, "x", 0).unionByName(row(7, "y", 0)), ["id"])) == [(1,)]
    assert state(dml.update(df, F.col("age") > 26, {"age": {"increment": 1}}))[0] == (1, "Ann", 31)
    assert state(dml.delete(df, F.col("age") > 26)) == [(2, "bob", None), (3, "Cy", 25)]
    pets = people[1].df
    left = dml.delete_cascade({"owner": df, "pet": pets}, "owner", df.where("id = 1").select("id"), cascades=[("pet", "owner_id", "owner")])
    assert ids(left["pet"].orderBy("id")) == [12, 13] and left["owner"].count() == 3
    assert sorted((r.id, r.owner_id) for r in dml.set_children(pets, pets.where("id = 13").select("id"), "owner_id", 1).collect()) == [(10, None), (11, None), (12, 3), (13, 1)]
    parents, children = dml.create_nested(df, row(20, "P", 1), pets, spark.createDataFrame([(30, 20, "cat"), (31, 99, "cat")], pets.schema), "owner_id")
    assert parents.count() == 5 and children.count() == 5


def test_snapshots_change_together(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "lib"))
    assert store.read("tag").count() == 0
    a, b = spark.range(3).toDF("x"), spark.range(2).toDF("x")
    store.commit({"a": a, "b": b})
    before = store.read("a")
    store.commit({"a": store.read("a").unionByName(a)})
    assert store.read("a").count() == 6 and store.read("b").count() == 2 and before.count() == 3
    late = SnapshotStore(spark, str(tmp_path / "lib"))
    late._number = lambda: 1  # another writer that saw the first commit only
    with pytest.raises(OSError, match="another writer"):
        late.commit({"a": b})
    assert store.read("a").count() == 6


def test_composite_keys_in_relations_pages_and_nested_reads(spark):
    """Keys of two columns through filters, counts, includes and pages that don't overlap."""
    from codexframe.operators.relational import Model, Relation, find_many

    shelf = Model(spark.createDataFrame([(h, s, f"{h}{s}") for h in "ab" for s in (1, 2)] + [("c", None, "c")], "hall string, nr int, label string"), ("hall", "nr"))
    book = Model(spark.createDataFrame([(i, "ab"[i % 2], i % 3, i % 4) for i in range(24)] + [(90, "a", None, 0), (91, None, 1, 0)], "id int, h string, s int, pages int"), "id")
    note = Model(spark.createDataFrame([(i, i % 5, f"n{i}") for i in range(20)], "note int, book int, text string"), "note")
    shelf.relations = {"books": Relation(book, ("h", "s"))}
    book.relations = {"shelf": Relation(shelf, ("h", "s"), many=False), "notes": Relation(note, "book")}
    books = [r for r in book.df.collect()]
    mine = lambda h, s: [b.id for b in books if b.h == h and b.s == s]
    keys = [(h, s) for h in "ab" for s in (1, 2)]

    got = {(r.hall, r.nr): r for r in find_many(shelf, include={"books": {"order_by": [{"pages": "desc"}], "take": 3, "include": {"notes": {"take": 1, "order_by": [{"note": "desc"}]}}}, "_count": ["books"]}).collect()}
    assert set(got) == {*keys, ("c", None)} and got["c", None].books == [] and got["c", None].n_books == 0
    for key in keys:
        want = sorted(mine(*key), key=lambda i: (-(i % 4), i))
        assert [b.id for b in got[key].books] == want[:3] and got[key].n_books == len(want)
        for b in got[key].books:
            assert [n.note for n in b.notes] == [max((n for n in range(20) if n % 5 == b.id), default=None)][: 1 if b.id < 5 else 0]
    some = find_many(shelf, {"books": {"some": {"pages": 3}}}, select=["hall", "nr"]).collect()
    assert {tuple(r) for r in some} == {k for k in keys if any(i % 4 == 3 for i in mine(*k))}
    none = find_many(shelf, {"books": {"none": {}}}, select=["hall", "nr"]).collect()
    assert {tuple(r) for r in none} == {("c", None)} | {k for k in keys if not mine(*k)}
    up = {r.id: r.shelf for r in find_many(book, {"shelf": {"is": {"nr": 2}}}, include={"shelf": {"include": {"_count": ["books"]}}}).collect()}
    assert set(up) == {b.id for b in books if b.s == 2 and b.h} and all(x.n_books == len(mine(x.hall, x.nr)) for x in up.values())
    assert {r.id for r in find_many(book, {"shelf": None}).collect()} == {90, 91}

    order, seen, cursor = [{"pages": "desc"}], [], None
    many = Model(book.df.select("h", "s", "pages", "id").where("h is not null"), ("h", "s", "id"))
    while True:
        page = find_many(many, order_by=order, take=5, cursor=cursor, skip=1 if cursor else 0).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = {"h": page[-1].h, "id": page[-1].id}
    assert len(seen) == len(set(seen)) == 25
    back = find_many(many, order_by=order, take=-5, cursor={"id": seen[10]}, skip=1).collect()
    assert [r.id for r in back] == seen[5:10]
