import random

import pytest
from pyspark.sql import types as T

from marlstone.operators.filters import DEPTH, Filter, as_filter, compile_filter, where

ROWS = [(i, i if i % 10 else None, i / 10, i % 2 == 0, "abc"[i % 3], [f"t{i % 4}"] if i % 9 else None) for i in range(100)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, n long, x double, even boolean, c string, t array<string>").cache()


def ids(df, f, **k):
    return sorted(r.id for r in where(df, f, **k).select("id").collect())


def test_counts(table):
    assert len(ids(table, Filter.ne("c", "a"))) == 66
    assert len(ids(table, Filter.between("x", 1.0, 1.95))) == 10
    assert len(ids(table, ~Filter.eq("n", 5))) == 99 and len(ids(table, Filter.ne("n", 5))) == 89
    assert ids(table, Filter.in_("c", [])) == [] and len(ids(table, Filter.has_all_tags("t", []))) == 88
    assert ids(table, Filter.has_any_tag("t", [])) == [] and len(ids(table, ~Filter.has_any_tag("t", []))) == 100
    assert len(ids(table, Filter.in_("even", [True, False]))) == 100 and ids(table, Filter.between("n", 5, 4)) == []
    assert ids(table, {"c": ["a", "b"], "n": {"lt": 5}}) == [1, 3, 4]


def test_unknown_fields_and_wrong_types(table):
    with pytest.raises(ValueError):
        where(table, Filter.eq("nope", 1))
    assert ids(table, Filter.eq("nope", 1), strict=False) == [] and len(ids(table, ~Filter.eq("nope", 1), strict=False)) == 100
    for f in (Filter.lt("c", "b"), Filter.eq("n", "1"), Filter.eq("c", 1), Filter.eq("t", "t1"), Filter.has_tag("c", "a"), Filter.eq("n", True), Filter.between("c", 1, 2), Filter.in_("t", ["t1"])):
        with pytest.raises(ValueError):
            where(table, f)
    with pytest.raises(ValueError):
        Filter.eq("x", float("nan"))
    with pytest.raises(ValueError):
        Filter.geo_radius("x", "n", 95, 0, 1)


def test_depth(table):
    f = Filter.eq("n", 1)
    for _ in range(DEPTH + 5):
        f = ~f
    with pytest.raises(ValueError):
        where(table, f)


def test_numbers_are_compared_exactly(spark):
    big = 2**53
    values = [big - 1, big, big + 1, big + 2, 2**63 - 1, -(2**63), 0]
    ints = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    floats = [float(big), float(big + 2), 0.5, -1e300, 9.3e18, 0.0]
    doubles = spark.createDataFrame([(i, v) for i, v in enumerate(floats)], "id long, v double")
    import operator as o

    ops = {Filter.eq: o.eq, Filter.ne: o.ne, Filter.lt: o.lt, Filter.le: o.le, Filter.gt: o.gt, Filter.ge: o.ge}
    for f, op in ops.items():
        for c in (float(big), 0.5, 1e19, -1e19, float("inf"), 2.0**63, -(2.0**63)):
            assert ids(ints, f("v", c)) == [i for i, v in enumerate(values) if op(v, c)], (f, c)
        for c in (big + 1, big, 2**63, 10**400, -(10**400), 0):
            assert ids(doubles, f("v", c)) == [i for i, v in enumerate(floats) if op(v, c)], (f, c)


def holds(f, row):
    v = row.get(f.name)
    if f.op == "and":
        return all(holds(p, row) for p in f.parts)
    if f.op == "or":
        return any(holds(p, row) for p in f.parts)
    if f.op == "not":
        return not holds(f.parts[0], row)
    if f.op == "all":
        return True
    if v is None:
        return False
    if f.op == "in":
        return v in f.values
    if f.op == "between":
        return f.values[0] <= v <= f.values[1]
    if f.op == "exists":
        return True
    if f.op == "any_tag":
        return bool(set(f.values) & set(v))
    if f.op == "all_tags":
        return set(f.values) <= set(v)
    import operator as o

    return {"eq": o.eq, "ne": o.ne, "lt": o.lt, "le": o.le, "gt": o.gt, "ge": o.ge}[f.op](v, f.values[0])


def test_random_filters(table):
    rng = random.Random(11)

    def leaf():
        kind = rng.choice("nxecttg")
        if kind == "n":
            return rng.choice([Filter.eq, Filter.ne, Filter.lt, Filter.le, Filter.gt, Filter.ge])("n", rng.choice([5, 50.5, 30.0, -1]))
        if kind == "x":
            return rng.choice([Filter.between("x", 2, 7.5), Filter.in_("x", [1, 2.5, 3]), Filter.lt("x", 4)])
        if kind == "e":
            return rng.choice([Filter.eq, Filter.ne])("even", rng.random() < 0.5)
        if kind == "c":
            return rng.choice([Filter.eq("c", "a"), Filter.in_("c", ["a", "z"]), Filter.exists("c"), Filter.all()])
        return rng.choice([Filter.has_tag("t", "t1"), Filter.has_any_tag("t", ["t2", "t3"]), Filter.has_all_tags("t", ["t1", "t2"]), Filter.exists("t"), Filter.missing("n"), Filter.has_any_tag("t", []), Filter.in_("n", [])])

    def tree(d):
        if d == 0 or rng.random() < 0.3:
            return leaf()
        return ~tree(d - 1) if rng.random() < 0.3 else rng.choice([Filter.all_of, Filter.any_of])([tree(d - 1) for _ in range(rng.randrange(1, 4))])

    names = ("id", "n", "x", "even", "c", "t")
    filters = [tree(4) for _ in range(150)]
    columns = [compile_filter(f, table.schema).alias(f"f{k}") for k, f in enumerate(filters)]
    got = table.select("id", *columns).orderBy("id").collect()
    for r, row in zip(got, ROWS):
        d = dict(zip(names, row))
        assert [bool(r[f"f{k}"]) for k in range(len(filters))] == [holds(f, d) for f in filters]


def test_filters_reach_the_reader(spark, tmp_path):
    spark.createDataFrame(ROWS, "id long, n long, x double, even boolean, c string, t array<string>").write.parquet(str(tmp_path / "t"))
    plan = where(spark.read.parquet(str(tmp_path / "t")), Filter.gt("n", 3.5) & ~Filter.eq("c", "a")).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,3)" in plan and "Or(IsNull(c)" in plan


def test_geo(spark):
    places = [("london", 51.5, -0.12), ("paris", 48.85, 2.35), ("nyc", 40.7, -74.0), ("suva", -18.1, 178.4), ("apia", -13.8, -171.8), ("nowhere", None, 1.0), ("off", 95.0, 0.0)]
    t = spark.createDataFrame(places, "name string, lat double, lon double")
    names = lambda f: sorted(r.name for r in where(t, f).collect())
    assert names(Filter.geo_radius("lat", "lon", 51.5, -0.12, 400_000)) == ["london", "paris"]
    assert names(Filter.geo_box("lat", "lon", -30, 170, 0, -170)) == ["apia", "suva"]
    assert "nowhere" in names(~Filter.geo_box("lat", "lon", -90, -180, 90, 180))


def test_dicts():
    assert as_filter(None) is None and as_filter({}).op == "all"
    with pytest.raises(ValueError):
        as_filter({"a": {"like": 1}})
    assert compile_filter({"a": 1}, {"a": T.LongType()}) is not None
