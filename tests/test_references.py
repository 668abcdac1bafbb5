import pytest

from ledgerloom.operators.references import orphan_references


def orphans(spark, refs, targets, match):
    r = spark.createDataFrame(refs, "id string, a string, b string, extra int")
    t = spark.createDataFrame(targets, "x string, y string")
    return sorted(x.id for x in orphan_references(r, t, {"a": "x", "b": "y"}, match=match).collect())


REFS = [("both", "1", "2", 0), ("wrong", "1", "9", 0), ("left", "1", None, 0), ("right", None, "9", 0), ("none", None, None, 0), ("wrong", "1", "9", 1)]
TARGETS = [("1", "2"), ("1", "2"), ("3", None), (None, None)]


@pytest.mark.parametrize(("match", "expected"), [("simple", ["wrong", "wrong"]), ("full", ["left", "right", "wrong", "wrong"]), ("partial", ["right", "wrong", "wrong"])])
def test_match_semantics(spark, match, expected):
    assert orphans(spark, REFS, TARGETS, match) == expected


def test_empty_tables(spark):
    assert orphans(spark, [], TARGETS, "simple") == []
    assert orphans(spark, REFS, [], "partial") == ["both", "left", "right", "wrong", "wrong"]


def test_periods(spark):
    r = spark.createDataFrame([("a", "o", "k", 5), ("b", "o", "k", 9), ("c", None, "k", 5)], "id string, org string, key string, month int")
    t = spark.createDataFrame([("o", "k", 6, 9), ("o", "k", 4, 6)], "org string, key string, f int, t int")
    got = orphan_references(r, t, {"key": "key"}, {"org": "org"}, "simple", "month", ("f", "t")).collect()
    assert sorted(x.id for x in got) == ["b", "c"]
