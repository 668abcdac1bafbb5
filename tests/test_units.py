import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators.units import changepoints, money_of, normalise_units, with_unit

REF = [("mass", "kg", "kg", 1.0), ("mass", "g", "kg", 0.001), ("count", "pcs", "pcs", 1.0), ("count", "doz", "pcs", 12.0), ("volume", "l", "l", 1.0)]


def test_units_in_text(spark):
    rows = [
        ("KGS.", "x", "kg", 1.0), ("pack of 5 kg", "x", "kg", 5.0), ("10pcs bag", "x", "pcs", 10.0), (None, "Foo resin (in ltr)", "l", 1.0), ("", "Foo [UoM: gross]", "gross", 1.0), ("BAG", "Foo (4 x 5 lb)", "lb", 20.0),
        ("box", "Foo box 6x2oz", "oz", 12.0), ("drum", "Foo, 25 kg drum", "kg", 25.0), ("lot", "Foo", None, None), (None, "Foo 4 mm wall", None, None), ("pcs", "Foo (4 x 5 lb)", "pcs", 1.0), (None, None, None, None), ("'000 nos", "Foo", "thousand", 1.0), ("u" * 9000, "d" * 9000, None, None),
    ]
    df = spark.createDataFrame([(i, u, d, "clash") for i, (u, d, *_) in enumerate(rows)], "i int, unit string, description string, _unit string")
    got = {r.i: (r.unit_code, r.pack_size) for r in with_unit(df).collect()}
    assert [got[i] for i in range(len(rows))] == [(c, n) for *_, c, n in rows]


def test_money_text(spark):
    df = spark.createDataFrame([("Inr ",), ("INR '000",), ("Rs. in thousands",), ("Rs. in lakhs",), ("€",), ("Pound Sterling",), ("beads",), (None,)], "c string")
    code, scale = money_of(F.col("c"))
    assert [tuple(r) for r in df.select(code, scale).collect()] == [("INR", 1.0), ("INR", 1000.0), ("INR", 1000.0), ("INR", 1e5), ("EUR", 1.0), ("GBP", 1.0), (None, 1.0), (None, None)]


def test_changepoints_are_exact():
    rng = random.Random(1)
    for _ in range(20):
        x = np.array([rng.choice([0, 0, 0, 3]) + rng.gauss(0, 0.3) for _ in range(9)])
        ones = np.ones(len(x))
        cost = lambda cuts: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, [*cuts[1:], len(x)])) + 1.5 * (len(cuts) - 1)  # noqa: E731,B023
        best = min(cost([0, *c]) for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k))
        assert math.isclose(cost(changepoints(ones, x, x * x, 1.5)), best, abs_tol=1e-9)


def test_history_tells_missing_units(spark):
    rows = [("o", f"l{d}", "p", "kg", None, 2.0, 100.0, f"2025-01-{d:02d}") for d in range(1, 21)] + [("o", "g", "p", None, "plain", 5000.0, 0.1, "2025-01-21"), ("o", "z", "p", "kg", None, None, None, None), ("o", "n", None, "kg", None, 1.0, 1.0, "2025-01-01")]
    df = spark.createDataFrame(rows, "org string, id string, product string, unit string, description string, quantity double, price_inr double, day string")
    ref = spark.createDataFrame(REF, "dimension string, unit_code string, base_unit string, factor double")
    got = {r.id: r for r in normalise_units(df, ref, ["org", "product"], "day").collect()}
    assert len(got) == len(rows)
    assert got["g"].basis == "history" and math.isclose(got["g"].quantity_base, 5.0, rel_tol=1e-6)
    assert got["l1"].basis == "unit" and got["l1"].price_base == 100.0 and got["z"].quantity_base is None
    assert normalise_units(df.limit(0), ref, ["org", "product"], "day").count() == 0


def test_unstated_change_of_unit_is_reversed(spark):
    # from day 21 on the source counts in grams, but still writes kg
    rows = [("o", f"l{d}", "p", "kg", None, 2.0, 100.0, f"2025-01-{d:02d}") for d in range(1, 21)] + [("o", f"g{d}", "p", "kg", None, 5000.0, 0.1, f"2025-01-{d:02d}") for d in range(21, 29)]
    df = spark.createDataFrame(rows, "org string, id string, product string, unit string, description string, quantity double, price_inr double, day string")
    got = {r.id: r for r in normalise_units(df, spark.createDataFrame(REF, "dimension string, unit_code string, base_unit string, factor double"), ["org", "product"], "day").collect()}
    assert not got["l1"].reversed and all(got[f"g{d}"].reversed for d in range(21, 29))
    assert math.isclose(got["g25"].quantity_base, 5.0, rel_tol=1e-6) and math.isclose(got["g25"].price_base, 100.0, rel_tol=1e-6)


def test_groups_over_many_batches(spark):
    from ledgerloom.operators.units import by_group

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(i % 5 if i < 60 else 9, i) for i in range(200)], "k int, v int")
        got = {r.k: (r.n, r.total) for r in by_group(df, ["k"], ["v"], lambda key, pdf: [(int(key[0]), len(pdf), int(pdf.v.sum()))], "k int, n int, total int").collect()}
        assert got == {**{k: (12, sum(range(k, 60, 5))) for k in range(5)}, 9: (140, sum(range(60, 200)))}
        assert by_group(df, ["k"], ["v"], lambda key, pdf: [(int(key[0]),)], "k int", least=13).count() == 1 and by_group(df.limit(0), ["k"], [], lambda key, pdf: [(1,)], "k int").count() == 0
        # after a join on the same keys, which becomes a broadcast join as it runs
        held = spark.createDataFrame([(i,) for i in (1, 9)], "k int").repartition(3).distinct()
        spread_out = df.repartition(16).groupBy("k", "v").agg(F.lit(1).alias("one")).join(held, ["k"], "left_semi")
        assert sorted((r.k, r.n) for r in by_group(spread_out, ["k"], ["v"], lambda key, pdf: [(int(key[0]), len(pdf))], "k int, n int").collect()) == [(1, 12), (9, 140)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
