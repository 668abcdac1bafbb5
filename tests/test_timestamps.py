from ledgerloom.operators.timestamps import normalise_timestamps


def read(spark, rows, profiles=None):
    profiles = profiles or [("in", "Asia/Kolkata", "DMY"), ("us", "America/New_York", "MDY"), ("fr", "Europe/Paris", "DMY"), ("none", "UTC", None)]
    v = spark.createDataFrame(rows, "id string, raw string, feed string, zone string, format string")
    p = spark.createDataFrame(profiles, "feed string, zone_name string, date_order string")
    return {r.id: r for r in normalise_timestamps(v, p, "id", "raw", "feed").collect()}


def test_notations_agree_on_one_instant(spark):
    same = ["2025-03-05 10:00:00", "05/03/2025 10:00", "5 Mar 2025 10:00", "March 5, 2025 at 10:00 AM", "20250305T043000Z", "1741149000", "1741149000123", "1741149000.5", "2025-03-05T10:00:00+05:30", "Wed, 05 Mar 2025 10:00:00 +0530", "2025-W10-3 10:00", "2025-03-05 10:00:00 IST", "Dt. 05MAR2025 10:00", "5 mars 2025 à 10h00", "5. März 2025, 10:00 Uhr", "2025-03-05T04:30[UTC]", "2025-03-05T10:00:00−" + "0000".replace("0000", "00:00")]
    got = read(spark, [(str(i), s, "in", "x", "y") for i, s in enumerate(same)])
    assert {got[str(i)].utc_second for i in range(len(same) - 1)} == {1741149000}
    assert str(got["0"].local_date) == "2025-03-05"


def test_statuses(spark):
    rows = {
        "null": (None, "in", "unparsed"), "empty": ("", "in", "unparsed"), "talk": ("on delivery", "in", "unparsed"), "long": ("x" * 20000, "in", "unparsed"),
        "never": ("31/02/2025", "in", "impossible"), "order": ("12/25/2025", "in", "impossible"), "us": ("12/25/2025", "us", "resolved"), "gap": ("2025-03-09 02:30:00", "us", "nonexistent"), "twice": ("2025-11-02 01:30", "us", "repeated"),
        "told": ("2025-11-02 01:30:00 EDT", "us", "resolved"), "unknown_feed": ("2025-01-01", "??", "unparsed"), "unknown_feed_zoned": ("2025-01-01T00:00:00Z", "??", "resolved"), "hour": ("2025-01-01 25:00", "in", "unparsed"),
    }
    got = read(spark, [(k, raw, feed, "z", "f") for k, (raw, feed, _) in rows.items()])
    assert {k: got[k].status for k in rows} == {k: v[2] for k, v in rows.items()}
    assert all(got[k].utc_second is None for k, v in rows.items() if v[2] != "resolved")


def test_mixture_decides_where_no_order_is_declared(spark):
    clear = [(f"c{i}", f"{13 + i}/02/2025", "none", "", "") for i in range(12)]
    got = read(spark, [*clear, ("q", "03/04/2025", "none", "", ""), ("s", "04/04/2025", "none", "", "")])
    assert got["q"].format == "dmy" and got["q"].status == "resolved" and str(got["q"].local_date) == "2025-04-03"
    alone = read(spark, [("q", "03/04/2025", "none", "", ""), ("s", "04/04/2025", "none", "", "")])
    assert alone["q"].status == "ambiguous" and alone["s"].status == "resolved"


def test_empty_and_repeated(spark):
    assert read(spark, []) == {}
    v = spark.createDataFrame([("a", "2025-01-01", "in")] * 3, "id string, raw string, feed string")
    p = spark.createDataFrame([("in", "Asia/Kolkata", "DMY")] * 2, "feed string, zone_name string, date_order string")
    assert normalise_timestamps(v, p, "id", "raw", "feed").count() == 3
