"""llm operators on small tables against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import premises, same_premises
from ledgerloom.llm.components import components
from ledgerloom.llm.mixing import mix_sources, shares
from ledgerloom.llm.names import resolve, same_entity
from ledgerloom.llm.ocr_text import repaired
from ledgerloom.llm.packing import pack
from ledgerloom.llm.spans import shared_amounts, shared_spans
from ledgerloom.llm.splitting import split_texts
from ledgerloom.llm.tokens import encoding, with_tokens


def test_split(spark):
    long = "word " * 50_000
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 2500, 0), (4, "a. " * 600, 0), (5, "short", 0), (5, "short", 0), (6, long, 0)]
    got = split_texts(spark.createDataFrame(rows, "id int, text string, piece_no int"), "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert 1 not in by and len(by[5]) == 2 and by[2][0].piece == "" and by[3][0].boundary == "none" and by[4][0].boundary == "sentence"
    pieces = sorted(by[6], key=lambda r: r.piece_no)
    assert pieces[0].piece + "".join(p.piece[100:] for p in pieces[1:]) == long and max(len(p.piece) for p in pieces) <= 1000
    assert split_texts(spark.createDataFrame([], "id int, text string")).count() == 0


@pytest.mark.parametrize("limit", [1000, 1])
def test_shared_spans(spark, limit):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ü\n") for _ in range(n))
    common = [word(n) for n in (260, 400, 199, 230)]
    docs = [(i, word(rng.randint(0, 300)) + rng.choice(common)[: rng.choice([None, 210, 199])] + word(rng.randint(0, 200)) + rng.choice(common)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, "z" * 900), (104, "z" * 600), (105, "y" * 600)]
    seen = {}
    for i, t in docs:
        for a in range(len(t or "") - 199):
            seen.setdefault(t[a : a + 200], set()).add(i)
    truth = {}
    for i, t in docs:
        hit = {p for a in range(len(t or "") - 199) if len(seen[t[a : a + 200]]) > 1 for p in range(a, a + 200)}
        if hit:
            truth[i] = len(hit)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, anchor string")
    got = {}
    for r in shared_spans(df, "doc_id", "text", group_limit=limit).collect():
        got.setdefault(r.id, set()).update(range(r.start, r.end))
    assert {k: len(v) for k, v in got.items()} == truth and 105 not in got
    if limit > 1:
        assert {r.doc_id: r.shared_chars for r in shared_amounts(df, "doc_id", "text").collect()} == truth
        assert shared_amounts(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("limit", [1000, 1])
def test_shared_spans_repeated_in_the_lowest_record(spark, limit):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ü\n") for _ in range(n))
    docs = []
    for n in range(20):  # the lower record of each pair repeats a part of the shared passage
        passage = word(600)
        a = rng.randint(0, 300)
        docs += [(2 * n, passage + word(50) + passage[a : a + 210 + n] + word(50)), (2 * n + 1, word(50) + passage + word(50))]
    seen = {}
    for i, t in docs:
        for a in range(len(t) - 199):
            seen.setdefault(t[a : a + 200], set()).add(i)
    truth = {i: {p for a in range(len(t) - 199) if len(seen[t[a : a + 200]]) > 1 for p in range(a, a + 200)} for i, t in docs}
    got = {}
    for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", group_limit=limit).collect():
        got.setdefault(r.id, set()).update(range(r.start, r.end))
    assert got == truth


@pytest.mark.parametrize("limit", [1000, 1])
def test_shared_spans_of_periodic_texts(spark, limit, monkeypatch):
    from ledgerloom.llm import spans

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ü\n") for _ in range(n))
    tail = word(150)
    docs = [(n, word(100) + c * 600 + tail + c * 300 + word(100)) for n, c in enumerate("zqkxvw")]
    docs += [(n + 10, word(100) + c * 180 + tail + word(100)) for n, c in enumerate("zqkxvw")] + [(n + 20, word(100) + c * 250 + word(100)) for n, c in enumerate("zqk")]
    seen = {}
    for i, t in docs:
        for a in range(len(t) - 199):
            seen.setdefault(t[a : a + 200], set()).add(i)
    truth = {i: hit for i, t in docs if (hit := {p for a in range(len(t) - 199) if len(seen[t[a : a + 200]]) > 1 for p in range(a, a + 200)})}
    largest = []

    def watched(df, keys, *more, **options):
        largest.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return by_group(df, keys, *more, **options)

    by_group = spans.by_group
    monkeypatch.setattr(spans, "by_group", watched)
    got = {}
    for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", group_limit=limit).collect():
        got.setdefault(r.id, set()).update(range(r.start, r.end))
    assert got == truth and max(largest) < 50


def test_pack(spark):
    rows = [(i, i % 7 * 100) for i in range(300)] + [(1000, 9000), (1001, 4096), (1002, 0), (1003, None)]
    got = pack(spark.createDataFrame(rows, "id long, size int"), "id", "size", 4096).collect()
    fill, tokens = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        tokens[r.id] = tokens.get(r.id, 0) + r.tokens
    assert tokens == {i: s for i, s in rows if s is not None} and max(fill.values()) <= 4096 and len(fill) == -(-sum(tokens.values()) // 4096)
    assert [r.tokens for r in sorted((r for r in got if r.id == 1000), key=lambda r: r.piece_no)] == [4096, 4096, 808]
    assert pack(spark.createDataFrame([], "id long, size int"), "id", "size").count() == 0
    assert pack(spark.createDataFrame([(1, 0)], "id long, size int"), "id", "size").count() == 1


def test_tokens(spark):
    texts = ["", "hello world", "  a\n\nb <|endoftext|> ünï", None, "x" * 5000]
    got = [r.tokens for r in with_tokens(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    e = encoding()
    assert got == [None if t is None else len(e.encode_ordinary(t)) for t in texts]
    assert e.decode(e.encode_ordinary(texts[2])) == texts[2]


def test_mixture(spark):
    rng = random.Random(1)
    words = {"a": "alpha beta gamma delta".split(), "b": "uno dos tres cuatro".split(), "c": "eins zwei drei vier".split()}
    text = lambda s: " ".join(rng.choice(words[s]) for _ in range(rng.randint(5, 60)))
    docs = [(i, text(s), s) for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 100)]
    docs += [(2000 + i, text("b"), None) for i in range(60)] + [(3000, docs[0][1], "b"), (3001, "", "a"), (3002, None, "a")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "id long, text string, source string")
    m = mix_sources(df, targets, "id", "text", "source").cache()
    rows = m.collect()
    caps = {"a": 1, "b": 2, "c": 4, None: 1}
    assert all(0 < r.copies <= caps[r.source] for r in rows) and len({r.id for r in rows}) == len(rows)
    assert not {3000, 3001, 3002} & {r.id for r in rows}
    total = sum(r.copies * r.tokens for r in rows)
    got = {s: sum(r.copies * r.tokens for r in rows if r.source in (s, None) and (r.source == s or r.guess == s)) / total for s in "abc"}
    assert abs(got["a"] - 0.5) < 0.02 and abs(got["b"] - 0.3) < 0.02 and abs(got["c"] - 0.2) < 0.02
    held_out = [r for r in rows if r.source is None]
    assert held_out and all(r.guess == "b" for r in held_out)
    report = {r.source: r for r in shares(m, targets, "id").collect()}
    assert set(report) == {"a", "b", "c", "none"} and report["none"].tokens == 0
    assert mix_sources(df.limit(0), targets, "id", "text", "source").count() == 0


def test_sample_of_a_source_of_any_size(spark):
    from ledgerloom.llm.mixing import sampled

    ids = spark.range(200_000).withColumn("source", F.lit("a"))
    for n, least, most in [(400_000_000, 0, 10), (10**15, 0, 3), (200_000, 230, 380), (100, 200_000, 200_000), (0, 200_000, 200_000)]:  # counts as of so many rows
        assert least <= ids.filter(sampled(ids, {"a": n}, 300)).count() <= most
    # 300 of 4e8 rows is one in 1.3 million: none of a source is lost to a coarse grain
    assert spark.range(20_000_000).withColumn("source", F.lit("a")).transform(lambda x: x.filter(sampled(x, {"a": 400_000_000}, 300))).count() > 3


def test_premises(spark):
    rows = [
        ("a", "Zanufast Chambers, 166, Tegazudot Raod, Mahumalt, 477 792", 1), ("b", "Zanufast Chambers,Door No 166, Tegazudot Road,Neverundnagar 477792,Mahumalt,IN", 1), ("c", "166 Tegzudot Rd; Neverundnagar", 1), ("d", "167 Tegazudot Road, Neverundnagar 477792", 1),
        ("e", "Level 2, 166 Tegazudot Road, Neverundnagar 477792", 1), ("f", None, 1), ("g", "same as billing", 1), ("h", "same as billing", 1), ("i", "", 1), ("b", "Zanufast Chambers,Door No 166, Tegazudot Road,Neverundnagar 477792,Mahumalt,IN", 2), ("j", "q" * 30000, 1),
    ]
    df = spark.createDataFrame(rows, "id string, address string, block int")
    assert {tuple(r) for r in same_premises(df, "id", "address").collect()} == set(combinations("abc", 2))
    assert premises(df.limit(0), "id", "address").count() == 0


def test_premises_of_a_town_with_several_prefixes(spark):
    rows = [(f"t{p}{i}", f"{10 + i} Gatupol Road, Bigtown {p}00{i}, Midstate", 1) for p in (500, 501, 502) for i in range(1, 8)]
    rows += [(f"s{p}{i}", f"{10 + i} Gatupol Road, {town} {p}00{i}, Midstate", 1) for p, town in ((510, "Rovatim"), (520, "Selukan"), (530, "Hitupor")) for i in range(1, 8)]
    rows += [
        ("a", "9 Sunlop Road, Bigtown 501001", 1), ("b", "9 Sunlop Road, Bigtown", 1), ("c", "No. 9 Sunlop Rd., Bigtwon", 1), ("d", "9 Sunlop Road, Rovatim", 1), ("e", "9 Sunlop Road", 1), ("f", "9 Sunlop Rd", 1),
        ("g", "12 Rue de Rivoli, 75001 Paris", 1), ("h", "12, rue de Rivoli 75001 PARIS", 1), ("i", "12 Rue de Rivoly, Paris", 1),
    ]
    got = {tuple(r) for r in same_premises(spark.createDataFrame(rows, "id string, address string, block int"), "id", "address").collect()}
    assert {p for p in got if p[0][0] not in "ts"} == {*combinations("abc", 2), ("e", "f"), *combinations("ghi", 2)}


def test_entities(spark):
    from test_llm_pure import _labelled

    labelled = spark.createDataFrame([*_labelled(), ("x", None)], "a string, b string")
    rows = [
        ("1", "o", "Tomohigesk Logistics Inc"), ("2", "o", "Tomohigeks Logs Incorporated"), ("3", "o", "tomohigeks logistics"), ("4", "o", "Tomohigesk Printers Inc"), ("5", "p", "Tomohigesk Logistics Inc"), ("6", "o", None), ("7", "o", ""), ("8", "o", "Tomohigesk Logistics Inc"),
        ("9", "o", "Josefina S. Perumusort"), ("a", "o", "fina perumusort"), ("b", "o", "Perummusort, Alexaner"), ("c", None, "Perumusort Sasha"), ("d", "o", "w" * 20000), ("e", "o", "Ramesh Kumar"), ("f", "o", "Kumar, R."), ("g", "o", "Kumar Ramesh"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id string, org string, name string, entity int")
    got = {tuple(r) for r in same_entity(df, "id", "org", "name", labelled).collect()}
    assert got == {*combinations(("1", "2", "3", "8"), 2), ("9", "a"), *combinations("efg", 2)}
    assert resolve(df.limit(0), "id", "org", "name").count() == 0
    # merged spellings match what none of them matched alone: a chain of single slips
    chain = ["Mobotikarenu", "Mobotikarenul", "Mobotikarenulo", "Mobotikarenulos", "Mobotikarenulosa", "Mobotikarenulosak", "Mobotikarenulosaki"]
    x = resolve(spark.createDataFrame([(str(i), "o", n + " Ltd") for i, n in enumerate(chain)], "id string, org string, name string"), "id", "org", "name")
    assert x.select("entity").distinct().count() == 1


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(chain, "a string, b string"), "a", "b").collect()}
    assert set(got.values()) == {"000", "x"} and len(got) == 43


def test_scans(spark):
    body = "The primary freight requires the document under the clause.\n" * 30
    rows = [("r1", "d", 1, body + "7"), ("r2", "d", 2, body + "The prirnary frei-\nght.\n8"), ("r3", "d", 3, "40\n" + body + "9"), ("r4", None, None, None), ("r5", None, None, ""), ("r1", "d", 1, body + "7"), ("r6", None, None, body * 20)]
    df = spark.createDataFrame(rows, "id string, doc string, page int, text string")
    got = {r.id: r for r in repaired(df).collect()}
    assert "r4" not in got and got["r5"].fixes == [] and got["r6"].fixes == []
    assert [(f.line_no, f.fix) for f in got["r2"].fixes] == [(30, "freight"), (30, "primary"), (32, "")]
    assert [(f.line_no, f.fix) for f in got["r3"].fixes] == [(31, "")]
    assert repaired(df.limit(0)).count() == 0


def test_running_lines_are_learned_and_rare_words_judged(spark):
    body = "The primary freight requires the document under the clause.\n" * 40
    name = lambda i: "".join("bdgklmnprstvz"[(i * 7 + k * 5) % 13] + "aeiou"[(i + k) % 5] for k in range(3)).title()
    rows = [(f"d{i}p{p}", f"d{i}", p, f"{name(i)} duty annex 2025\n{body}") for i in range(5) for p in (1, 2)]
    rows += [("one", "other", 1, f"Hutirem loading annex 2024\nPayment due 2025\n{body}Fiscal year 2024"), ("loose", None, None, "Goods received in March 2025\nHutirem loading aunex 2026")]
    rows += [(f"r{i}", None, None, body + "The zemblatorium order.") for i in range(30)] + [("bad", None, None, body + "The zernblatorium order.")]
    df = spark.createDataFrame(rows, "id string, doc string, page int, text string")
    got = {r.id: [(f.line_no, f.fix) for f in r.fixes] for r in repaired(df, least_share=0.02).collect()}
    assert got["d0p1"] == [(0, "")] and got["one"] == [(0, "")] and got["loose"] == [(1, "")]
    assert got["bad"] == [(40, "zemblatorium")] and got["r0"] == []


def test_python_runs_once_above_the_distinct(spark, small):
    from ledgerloom.llm import queries
    from ledgerloom.llm.addresses import parsed_addresses
    from ledgerloom.session import spread, table

    addresses = spread(table(spark, small, "vendor").select("address"), "address").distinct()
    for df in (queries.p4_found(spark, small), parsed_addresses(addresses).filter("street is not null and number <> ''")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "EvalPython" not in plan and plan.index("MapInPandas") < plan.index("Aggregate")
