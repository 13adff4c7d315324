import random
import textwrap
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from finscan.llm import license_scan as L
from finscan.llm import pfair_mix as X


def dice(text, template):
    a, b = set(L.bigrams(text)), set(L.bigrams(template))
    return 2 * len(a & b) / (len(a) + len(b)) if a else 0.0


def brute(rows, threshold=L.THRESHOLD):
    """Every unit and every window against every template, without any bound."""
    out = defaultdict(lambda: ([], []))
    for i, text in rows:
        if not text:
            continue
        lines, words = text.split("\n"), L.normal(text).split()
        for name, template in L.TEMPLATES:
            n = len(L.normal(template).split())
            for unit in [text, *(lines if len(lines) > 1 else [])]:
                out[i, name][0].append(dice(unit, template))
            if len(words) > n:
                for at in sorted({*range(0, len(words) - n + 1, L.window_step(n)), len(words) - n}):
                    out[i, name][1].append(dice(" ".join(words[at : at + n]), template))
    good = lambda v: [d for d in v if d >= threshold - 1e-12]
    return {k: (round(max(good(u + w)), 6), len(good(u)), len(good(w))) for k, (u, w) in out.items() if good(u + w)}


def test_scan_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        name, template = rng.choice(L.TEMPLATES)
        words = template.split()
        for _ in range(rng.randint(0, max(1, len(words) // 8))):
            words[rng.randrange(len(words))] = rng.choice(["foo", "the", "software"])
        rows.append((i, rng.choice(["", "First line of text.\n", "many words before it all "]) + " ".join(words) + rng.choice(["", "\nlast"])))
    rows += [(100, None), (101, ""), (102, "one"), (103, "MIT LICENSE"), (104, "Released under the MIT License.\n" * 3), (105, "x " * 100_000 + "\nLicensed under CC BY 4.0"), (106, "Released, under the MIT license")]
    rows.append(rows[-1])
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, license string, unit int")
    got = {(r.doc_id, r.license): (r.dice, r.units, r.windows) for r in L.scan(df).collect()}
    assert got == brute(rows)
    assert L.scan(df.limit(0)).count() == 0


def test_wrapped_licenses_above_and_inside_other_text(spark):
    """Bodies of several lines in a longer document, at any width and offset, and a notice in a long line."""
    rng = random.Random(8)
    bodies = [(n, t) for n, t in L.TEMPLATES if len(t.split()) > 40]
    code = [f"x{i} = f({rng.randrange(999)}, y{i % 7})" for i in range(200)]
    rows, want = [], []
    for i, (name, body) in enumerate(bodies):
        width = rng.choice([40, 76, 100])
        wrapped = textwrap.wrap(body, width, initial_indent="# ", subsequent_indent="# ")
        before = ["filler " * rng.randrange(12)] * rng.randrange(30)
        rows.append((i, "\n".join([*before, "Copyright (c) 2020 A. Person", *wrapped, *code])))
        want.append((i, name))
    rows.append((90, "several words in front " * 50 + "licensed under the Apache License, Version 2.0, and " + "more words after it " * 50))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.dice, r.units, r.windows) for r in L.scan(df).collect()}
    assert got == brute(rows)
    assert set(want) <= set(got) and (90, "Apache-2.0-notice") in got
    assert min(got[w][0] for w in want) > 0.88


def test_cue_words_and_bounds():
    for _, template in L.TEMPLATES:
        b = L.bigrams(template)
        low, high = L.bounds(len(b), 0.8)
        assert low <= len(b) <= high and 2 * low / (low + len(b)) >= 0.8 - 1e-9
        cues = set(L.cue_words(b, 0.8))
        assert len([x for x in b if not cues & set(x.split())]) < low


def test_native_plan(spark):
    for df in (L.op7_license_scan(spark, "/root/testdata/sf0.001"), X.op8_pfair_mix(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "InArrow", "CartesianProduct"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_never_a_block_away_from_the_share(weights):
    named = {f"s{i}": w for i, w in enumerate(weights)}
    order, total, done = X.period(named), sum(weights), dict.fromkeys(named, 0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[n] * total - w * t) < total for n, w in named.items())
    assert done == named


def test_schedule_against_a_simulation(spark):
    rng = random.Random(5)
    weights = {"a": 5, "b": 2, X.OTHERS: 1}
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(7, "a"), (7, "a"), (None, "b")]
    df = spark.createDataFrame([(i, s, "t", "clash", 1) for i, s in rows], "doc_id long, source string, text string, stream string, slot int")
    got = X.schedule(df, weights, block=4, prefix="p_").collect()
    assert len(got) == len(rows)
    seen = defaultdict(set)
    for r in got:
        seen[r.p_stream].add((r.p_block, r.p_place))
        assert r.stream == "clash" and r.p_stream == (r.source if r.source in ("a", "b") else X.OTHERS)
    for stream, places in seen.items():
        n = sum(1 for r in got if r.p_stream == stream)
        assert places == {(k // 4, k % 4) for k in range(n)}
    slots = {(r.p_stream, r.p_block): r.p_slot for r in got}
    assert len(set(slots.values())) == len(slots)
    order, done = X.period(weights), dict.fromkeys(weights, 0)
    for slot in range(max(slots.values()) + 1):
        s = order[slot % len(order)]
        assert slots.get((s, done[s]), slot) == slot
        done[s] += 1


def test_rows_of_one_id_and_of_none_are_spread(spark):
    """A hot id and a null id with many rows: places stay a permutation, and no bucket holds them all."""
    rows = [(None, "a", f"n{i}") for i in range(3000)] + [(7, "a", f"h{i}") for i in range(3000)] + [(i, "a", "x") for i in range(100, 1100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    weights = {"a": 3, X.OTHERS: 1}
    plans = [X.schedule(df, weights, bucket_rows=k).collect() for k in (50, 50)]
    assert sorted(map(str, plans[0])) == sorted(map(str, plans[1]))
    places = {(r.block, r.place) for r in plans[0]}
    assert places == {(k // X.BLOCK, k % X.BLOCK) for k in range(len(rows))}
    assert all(r.block * X.BLOCK + r.place < 3000 for r in plans[0] if r.doc_id is None)
    # Without hot ids the order is that of the ids' hashes, whatever the size of buckets.
    few = df.where("doc_id >= 100")
    same = lambda k: {r.doc_id: (r.block, r.place) for r in X.schedule(few, weights, bucket_rows=k).collect()}
    assert same(10) == same(20_000)


def test_mix_keeps_rows_and_their_order(spark):
    df = spark.createDataFrame([(i, "src0" if i % 3 else "src11", f"t{i}") for i in range(200)], "doc_id long, source string, text string")
    mixed = [tuple(r) for r in X.mix(df).collect()]
    planned = [tuple(r)[:3] for r in X.schedule(df).orderBy("slot", "place").collect()]
    assert mixed == planned and sorted(mixed) == sorted(tuple(r) for r in df.collect())
    assert X.mix(df.limit(0)).count() == 0
    for bad in ({"a": 0}, {}, {"a": 20_000}):
        with pytest.raises(ValueError):
            X.period(bad)


@pytest.mark.parametrize("name", ["op1_pivot_topk", "op2_warc_roundtrip", "op7_license_scan", "op8_pfair_mix"])
def test_queries_equal_their_sql(spark, name):
    from finscan.llm import catalogue

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    names = sorted(df.columns)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == names
    got = sorted(tuple(map(str, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.project(", ".join(f'"{n}"' for n in names)).fetchall())
