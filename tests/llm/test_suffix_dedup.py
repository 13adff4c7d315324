import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finscan.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = set(), {}
    for key, text in rows:
        b = text if isinstance(text, bytes) else (text or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                cover[p : p + length] = 1
            seen.add(b[p : p + length])
        m = cover[: len(b)]
        out[key] = (len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m])) == 1).sum()), hashlib.sha256(bytes(x for x, c in zip(b, m, strict=True) if not c)).hexdigest())
    return out


def run(spark, rows, length):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, sub int, bucket string")
    found = S.removed_spans(df, length=length).withColumn("removed", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    return {r.doc: (r.n_bytes, r.removed, len(r.spans), bytes(r.kept).hex()) for r in found.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    passage = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [rng.choice([*passage, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "sh th" * rng.randint(1, 60)]) for _ in range(rng.randint(0, 4))]
        rows.append((i * 3 - 20, " ".join(parts)))
    rows += [(500, rows[5][1]), (501, rows[5][1]), (502, None), (503, ""), (504, "x" * 99), (505, "y" * 350), (506, "y" * 100)]
    for length in (100, 50):
        assert run(spark, rows, length) == brute(sorted(rows), length)


def test_long_texts_cross_segments(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, base), (2, "zz" + base[60_000:140_000] + "q" * 130), (3, base[100:90_000])]
    assert run(spark, rows, 100) == brute(rows, 100)


def test_repeated_ids_null_ids_and_empty(spark):
    a, b = "first text of some length " * 8, "second, wholly other text " * 8
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b)], "doc_id long, text string")
    kept = [bytes(r.kept).decode() for r in S.removed_spans(df, kept=True).collect()]
    assert sum(map(len, kept)) < len(a) + len(b) and len(kept) == 4
    assert sorted(map(len, kept)).count(0) == 2
    assert S.removed_spans(df.limit(0)).count() == 0


def sample(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = [some(60) for _ in range(4)]
    rows = []
    for i in range(30):
        parts = [rng.choice([*passage, passage[0][rng.randint(0, 60) :], some(rng.randint(1, 60))]) for _ in range(rng.randint(0, 4))]
        rows.append((i, " ".join(parts)))
    return [*rows, (50, rows[3][1]), (51, rows[3][1]), (52, "y" * 150)]


def test_groups_hold_all_occurrences(spark):
    """Each group spells one string and has all its places; what they spell but for first places is what is removed."""
    rows = sample(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = {i: t.encode() for i, t in rows}
    groups = {}
    for r in S.repeat_groups(df).collect():
        groups.setdefault((r.first_doc, r.first_start, r.length), set()).add((r.doc, r.start))
    cover = {i: np.zeros(len(t), int) for i, t in raw.items()}
    for (doc, at, n), places in groups.items():
        string = raw[doc][at : at + n]
        assert n >= 100 and len(string) == n and min(places) == (doc, at) and len(places) > 1
        assert places == {(i, p) for i, t in raw.items() for p in range(len(t) - n + 1) if t.startswith(string, p)}
        for i, p in places - {(doc, at)}:
            cover[i][p : p + n] = 1
    want = brute(rows, 100)
    assert {i: (len(c), int(c.sum())) for i, c in cover.items()} == {i: v[:2] for i, v in want.items()}
    assert any(len({raw[i][p - 1] if p else None for i, p in places}) > 1 for places in groups.values())


@pytest.mark.parametrize("hot", [2, 6, 10**6])
def test_one_anchor_in_every_document(spark, monkeypatch, hot):
    """A line of 60 bytes that all documents hold, in other surroundings, and passages around it: taken apart or not, the same."""
    rng = random.Random(11)
    line = "the line that every one of all these documents holds, word by"
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    near = [some(70) for _ in range(6)]
    rows = [(i, some(30) + rng.choice([some(70), *near]) + line + rng.choice([some(70), *near]) + some(20)) for i in range(120)]
    monkeypatch.setattr(S, "LOCAL", 2)
    monkeypatch.setattr(S, "HOT", hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts = S._numbered(df, "doc_id", "text", [])
    found, size = S.hot_anchors(texts)
    assert (len(found) > 0) == (hot < 10**6) and size == sum(len(t) for _, t in rows)
    assert run(spark, rows, 100) == brute(rows, 100)


def test_windows_of_a_large_anchor_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "WINDOWS", 100)
    rows = sample(5)
    assert run(spark, rows, 100) == brute(rows, 100)


def test_equal_hashes_of_other_bytes(monkeypatch, spark):
    """With a context hash of two bits the batch tells contexts apart by their bytes, and nothing is removed that is no repeat."""
    real = S.anchors

    def weak(*args, **options):
        h, c, low, n = real(*args, **options)
        return h & S.U(7 << 40), c & S.U(3), low, n

    monkeypatch.setattr(S, "anchors", weak)
    texts = [t.encode() for _, t in sample(6)]
    b = S._Batch(texts, 100)
    spelt = set()
    for j in range(len(b.h)):
        s = texts[b.number[j]][b.at[j] : b.at[j] + b.n[j] + 99]
        assert not b.old[j] or s in spelt
        spelt.add(s)
    assert b.old.any()


def test_more_buckets_than_partitions(spark):
    rows = sample(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc: (r.n_bytes, sum(x.end - x.start for x in r.spans)) for r in S.removed_spans(df, bucket_bytes=1000).collect()}
    assert found == {i: v[:2] for i, v in brute(rows, 100).items()}


def test_rows_of_one_id_and_of_none_lie_in_many_buckets(spark):
    rng = random.Random(3)
    some = lambda: "".join(rng.choice("abcdefgh ") for _ in range(150))
    passage = some()
    rows = [(None, some() + passage) for _ in range(40)] + [(7, some() + passage) for _ in range(40)] + [(7, passage)] * 3 + [(None, passage)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = S._numbered(df, "doc_id", "text", [])
    buckets = np.arange(16)
    spread = {(r.doc == 7, int(S._text_bucket(np.array([r.doc]), np.array([r.sub]), buckets)[0])) for r in texts.select("doc", "sub").collect()}
    assert len(spread) > 20 and texts.select("doc", "sub").distinct().count() == len(rows)
    found = S.removed_spans(df, carry=["doc_id"]).collect()
    want = brute([((r.doc, r.sub), bytes(r.text)) for r in texts.orderBy("doc", "sub").collect()], 100)
    assert {(r.doc, r.sub): (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept).hex()) for r in found} == want
    assert [r.c0 for r in found if not r.spans] == [None]


def test_cleaned_keeps_columns(spark):
    t = "passage that is repeated word for word " * 5
    df = spark.createDataFrame([(1, t + "é one", "en", 9), (2, "è two " + t, None, 9), (3, None, "de", 0)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in S.cleaned(df).collect()}
    assert S.cleaned(df).columns == df.columns
    assert got[2].text.startswith("è two") and len(got[2].text) < 20 and got[2].n_chars == len(got[2].text) and got[2].lang is None
    assert got[3].text == "" and got[3].n_chars == 0


def test_suffix_array_intervals_and_maximal_repeats():
    rng = random.Random(1)
    for _ in range(30):
        data = np.frombuffer("".join(rng.choice("ab") for _ in range(60)).encode(), np.uint8)
        starts, room = np.arange(60), 60 - np.arange(60)
        order, lcp = S.suffix_array(data, starts, room)
        raw = data.tobytes()
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(60))
        found = set(zip(*(x.tolist() for x in S.intervals(lcp, 3)), strict=True))
        want = set()
        for i in range(60):
            for j in range(i + 1, 60):
                depth = min(lcp[i + 1 : j + 1])
                if depth >= 3 and lcp[i] < depth and (j + 1 == 60 or lcp[j + 1] < depth):
                    want.add((int(depth), i, j))
        assert found == want
        before = np.concatenate([[256], data[:-1]]).astype(int)
        got = {(n, tuple(m.tolist())) for n, m in S.repeats(data, starts, room, before, 3)}
        strings = {raw[i:j] for i in range(60) for j in range(i + 3, 61)}
        maximal = set()
        for s in strings:
            at = tuple(i for i in range(60) if raw.startswith(s, i))
            lefts, rights = {raw[i - 1] if i else None for i in at}, {raw[i + len(s)] if i + len(s) < 60 else None for i in at}
            if len(at) > 1 and (len(lefts) > 1 or None in lefts) and (len(rights) > 1 or None in rights):
                maximal.add((len(s), at))
        assert got == maximal


def test_buckets_are_dealt_one_to_a_partition(spark):
    for parts in (1, 7, 211):
        keys = S.placed(parts)
        df = spark.createDataFrame([(int(k),) for k in keys], "k int")
        assert [r[0] for r in df.select(F.pmod(F.hash("k"), F.lit(parts))).collect()] == list(range(parts))
