import base64
import random

import numpy as np

from finscan.llm import language_id as G


def test_held_out_accuracy(spark):
    found = G.op10_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = [r for r in found.join(truth, "doc_id").collect() if r.held_out]
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


TEXTS = {"en": "the quick brown fox jumps over the lazy dog and runs through the woods ", "fr": "le renard brun rapide saute par dessus le chien paresseux dans la forêt ", "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg "}


def table(spark):
    rows = [(i, TEXTS[lang] * (1 + i % 3), lang, "x", i) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    rows += [(200, None, None, "x", 0), (201, "", "en", "x", 0), (202, "123 !!! 456", "fr", "x", 0), (203, "Το γρήγορο καφέ άλμα πηδά πάνω από το τεμπέλικο σκυλί " * 4, None, "x", 0), (204, TEXTS["fr"] * 20_000, None, "x", 0), (205, "the", None, "x", 0), (None, TEXTS["de"], "de", "x", 0)]
    rows += rows[:2]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, rejected int")


def test_odd_rows(spark):
    df = table(spark)
    model = G.fit(df, ~G.held_out())
    got = {r.doc_id: r for r in G.identify(df, model, prefix="p_").collect()}
    assert len(G.identify(df, model, prefix="p_").collect()) == df.count()
    for i in (200, 201, 202):
        assert (got[i].p_lang_pred, got[i].p_score, got[i].p_rejected) == ("und", 0.0, True)
    assert got[203].p_rejected and got[203].p_lang_pred in TEXTS
    assert got[204].p_lang_pred == "fr" and not got[204].p_rejected and got[205].p_lang_pred == "en" and not got[205].p_rejected
    assert got[None].p_lang_pred == "de" and got[0].score == "x"
    assert all(got[i].p_lang_pred == lang for i, lang in enumerate(["en", "fr", "de"] * 20))


def test_nothing_learned_and_empty(spark):
    df = table(spark)
    model = G.fit(df.limit(0), ~G.held_out())
    assert {(r.lang_pred, r.rejected) for r in G.identify(df.select("text"), model).collect()} == {("und", True)}
    assert G.identify(df.limit(0).select("text"), model).count() == 0


def test_whole_texts_count_alike_in_pieces():
    text = "some words of a text that is long " * 30_000
    (_, whole, letters) = next(G.counts([text]))
    small = next(G.counts(["some words of a text that is long " * 300]))
    assert letters[0] == 100 * small[2][0] and np.allclose(whole, 100 * small[1], atol=100)


def test_the_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, TEXTS["en" if i % 10 else "de"], "en" if i % 10 else "de") for i in range(400)], "doc_id long, text string, lang string")
    model = G.fit(df, ~G.held_out(), sample=40)
    assert model.languages == ("de", "en") and len(model.centroids) <= 8


ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. Quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura. "


def test_rejection_on_the_table(spark):
    """Other languages and junk go, at any length, even with junk rows among the labelled; clean held-out texts stay."""
    draw = random.Random(7)
    base64s = [base64.b64encode(draw.randbytes(n)).decode() for n in (80, 300, 3000)]
    consonants = [" ".join("".join(draw.choices("bcdfghjklmnpqrstvwxz", k=draw.randrange(3, 9))) for _ in range(n)) for n in (20, 100, 900)]
    bad = [ITALIAN[:200], ITALIAN * 3, ITALIAN * 30, *base64s, *consonants, "中文文本测试一下这个语言识别模型是否能够拒绝", "Широка страна моя родная", "Litwo ojczyzno"]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1 - i, base64.b64encode(draw.randbytes(900)).decode(), "en") for i in range(3)], docs.schema)
    for labelled in (docs, docs.unionByName(junk)):
        model = G.fit(labelled, ~G.held_out())
        assert G.predict(bad, model)[2] == [True] * len(bad)
    held = [r.text for r in docs.where(G.held_out()).collect()]
    assert sum(G.predict(held, model)[2]) <= 0.002 * len(held)


def test_the_sample_counts_rows_not_ids(spark):
    """Repeated ids and repeated rows neither pass the bound nor starve the draw."""
    rng = random.Random(1)
    words = {k: v.split() for k, v in TEXTS.items()}
    some = lambda lang: " ".join(rng.choices(words[lang], k=12))
    rows = [(i % 10, some(lang), lang) for i in range(3000) for lang in ("en", "de")]
    rows += [(3, TEXTS["fr"], "fr")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    fit_arrays = G.fit_arrays
    try:
        G.fit_arrays = lambda labels, *a, **k: seen.append(labels) or fit_arrays(labels, *a, **k)
        for sample in (40, 400, 12):
            G.fit(df, ~G.held_out(), sample=sample)
            got = seen.pop()
            assert len(got) <= sample and got.count("fr") == 1 and got.count("en") == got.count("de") == sample // 3
    finally:
        G.fit_arrays = fit_arrays


def brute_vector(text, model):
    """n-grams counted one by one, in plain Python."""
    size = len(model.idf)
    bits = 32 - (size.bit_length() - 1)
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    a, b, c, m = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 2**32 - 1
    out = np.zeros(size)
    codes = [32]
    for w in words:
        codes += [*map(ord, w), 32]
    for i, x in enumerate(codes):
        if x != 32:
            out[(((x * a & m) ^ (x >> 3)) * b & m) >> bits] += 1
        if i + 1 < len(codes) and not (x == 32 and codes[i + 1] == 32):
            h = ((x * a & m) + codes[i + 1] & m) * b & m
            out[((h ^ (h >> 15)) * c & m) >> bits] += 1
        if i + 2 < len(codes) and codes[i + 1] != 32:
            h = (((x * a & m) + codes[i + 1] & m) * b + codes[i + 2] & m) * c & m
            out[((h ^ (h >> 15)) * a & m) >> bits] += 1
    v = np.log1p(out) * model.idf
    return v / (np.linalg.norm(v) or 1)


def test_prediction_equals_plain_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = G.fit(docs, ~G.held_out())
    texts = [r.text for r in docs.collect()] + [None, "", "12 !", "a", "Ünï", TEXTS["fr"] * 50]
    names, scores, _ = G.predict(texts, model)
    for text, name, score in zip(texts, names, scores, strict=True):
        v = brute_vector(text or "", model)
        if not v.any():
            assert (name, score) == ("und", 0.0)
            continue
        near = model.centroids @ v
        best = {lang: max(float(x) for x, o in zip(near, model.owner, strict=True) if o == j) for j, lang in enumerate(model.languages)}
        assert abs(max(best.values()) - score) < 1e-4 and best[name] > max(best.values()) - 1e-4


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(G.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = G.fit(docs, ~G.held_out()), G.fit(other, ~G.held_out())
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids) and np.array_equal(a.limits, b.limits) and np.array_equal(a.idf, b.idf)
