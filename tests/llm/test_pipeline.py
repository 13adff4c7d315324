import hashlib

import sentencepiece

import corpus_pipeline as P
from finscan.llm import chosen_path, language_id, pfair_mix, sentencepiece_bpe, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_code(spark):
    """Each stage's decisions against a plain version on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    one = P.languages(spark, docs, DATA)
    assert one.columns == columns
    model = language_id.fit(docs, ~language_id.held_out())
    rows = docs.collect()
    rejected = language_id.predict([r.text for r in rows], model)[2]
    kept = {r.doc_id: r for r, gone in zip(rows, rejected, strict=True) if not gone}
    assert {r.doc_id for r in one.collect()} == set(kept) and len(kept) > 0.98 * len(rows)

    two = P.near_copies(spark, one, DATA)
    assert two.columns == columns
    sets = {i: set(chosen_path.grams(r.text).tolist()) for i, r in kept.items()}
    group = {}
    for i in sorted(sets):
        near = [j for j in group if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        roots = {group[j] for j in near} | {i}
        for j in list(group):
            if group[j] in roots:
                group[j] = min(roots)
        group[i] = min(roots)
    left = sorted(set(group.values()))
    assert sorted(r.doc_id for r in two.collect()) == left

    three = P.passages(spark, two, DATA)
    assert three.columns == columns
    seen, want = set(), {}
    for i in left:
        b = kept[i].text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = hashlib.md5(b[p : p + 100]).digest()
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        want[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    texts = {r.doc_id: r.text for r in three.collect()}
    assert texts == want

    four = P.mixing(spark, three, DATA)
    order = [r.doc_id for r in four.collect()]
    assert four.columns == columns and order == [r.doc_id for r in pfair_mix.schedule(three).orderBy("slot", "place").collect()]

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    for r in P.tokens(spark, four, DATA).collect():
        assert r.token_ids == own.encode(texts[r.doc_id]) and r.round_trip


def test_run_and_odd_tables(spark, tmp_path):
    got = P.run(spark, DATA)
    assert got.count() > 100 and {n for n, _ in P.STAGES} and len(P.STAGES) == 5
    rows = [(1, "the of and to in that it " * 10, "en", "src0", 1), (1, "the of and to in that it " * 10, "en", "src0", 1), (2, None, None, None, None), (3, "", "en", None, 0), (4, "la de le et " * 20, "fr", "src1", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == [1, 4]
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(empty / "documents.parquet"))
    assert P.run(spark, str(empty)).count() == 0
    assert suffix_dedup.LENGTH == 100


def test_run_returns_the_mix(spark):
    """Slot and place in run()'s own output, against the schedule in plain code."""
    got = P.run(spark, DATA).collect()
    assert len({(r.slot, r.place) for r in got}) == len(got)
    own, total = pfair_mix._slots(pfair_mix.WEIGHTS), sum(pfair_mix.WEIGHTS.values())
    streams = {}
    for r in got:
        streams.setdefault(r.source if r.source in own else pfair_mix.OTHERS, []).append(r)
    for s, rows in streams.items():
        rows.sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
        for at, r in enumerate(rows):
            j, place = divmod(at, pfair_mix.BLOCK)
            assert (r.slot, r.place) == (j // len(own[s]) * total + own[s][j % len(own[s])], place)


def test_rows_of_one_id_keep_their_order_in_the_mix(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", "src0", 6) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    want = [own.encode(r.text) for r in P.mixing(spark, docs, DATA).collect()]
    assert [r.token_ids for r in P.tokens(spark, docs, DATA).orderBy("slot", "place").collect()] == want


def test_extra_columns_with_clashing_names(spark, tmp_path):
    """Columns named like the stages' own travel through all that return the columns of documents."""
    names = ["sub", "bucket", "node", "component", "stream", "slot", "place", "tokens", "c0", "kept", "id", "key", "lang_pred", "rejected", "text_hash"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs = docs.select("*", *(docs.doc_id.cast("string").alias(n) for n in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    rows = now.collect()
    assert len(rows) > 30 and all(r[n] == str(r.doc_id) for r in rows for n in names)
    assert P.run(spark, str(tmp_path)).count() == len(rows)
