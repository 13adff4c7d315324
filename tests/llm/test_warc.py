import hashlib

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from finscan.llm import warc as W
from finscan.llm.shared import interval_of, scratch

SCHEMA = "page_id long, url string, html string, shard string, first int"


def archive(spark, rows, **options):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    return W.write_archives(df, scratch(spark, "warc"), **options)


def test_round_trip_revisits_and_odd_rows(spark):
    long = "ü" * 100_000
    rows = [(3, "http://a/3", "x" * 120), (1, "http://a/1", "x" * 120), (2, None, "short"), (5, "http://a/\r\nX: 5", "short"), (4, "u", None), (7, "u", long), (9, "u", long), (9, "u", long), (None, "n", "y" * 150), (8, "u", "y" * 150), (6, "u", "")]
    manifest = archive(spark, rows, shards=3)
    got = W.read_archives(manifest, payload=True).collect()
    assert len(got) == len(rows)
    text = lambda r: bytes(r.payload).decode()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].record_type == "response" and (by[3][0].record_type, by[3][0].refers_to) == ("revisit", 1)
    assert by[3][0].payload_bytes == 120 and by[3][0].payload_digest == hashlib.sha256(b"x" * 120).hexdigest()
    assert by[2][0].record_type == by[5][0].record_type == by[4][0].record_type == by[6][0].record_type == "response"
    assert by[2][0].url is None and by[5][0].url == "http://a/%0D%0AX: 5" and by[4][0].payload_bytes == 0
    assert text(by[7][0]) == long and {(r.record_type, r.refers_to) for r in by[9]} == {("revisit", 7)}
    assert by[None][0].record_type == "response" and by[8][0].record_type == "response"


def test_repeated_rows_and_rolling(spark):
    rows = [(1, "u", "z" * 200)] * 3 + [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 5) for i in range(2, 40)]
    manifest = archive(spark, rows, shards=1, roll_bytes=1000)
    files = manifest.orderBy("part").collect()
    assert len(files) > 3 and [f.part for f in files] == list(range(len(files)))
    got = [(r.page_id, r.record_type, r.refers_to) for r in W.read_archives(manifest).collect()]
    assert sorted(str(x[1:]) for x in got if x[0] == 1) == ["('response', None)", "('revisit', 1)", "('revisit', 1)"]


def test_same_rows_same_bytes(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 30) for i in range(60)]
    a, b = archive(spark, rows, shards=4), archive(spark, list(reversed(rows)), shards=4)
    digest = lambda m: sorted((r.shard, r.part, r.records, r.sha256) for r in m.collect())
    assert digest(a) == digest(b)
    for r in a.collect():
        fs, path = pafs.FileSystem.from_uri(r.path)
        with fs.open_input_stream(path, compression=None) as f:
            assert hashlib.sha256(f.read()).hexdigest() == r.sha256
        assert not [x for x in fs.get_file_info(pafs.FileSelector(path.rsplit("/", 1)[0])) if "_temporary" in x.path]


def test_empty_table_and_damage(spark):
    assert W.read_archives(archive(spark, [])).count() == 0
    raw = W.page_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    headers, block = W.parse(raw)
    assert headers["warc-type"] == "response" and block.endswith(b"abc")
    import pytest

    with pytest.raises(ValueError):
        W.parse(raw.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(W.members(iter([b"\x1f\x8b\x08\x00"])))


@pytest.mark.parametrize("shuffle", ["3", "17"])
def test_layout_does_not_depend_on_the_session(spark, shuffle):
    """Names, sizes and digests are those of another number of partitions, on the table of pages."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    lines = lambda m: sorted((r.path.rsplit("/", 1)[1], r.records, r.bytes, r.sha256) for r in m.collect())
    was = spark.conf.get("spark.sql.shuffle.partitions")
    first = lines(W.write_archives(pages, scratch(spark, "warc"), shard_bytes=20_000))
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        again = lines(W.write_archives(pages.repartition(5), scratch(spark, "warc"), shard_bytes=20_000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert first == again and len(first) > 3


def test_shards_are_ranges(spark):
    rows = [(i * i, f"http://h/{i}", f"page {i} " * 30) for i in range(200)]
    manifest = archive(spark, rows, shards=6)
    found = W.read_archives(manifest).join(manifest, "path").groupBy("shard").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.count("*").alias("n")).orderBy("shard").collect()
    assert len(found) == 6 and all(x.b < y.a for x, y in zip(found, found[1:], strict=False)) and min(f.n for f in found) > 20


def test_files_must_agree_with_the_manifest(spark):
    rows = [(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 5) for i in range(50)]
    manifest = archive(spark, rows, shards=1)
    line = manifest.first()
    fs, path = pafs.FileSystem.from_uri(line.path)
    with fs.open_input_stream(path, compression=None) as f:
        raw = f.read()
    ends = [i for i in range(1, len(raw)) if raw[i : i + 3] == b"\x1f\x8b\x08"]
    for bad in (raw[: ends[27]], raw[:-1], raw + raw[ends[-1] :], raw[:40] + b"!" + raw[41:]):
        with fs.open_output_stream(path, compression=None) as f:
            f.write(bad)
        with pytest.raises(Exception, match="manifest lists|ends inside|digest differs|decompress|Error"):
            W.read_archives(manifest).count()
    fs.delete_file(path)
    with pytest.raises(Exception):
        W.read_archives(manifest).count()


def test_a_task_that_runs_again_keeps_the_file(tmp_path):
    def make():
        file = W._File(f"file://{tmp_path}", 0, 0, 1)
        file.write(W.page_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None))
        return file

    a, b = make(), make()
    first = a.commit()
    inode = (tmp_path / "shard-000000-0000.warc.gz").stat().st_ino
    assert b.commit() == first and (tmp_path / "shard-000000-0000.warc.gz").stat().st_ino == inode
    assert len(list(tmp_path.iterdir())) == 1


def test_binary_search(spark):
    cuts = [-5, 0, 3, 9, 200]
    rows = [(i,) for i in (-9, -5, -1, 0, 2, 3, 8, 9, 10, 200, 10**12)] + [(None,)]
    df = spark.createDataFrame(rows, "id long").select("id", interval_of(F.col("id"), cuts).alias("at"))
    assert all(r.at == (0 if r.id is None else W.shard_of(r.id, cuts)) for r in df.collect())
