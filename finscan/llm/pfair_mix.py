"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks of ``block`` documents, in an order drawn by hash. With integer
weights c_s of total W, block j of source s is released at slot floor(j W / c_s) and due by slot
ceil((j + 1) W / c_s). Earliest deadline first over the released blocks gives a schedule in which
no source is ever one block or more away from its share, and which repeats every W slots. So one
period is scheduled on the driver (W numbers, from the weights alone), and a block's slot follows:

    slot = (j div c_s) W + slots_s[j mod c_s]

A source that has run out leaves its slots empty; nothing is dropped or repeated.

All work on rows is DataFrame operations. A document's place in its source comes from counts of
small hash buckets and its place within the bucket, so that a source with a third of all rows is
spread over all tasks. So are the rows of a null id, and those of an id that more than a 4,096th of
all rows (and more than a bucket) bear: their buckets hang on a hash of the row as well, and come
after the other rows of their hash bucket.

Defined results: null sources and sources without a weight share the stream '*'; rows of a null id
come first in their stream; equal ids are ordered by a hash of the row, and equal rows are placed
one after another (by one task); an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscan.llm.shared import partitions, table

OTHERS = "*"
BLOCK = 8
BUCKET_ROWS = 1000
LONGEST_PERIOD = 10_000
MOST_HOT = 4096
# The production weights, in hundredths.
WEIGHTS = {"src0": 16} | {f"src{i}": 6 for i in range(1, 5)} | {f"src{i}": 5 for i in range(5, 10)} | {f"src{i}": 3 for i in range(10, 20)} | {OTHERS: 5}


def period(weights: dict[str, int]) -> list[str]:
    """The stream of each slot of one period: earliest deadline first over released blocks."""
    total = sum(weights.values())
    if not weights or min(weights.values()) <= 0 or total > LONGEST_PERIOD:
        raise ValueError(f"weights must be positive integers of at most {LONGEST_PERIOD} in all")
    done = dict.fromkeys(weights, 0)
    out = []
    for slot in range(total):
        released = [s for s, c in weights.items() if done[s] < c and done[s] * total // c <= slot]
        first = min(released, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), s))
        done[first] += 1
        out.append(first)
    return out


def _slots(weights: dict[str, int]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {s: [] for s in weights}
    for slot, s in enumerate(period(weights)):
        out[s].append(slot)
    return out


def _by_stream(stream: Column, values: dict[str, Column]) -> Column:
    names = [s for s in values if s != OTHERS]
    out = values[OTHERS]
    for s in reversed(names):
        out = F.when(stream == s, values[s]).otherwise(out)
    return out


def tie(docs: DataFrame) -> Column:
    """The hash that orders rows of equal ids."""
    return F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t and "variant" not in t))


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, prefix: str = "", tied_by: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with stream string, block long, place int (in the block) and slot long.

    Rows of equal ids are ordered by tied_by, or else by a hash of the row.
    """
    weights = dict(weights or WEIGHTS)
    weights.setdefault(OTHERS, 1)
    own, total = _slots(weights), sum(weights.values())
    named = [s for s in weights if s != OTHERS]
    n = lambda c: f"{prefix}{c}"
    tmp = lambda c: f"__mix_{c}"
    count = docs.count()
    digits = lambda rows: min(6, max(1, math.ceil(math.log(max(1, rows / bucket_rows), 16))))
    source = F.col(source_col).cast("string")
    key = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit(""))
    # At most MOST_HOT ids can each have more than that part of all rows.
    hot = [r["key"] for r in docs.groupBy(key.alias("key")).count().where(F.col("count") > max(bucket_rows, count // MOST_HOT)).select("key").collect()] if count > bucket_rows else []
    tied = tie(docs) if tied_by is None else tied_by
    rows = docs.withColumns({n("stream"): F.when(source.isin(named), source).otherwise(F.lit(OTHERS)) if named else F.lit(OTHERS), tmp("key"): key, tmp("tie"): F.lpad(F.hex(tied), 16, "0")})
    bucket = F.substring(tmp("key"), 1, digits(count))
    if hot:
        bucket = F.when(F.col(tmp("key")).isin(hot), F.concat(tmp("key"), F.lit("/"), F.substring(tmp("tie"), 1, digits(count)))).otherwise(bucket)
    rows = rows.withColumn(tmp("bucket"), bucket)
    group = [n("stream"), tmp("bucket")]
    counts = rows.groupBy(*group).agg(F.count("*").alias(tmp("n")))
    before = Window.partitionBy(n("stream")).orderBy(tmp("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum(tmp("n")).over(before), F.lit(0)).alias(tmp("start")))
    inside = Window.partitionBy(*group).orderBy(tmp("key"), id_col, tmp("tie"))
    rows = rows.withColumn(tmp("place"), F.row_number().over(inside))
    rows = rows.join(starts, group)
    at = F.col(tmp("start")) + F.col(tmp("place")) - 1
    j = F.expr(f"`{tmp('j')}`")
    rows = rows.withColumn(tmp("at"), at.cast("long")).withColumn(tmp("j"), F.expr(f"`{tmp('at')}` div {block}"))
    stream = F.col(n("stream"))
    share = _by_stream(stream, {s: F.lit(c).cast("long") for s, c in weights.items()})
    slot = _by_stream(stream, {s: F.element_at(F.array(*(F.lit(x).cast("long") for x in own[s])), (j % len(own[s]) + 1).cast("int")) for s in weights})
    rows = rows.withColumn(tmp("share"), share)
    period_of = F.expr(f"`{tmp('j')}` div `{tmp('share')}`")
    return rows.select(*docs.columns, stream, j.alias(n("block")), (F.col(tmp("at")) % block).cast("int").alias(n("place")), (period_of * total + slot).alias(n("slot")))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, **options) -> DataFrame:
    """docs with the same rows and columns, in the order of the schedule."""
    planned = schedule(docs, weights, prefix="__mix_out_", **options)
    ordered = planned.repartitionByRange(partitions(docs.sparkSession), "__mix_out_slot", "__mix_out_place").sortWithinPartitions("__mix_out_slot", "__mix_out_place")
    return ordered.select(*docs.columns)


def op8_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """The slot of every document in the production mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs).select("doc_id", "source", "stream", "block", "place", "slot")


def _sql(weights: dict[str, int], block: int) -> str:
    own = _slots(weights)
    rows = ", ".join(f"('{s}', {i}, {x}, {weights[s]})" for s in weights for i, x in enumerate(own[s]))
    named = ", ".join(f"'{s}'" for s in weights if s != OTHERS)
    return f"""
WITH period(stream, i, slot_in, share) AS (VALUES {rows}),
d AS (SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '{OTHERS}' END AS stream FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS n FROM d),
b AS (SELECT *, n // {block} AS block FROM r)
SELECT b.doc_id, b.source, b.stream, CAST(b.block AS BIGINT) AS block, CAST(n % {block} AS INTEGER) AS place,
       CAST((b.block // p.share) * {sum(weights.values())} + p.slot_in AS BIGINT) AS slot
FROM b JOIN period p ON p.stream = b.stream AND p.i = b.block % p.share
"""


OP8_SQL = _sql(WEIGHTS, BLOCK)
