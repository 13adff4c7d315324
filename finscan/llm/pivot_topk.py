"""Exact top-k search by inner product, with pivot-table elimination.

Every vector is appended one more coordinate, sqrt(M - |v|^2) with M the largest squared norm, so
that the largest inner product is the smallest Euclidean distance. The distances of every candidate
to a fixed set of pivots form the pivot table. By the triangle inequality

    d(q, c) >= max over pivots p of |d(q, p) - d(c, p)|

so that a candidate's inner product is bounded from above. Candidates are taken in the order of
this bound, and the search in a block ends at the first whose bound lies below the k-th best score
found so far. The pivots are candidates themselves, so their scores give the first threshold.

The pivot table is computed once: candidates, quantised and packed in chunks with their distances to
the pivots, are written to the shared folder. Queries are dealt by hash into blocks of about
``query_block``, and one job searches every block in every part (``part_bytes``) of that table: a task
holds one block, reads its part chunk by chunk, and its bounds grow tighter on the way. Nothing but k
rows for each query and part is shuffled, and the driver holds no query and no candidate but
``sample`` rows to choose the pivots from.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part;
a repeated query id is searched once, by its smallest vector; every repeated candidate row counts;
rows with the query's own id are not its candidates; only vectors of one length are compared;
ties go to the smaller id; fewer than k candidates give fewer rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscan.llm.shared import placed, scratch, settled, table

PIVOTS = 32
SAMPLE = 512
QUERY_BLOCK = 256
PART_BYTES = 1 << 30
CHUNK = 8192
STEP = 256
MOST_KEYS = 4096


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id long, v array<long>): floor(scale * x) for each component of each usable vector."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    return vectors.where(usable).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )


def _matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column."""
    lengths = np.diff(values.offsets.to_numpy())
    return lengths, values.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of c with q; in floating point where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[-1]
    if top < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return c @ q.T
    exact = c.astype(object) @ q.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    f = v.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(0.0, top - (f * f).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Indexes of up to n rows, each farthest from those before it."""
    if not len(sample):
        return np.zeros(0, np.int64)
    picked, f = [0], sample.astype(np.float64)
    near = ((f - f[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)):
        far = int(near.argmax())
        if near[far] <= 0:
            break
        picked.append(far)
        near = np.minimum(near, ((f - f[far]) ** 2).sum(1))
    return np.array(picked)


class _Block:
    """Queries of one length, with all that a task needs to search them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivot_ids: np.ndarray, pivots: np.ndarray, top: float, k: int):
        self.ids, self.q, self.pivots, self.top = ids, q, pivots, top
        self.lifted = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        self.norms = (q.astype(np.float64) ** 2).sum(1)
        self.first = np.full(len(q), -np.inf)
        if len(pivots):
            self.table = _distances(self.lifted, _lift(pivots, top))
            s = _scores(q, pivots).T.astype(np.float64)
            s[pivot_ids[None, :] == ids[:, None]] = -np.inf
            if s.shape[1] >= k:
                self.first = np.sort(s, 1)[:, -k]
        else:
            self.table = np.zeros((len(q), 0))


TABLED = "dim int, ids binary, vectors binary, distances binary"
PACKED = "block int, dim int, ids binary, vectors binary"


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of a batch (id, v), for each length in it."""
    all_ids = batch.column("id").to_numpy()
    lengths, flat = _matrix(batch.column("v"))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield dim, all_ids[rows], flat[starts[rows][:, None] + np.arange(dim)[None, :]]


def _bytes(m: np.ndarray) -> bytes:
    """Integers in 4 bytes each if they fit."""
    small = m.size == 0 or (m.min() >= -(2**31) and m.max() < 2**31)
    return m.astype("<i4" if small else "<i8").tobytes()


def _ints(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dim else "<i8").astype(np.int64).reshape(n, dim)


def _tabled(chosen: dict[int, tuple[np.ndarray, np.ndarray]], tops: dict[int, float]):
    """Chunks of candidates with their line of the pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, c in _rows_of(batch):
                for at in range(0, len(ids), CHUNK):
                    part = c[at : at + CHUNK]
                    pivots = _lift(chosen[dim][1], tops[dim])
                    distances = _distances(pivots, _lift(part, tops[dim]))
                    columns = [pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids[at : at + CHUNK].astype("<i8").tobytes(), _bytes(part), distances.astype("<f8").tobytes()))]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "ids", "vectors", "distances"])

    return run


def _packed(query_block: int):
    """Query rows sorted by block and length, packed; a block far above its expected size is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def out() -> pa.RecordBatch:
            m = np.array(rows, np.int64).reshape(len(ids), key[1])
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([_bytes(m)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "dim", "ids", "vectors"])

        for batch in batches:
            for block, i, v in zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if ids and (key != (block, len(v)) or len(ids) >= 2 * query_block):
                    yield out()
                    ids, rows = [], []
                key = (block, len(v))
                ids.append(i)
                rows.append(v)
        if ids:
            yield out()

    return run


@lru_cache(maxsize=4)
def _parts(folder: str, part_bytes: int) -> list[list[str]]:
    """The files of each part of the stored pivot table, the same for all who ask."""
    fs, at = pafs.FileSystem.from_uri(folder)
    files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".parquet"))
    out: list[list[str]] = []
    held = part_bytes
    for path, size in files:
        if held >= part_bytes:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


def _searcher(folder: str, part_bytes: int, chosen: dict[int, tuple[np.ndarray, np.ndarray]], tops: dict[int, float], k: int):
    """The k best of each query of a block, in one part of the stored candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                block = _Block(ids, _ints(row["vectors"], len(ids), row["dim"]), *chosen[row["dim"]], tops[row["dim"]], k)
                best = ([np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.int64)] * len(ids), block.first.copy())
                for path in _parts(folder, part_bytes)[row["part"]]:
                    with fs.open_input_file(path) as f:
                        for chunk in pq.ParquetFile(f).iter_batches(batch_size=1):
                            if chunk.column("dim")[0].as_py() != row["dim"]:
                                continue
                            found, vectors, distances = (chunk.column(c)[0].as_py() for c in ("ids", "vectors", "distances"))
                            found = np.frombuffer(found, "<i8")
                            lines = np.frombuffer(distances, "<f8").reshape(len(block.pivots), len(found))
                            _search(block, found, _ints(vectors, len(found), row["dim"]), lines, best, k)
                sizes = [len(b) for b in best[0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate(best[0])), pa.array(np.concatenate(best[1]))], ["query_id", "vec_id", "score"])

    return run


def _search(block: _Block, ids: np.ndarray, c: np.ndarray, table: np.ndarray, best: tuple, k: int) -> None:
    """Search one chunk of candidates, with their distances to the pivots, for all queries; keeps the k best of each in best."""
    best_ids, best_scores, least = best
    for i in range(len(block.ids)):
        low = np.zeros(len(c))
        for p in range(len(table)):
            np.maximum(low, np.abs(table[p] - block.table[i, p]), out=low)
        bound = (block.norms[i] + block.top - low * low) / 2
        bound += 1e-9 * (block.norms[i] + block.top) + 1e-6
        open_ = np.flatnonzero((bound >= least[i]) & (ids != block.ids[i]))
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        at, step = 0, STEP
        while at < len(open_) and bound[open_[at]] >= least[i]:
            take = open_[at : at + step]
            s = _scores(block.q[i : i + 1], c[take])[:, 0]
            at, step = at + step, step * 2
            good = s >= least[i]
            if not good.any():
                continue
            both_s, both_i = np.concatenate([best_scores[i], s[good]]), np.concatenate([best_ids[i], ids[take][good]])
            order = np.lexsort((both_i, -both_s))[:k]
            best_scores[i], best_ids[i] = both_s[order], both_i[order]
            if len(order) == k:
                least[i] = max(least[i], float(both_s[order[-1]]))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    query_block: int = QUERY_BLOCK,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The k candidates of highest inner product for each row where is_query holds.

    Returns query_id long, rank int (from 1), vec_id long, score long. is_query is written over
    the columns of vectors. sample (rows that the pivots are chosen from) bounds what the driver
    holds; query_block and part_bytes what a task holds and reads.
    """
    spark = vectors.sparkSession
    all_rows = quantised(vectors, id_col, vec_col, scale)
    query_rows = quantised(vectors.where(is_query), id_col, vec_col, scale)
    v = F.col("v")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    tops = {r["n"]: r["top"] for r in all_rows.groupBy(F.size(v).alias("n")).agg(F.max(norm).alias("top")).collect()}
    drawn = all_rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
    chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in tops:
        mine = [r for r in drawn if len(r["v"]) == dim]
        m = np.array([r["v"] for r in mine], np.int64).reshape(len(mine), dim)
        _, first = np.unique(np.array([r["id"] for r in mine], np.int64), return_index=True)
        m, ids = m[first], np.array([mine[j]["id"] for j in first], np.int64)
        at = choose_pivots(m, pivots)
        chosen[dim] = (ids[at], m[at])
    folder = scratch(spark, "pivot-table")
    all_rows.mapInArrow(_tabled(chosen, tops), TABLED).write.parquet(folder)
    queries = query_rows.groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // query_block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(min(blocks, MOST_KEYS), "block").sortWithinPartitions("block", F.size("v"), "id")
    packed = settled(dealt.select("block", "id", "v").mapInArrow(_packed(query_block), PACKED), "query-blocks")
    parts = max(1, len(_parts(folder, part_bytes)))
    n = min(blocks * parts, MOST_KEYS)
    key = F.get(F.array(*(F.lit(int(x)) for x in placed(n))), ((F.col("block").cast("long") * parts + F.col("part")) % n).cast("int"))
    units = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).withColumn("key", key).repartition(n, "key")
    pairs = units.select("dim", "ids", "vectors", "part").mapInArrow(_searcher(folder, part_bytes, chosen, tops, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """Five best candidates by integer inner product for each vector whose id 50 divides."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) AS n FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.n = c.n AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
