"""N-gram Jaccard join by chosen paths.

A document is the set of hashes of its word n-grams (lower case, words of letters and digits, or what
white space parts where there are none; a text of fewer words is one gram). Documents with equal sets form a class; the join runs over classes.

1. In each of several runs a set x follows the grams whose hash, at this step of the run, falls
   below branch / (threshold |x|): sets that share most grams follow mostly the same ones. Sets on
   one path form a bucket. Small buckets are compared by brute force, on sizes and on 64-byte
   sketches, with margins that let a pair of the wanted similarity slip once in ten million. Larger
   ones are split by another step, whose paths hang on the one before, and so on: a bucket is split
   if that at least halves the pairs to compare. Else its sets are near copies of each other. (A
   sample of a bucket tells so at once; it steers the work, not the result.) Then all are compared
   with one of them, and only sets that are not in one component yet with each other, block against
   block in tasks of bounded size, so nothing is capped. Buckets with more
   than a 4,096th of all rows are named beforehand, and never meet in one task.
   The number of runs follows from the target recall: q, the chance that a run misses a pair at the
   threshold however often its buckets are split, is the root of q = exp(-branch (1 - q)).
2. The pairs found connect classes to clusters; a task reports a spanning forest of its pairs only.
3. The gram sets of each cluster come together once, and all pairs in it are verified exactly, again
   block against block where a cluster is large. Links are counted in place and not spelled out.
   This also finds links that the paths have missed within a cluster. A large cluster whose sets hang
   together by chains, so that paths (of other runs) leave less than half the pairs of all blocks to
   compare, is verified in the buckets of those paths; a pair counts in the first bucket it shares.

Components are found with joins and minima in rounds, each written to the shared folder and followed
by the edges between what is left only. Sets are
told apart by 128-bit hashes; they travel under 64-bit numbers, and a number that two sets share is
given up by all but one.

Defined results: texts that are null or without words belong to no class but their own and have no
links; so do rows of a null id; repeated rows are copies of each other; other columns are not read.
Rows of one id with different texts may belong to several classes, which then bear the same id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finscan.llm.shared import partitions, settled, table

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
BRANCH = 2.0
SMALL = 512
SIDE = 512
EXACT_BLOCK = 1024
#: A cluster of more sets than so many blocks may be verified in buckets; rows of a bucket that is dealt apart; steps of a path.
LARGE_BLOCKS = 8
HOT_ROWS, MOST_HOT = 4096, 4096
STEPS = 8
#: Rows of a bucket that tell whether it is dense, the share of alike pairs that makes it so, and slots of hashes that texts are looked up by.
LOOK, DENSE = 64, 0.25
SLOTS = 1 << 19
BINS = 64
U = np.uint64
WORD = re.compile(r"\w+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def grams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    lower = (text or "").lower()
    parts = WORD.findall(lower) or lower.split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, U(k))
    for i in range(k):
        out = _mix(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(tokens: np.ndarray) -> bytes:
    """A byte for each bin of the hashed tokens: from the bin's smallest one, 0 if it is empty."""
    t = np.sort(_mix(tokens ^ U(0xA5A5A5A5A5A5A5A5)))
    edges = np.arange(BINS, dtype=np.uint64) << U(58)
    at = np.searchsorted(t, edges)
    ends = np.concatenate([at[1:], [len(t)]])
    low = t[np.minimum(at, len(t) - 1)]
    return np.where(at < ends, _mix(low) % U(255) + U(1), U(0)).astype(np.uint8).tobytes()


def _limit(n: int, threshold: float, branch: float) -> np.uint64:
    return U(min(2**64 - 1, int(branch / (threshold * n) * 2**64)))


def paths(tokens: np.ndarray, runs: range, threshold: float, branch: float) -> np.ndarray:
    """First steps of the runs."""
    limit = _limit(len(tokens), threshold, branch)
    out = []
    for run in runs:
        first = _mix(tokens + U((run * 2 + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))
        out.append(_mix(first[first <= limit] + U(run)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def steps(tokens: np.ndarray, path: int, threshold: float, branch: float) -> np.ndarray:
    """The next steps of a path."""
    h = _mix(tokens ^ U(path))
    return _mix(h[h <= _limit(len(tokens), threshold, branch)] + U(path))


def miss(branch: float) -> float:
    """The chance at most that a run misses a pair at the threshold, after any number of steps: a branching process dies out."""
    q = 0.0
    for _ in range(200):
        q = math.exp(-branch * (1 - q))
    return q


def runs_for(recall: float, branch: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss(branch)) - 1e-9))


def _long(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _describe(words: int, runs: int, threshold: float, branch: float, node_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for first in range(0, batch.num_rows, 512):
                sigs, sizes, sketches, keys, offsets = [], [], [], [], [0]
                for text in texts.slice(first, 512).to_pylist():
                    tokens = grams(text, words)
                    sigs.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                    sizes.append(len(tokens))
                    sketches.append(sketch(tokens) if len(tokens) else None)
                    if len(tokens):
                        keys.append(paths(tokens, range(runs), threshold, branch))
                    offsets.append(offsets[-1] + (len(keys[-1]) if len(tokens) else 0))
                flat = np.concatenate(keys) if keys else []
                node = [None if s is None else int.from_bytes(s[:8], "little", signed=True) >> (64 - node_bits) for s in sigs]
                columns = [ids.slice(first, 512), batch.column("text_hash").slice(first, 512), pa.array(sigs, pa.binary()), pa.array(node, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_long(flat)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "sig", "node", "n", "sketch", "keys"])

    return run


DESCRIBED = "sig binary, node long, n int, sketch binary, keys array<long>"


STRIP = 256


def _alike(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by sizes and sketches; strip by strip, so that only the answer is of full size."""
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), STRIP):
        out[at : at + STRIP] = _alike_strip(a[at : at + STRIP], na[at : at + STRIP], b, nb, threshold)
    return out


def _alike_strip(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    equal = np.zeros((len(a), len(b)), np.uint8)
    empty = np.zeros((len(a), len(b)), np.uint8)
    for j in range(BINS):
        x, y = a[:, j, None], b[None, :, j]
        equal += x == y
        zx, zy = a[:, j] == 0, b[:, j] == 0
        if zx.any() and zy.any():
            empty += zx[:, None] & zy[None, :]
    return _enough(equal - empty.astype(np.int16), BINS - empty.astype(np.float32), na[:, None], nb[None, :], threshold)


def _enough(equal: np.ndarray, seen: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether so many equal ones of the seen bins, and the sizes, leave the threshold possible."""
    least = (threshold - 5.2 * math.sqrt(threshold * (1 - threshold)) / np.sqrt(np.maximum(seen, 1))) * seen
    return (equal >= least) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component, for a symmetric matrix."""
    n = len(linked)
    label = np.arange(n, dtype=np.int32)
    while True:
        near = [np.where(linked[at : at + STRIP], label[None, :], np.int32(n)).min(1, initial=n) for at in range(0, n, STRIP)]
        new = np.minimum(label, np.concatenate(near).astype(np.int32)) if near else label
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _roots(nodes: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest node of each row's component: buckets that share sets name the same ones, in whatever order their rows come."""
    label = _forest(linked)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    return least[label]


def _tree(nodes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    roots = _roots(nodes, linked)
    own = roots != nodes
    return nodes[own], roots[own]


FOUND = "a long, b long, n int, sketch binary"


def _found(a, b, n=None, sketches=None) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n if n is not None else [None] * m, pa.int32()), pa.array(sketches if sketches is not None else [None] * m, pa.binary())], ["a", "b", "n", "sketch"])


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, BINS)


def _first_step(threshold: float, small: int):
    """Buckets of the first step, sorted by key: edges (n null) of small ones, rows (a: key) of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, large = None, False

        def second(rows: pa.RecordBatch) -> pa.RecordBatch:
            return _found(*(rows.column(c) for c in ("key", "node", "n", "sketch")))

        def brute() -> tuple[np.ndarray, np.ndarray]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            nodes, n, s = rows.column("node").to_numpy(), rows.column("n").to_numpy(), _matrix(rows.column("sketch"))
            return _tree(nodes, _alike(s, n, s, n, threshold))

        out_a, out_b = [], []
        for batch in batches:
            keys, hots = batch.column("key").to_numpy(), batch.column("hot").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(cut, len(keys)))
            for i, (at, size) in enumerate(zip(cut.tolist(), sizes.tolist(), strict=True)):
                if keys[at] != key:
                    if held and not large and sum(h.num_rows for h in held) > 1:
                        a, b = brute()
                        out_a.append(a)
                        out_b.append(b)
                    held, key, large = [], keys[at], False
                rows = batch.slice(at, size)
                if hots[at]:
                    yield second(rows)
                    held, large = [], True
                    continue
                if size == 1 and i + 1 < len(cut) and not held and not large:
                    continue
                if large:
                    yield second(rows)
                    continue
                held.append(rows)
                if sum(h.num_rows for h in held) > small:
                    for h in held:
                        yield second(h)
                    held, large = [], True
            if sum(map(len, out_a)) > 4096:
                yield _found(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b = [], []
        if held and not large and sum(h.num_rows for h in held) > 1:
            a, b = brute()
            out_a.append(a)
            out_b.append(b)
        if out_a:
            yield _found(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of each key of a sorted input, as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new).tolist()
        for at, end in zip(cut, [*cut[1:], batch.num_rows], strict=True):
            key = tuple(c[at] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = key
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocked(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with their block, sent to every pair of blocks (i <= j) of its key that holds it; m has the rows of the key."""
    blocks = F.ceil(F.col("m") / size).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.drop("m").select("*", other)
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def _compare(threshold: float):
    """Edges between the sets of each small bucket, by sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["key"]):
            nodes, n, s = g.column("node").to_numpy(), g.column("n").to_numpy(), _matrix(g.column("sketch"))
            a, b = _tree(nodes, _alike(s, n, s, n, threshold))
            if len(a):
                yield _found(a, b)

    return run


def _stars(threshold: float):
    """Edges between sets and the one that their bucket has chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column("n").to_numpy(), b.column("star_n").to_numpy()
            x, y = _matrix(b.column("sketch")), _matrix(b.column("star_sketch"))
            empty = ((x == 0) & (y == 0)).sum(1)
            linked = _enough((x == y).sum(1) - empty, BINS - empty, n, m, threshold)
            nodes, stars = b.column("node").to_numpy()[linked], b.column("star").to_numpy()[linked]
            yield _found(nodes[nodes != stars], stars[nodes != stars])

    return run


def _across(threshold: float):
    """Edges between the labels of the few sets outside a bucket's main component (side 1) and of a block of all of it (side 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["key", "i", "j"]):
            nodes, n, s, side = g.column("node").to_numpy(), g.column("n").to_numpy(), _matrix(g.column("sketch")), g.column("side").to_numpy()
            label = _forest(_alike(s, n, s, n, threshold) & ((side[:, None] + side[None, :]) > 0))
            known = g.column("label").to_numpy()
            new = known != known[label]
            if new.any():
                yield _found(*np.unique(np.stack([known[new], known[label][new]]), axis=1))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for edges (a, b).

    In each round nodes give way to a smaller one near them, and only the edges between those that
    are left go on, so the rounds' edges get fewer.
    """
    across = lambda of, a, b: settled(of.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    left, rounds = across(edges, "a", "b"), []
    while not rounds or _some(left):
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("to"))
        rounds.append(settled(near.join(jump, "label").select("node", F.col("to").alias("label")), "labels"))
        to = lambda c: rounds[-1].select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
        left = across(left.join(to("a"), "a").join(to("b"), "b"), "a_label", "b_label")
    found = rounds.pop()
    for labels in reversed(rounds):
        found = _relabelled(labels, found)
    return settled(found, "labels")


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (node, label) whose labels are replaced by those that found (node, label) has for them."""
    to = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (node, id, text_hash, ...) with the text of each node; rows has no repeated (id, text_hash).

    Rows whose hash falls into no slot of the chosen ones' hashes are left out before the join: a
    broadcast of at most SLOTS numbers.
    """
    slot = F.pmod("text_hash", F.lit(SLOTS)).alias("__slot")
    near = F.broadcast(chosen.select(slot).distinct())
    return rows.withColumn("__slot", slot).join(near, "__slot", "left_semi").drop("__slot").join(chosen, ["id", "text_hash"])


def _once(rows: DataFrame, base: DataFrame) -> DataFrame:
    """rows without repeated (id, text_hash); only if there are any are texts grouped."""
    repeated = base.where("id is not null and sig is not null").groupBy("id", "text_hash").count().where("count > 1")
    return rows.groupBy("id", "text_hash").agg(F.any_value("text").alias("text")) if _some(repeated) else rows


def _dense(threshold: float):
    """The share of pairs that look alike in a sample of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = []
            for rows in b.column("sample").to_pylist():
                n, s = np.array([r["n"] for r in rows]), np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(-1, BINS)
                pairs = len(n) * (len(n) - 1)
                shares.append((int(_alike(s, n, s, n, threshold).sum()) - len(n)) / pairs if pairs else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(shares, pa.float64())], ["key", "share"])

    return run


def _children(words: int, threshold: float, branch: float):
    """The next steps of the paths that each set is on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                owner, keys, children = [], [], []
                for i, (text, on) in enumerate(zip(part.column("text").to_pylist(), part.column("keys").to_pylist(), strict=True)):
                    tokens = grams(text, words)
                    for key in on:
                        more = steps(tokens, key & (2**64 - 1), threshold, branch)
                        owner.append(np.full(len(more), i))
                        keys.append(np.full(len(more), key, np.int64))
                        children.append(_long(more))
                if owner:
                    at = pa.array(np.concatenate(owner).astype(np.int64))
                    rest = part.select(["node", "n", "sketch"]).take(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(children)), *rest.columns], ["key", "child", "node", "n", "sketch"])

    return run


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _clusters(sets: DataFrame, classes: DataFrame, rows: DataFrame, *, words: int, threshold: float, branch: float, small: int) -> DataFrame:
    """(node, cluster): the components of the pairs that look alike, of the sets met on common paths."""
    parts = partitions(sets.sparkSession)
    sizes = sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT_ROWS)
    total = sets.agg(F.sum(F.size("keys"))).first()[0] or 0
    # More than a MOST_HOT-th of all rows: no more than MOST_HOT keys can have that many.
    hot = [r["key"] for r in sizes.where(F.col("m") > total // MOST_HOT).select("key").collect()]
    first = sets.select("node", "n", "sketch", F.explode("keys").alias("key"))
    first = first.select("key", (F.col("key").isin(hot) if hot else F.lit(False)).alias("hot"), "node", "n", "sketch")
    first = first.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(parts))).otherwise(0))
    found = settled(first.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_first_step(threshold, small), FOUND), "pairs")
    edges = found.where("n is null").select("a", "b")
    open_ = found.where("n is not null").select(F.col("a").alias("key"), F.col("b").alias("node"), "n", "sketch")
    compare = None
    for step in range(2, STEPS + 1):
        if not _some(open_):
            break
        sizes = settled(open_.groupBy("key").agg(F.count("*").alias("m")), "sizes")
        looked = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << 30)) < LOOK * float(1 << 30) / F.col("m")
        sample = open_.join(sizes, "key").where(looked).groupBy("key").agg(F.collect_list(F.struct("n", "sketch")).alias("sample"))
        dense = settled(sample.mapInArrow(_dense(threshold), "key long, share double").where(F.col("share") >= DENSE).select("key"), "dense")
        sparse = open_.join(dense, "key", "left_anti") if step < STEPS else open_.limit(0)
        nodes = sparse.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.collect_list("key").alias("keys"))
        nodes = settled(nodes.join(classes.select("node", "id", "text_hash"), "node"), "open-nodes")
        told = _texts(rows, nodes)
        children = settled(told.mapInArrow(_children(words, threshold, branch), "key long, child long, node long, n int, sketch binary"), "children")
        below = settled(children.groupBy("key", "child").agg(F.count("*").alias("m")), "child-sizes")
        cost = below.groupBy("key").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("cost"))
        # Without children in the table a bucket is dense, or all that met in it meet nowhere below.
        pays = F.when(F.col("dense"), False).otherwise(2 * F.coalesce("cost", F.lit(0.0)) < F.col("m").cast("double") * F.col("m"))
        plan = sizes.join(cost, "key", "left").join(dense.withColumn("dense", F.lit(True)), "key", "left").withColumn("dense", F.coalesce("dense", F.lit(step == STEPS)))
        plan = settled(plan.select("key", "m", pays.alias("split")), "plan")
        whole = open_.join(plan.where(~F.col("split")).select("key", "m"), "key").select("key", "node", "n", "sketch", "m")
        split = settled(below.where("m > 1").join(plan.where("split").select("key"), "key"), "split")
        kept = settled(children.join(split, ["key", "child"]).select(F.col("child").alias("key"), "node", "n", "sketch", "m"), "kept")
        whole = settled(whole.unionAll(kept.where(F.col("m") <= small)), "whole")
        compare = whole if compare is None else compare.unionAll(whole)
        open_ = kept.where(F.col("m") > small).drop("m")
    if compare is None:
        return _named(components(edges))
    few = compare.where(F.col("m") <= small).select("key", "node", "n", "sketch")
    edges = edges.unionAll(few.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare(threshold), FOUND).select("a", "b"))
    many = compare.where(F.col("m") > small)
    if not _some(many):
        return _named(components(edges))
    star = F.min_by(F.struct("node", "n", "sketch"), F.struct(F.xxhash64("node"), "node")).alias("star")
    star = settled(many.groupBy("key").agg(star).select("key", F.col("star.node").alias("star"), F.col("star.n").alias("star_n"), F.col("star.sketch").alias("star_sketch")), "stars")
    near = many.join(star, "key").mapInArrow(_stars(threshold), FOUND).select("a", "b")
    # A set is tied to the smallest of its stars (one for each bucket at most), and those to each other: few pairs say the same.
    near = settled(near.groupBy("a").agg(F.collect_set("b").alias("stars")).select("a", "stars", F.array_min("stars").alias("b")), "star-pairs")
    tied = near.select(F.explode("stars").alias("a"), "b").where("a <> b").distinct()
    labels = components(edges.unionAll(near.select("a", "b")).unionAll(tied))
    named = settled(many.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    main = named.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("main"))
    main = settled(main.select("key", F.col("main.label").alias("main"), F.col("main.c").alias("c")), "main")
    rest = settled(main.join(many.groupBy("key").agg(F.max("m").alias("m")), "key").where("c < m").select("key", "main", (F.col("m") - F.col("c")).alias("others"), "m"), "split-buckets")
    if not _some(rest):
        return _named(labels)
    rows = named.drop("m").join(rest, "key")
    block = lambda of: F.ceil(F.col(of) / SIDE).cast("int")
    place = lambda of: F.pmod(F.xxhash64("node"), block(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), block(of) - 1))
    names = ["key", "i", "j", "side", "node", "n", "sketch", "label"]
    all_ = rows.withColumns({"side": F.lit(0), "j": place("m")}).select("*", every("others").alias("i")).select(*names)
    others = rows.where("label <> main").withColumns({"side": F.lit(1), "i": place("others")}).select("*", every("m").alias("j")).select(*names)
    dealt = all_.unionAll(others).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    # Sets without a label so far are their own.
    more = components(dealt.mapInArrow(_across(threshold), FOUND).select("a", "b"))
    return _named(_relabelled(labels.unionAll(more.select("node", F.col("node").alias("label"))).distinct(), more))


def _named(labels: DataFrame) -> DataFrame:
    return labels.select("node", F.col("label").alias("cluster"))


def _tokens(words: int, runs: range | None = None, threshold: float = THRESHOLD, branch: float = BRANCH):
    """Gram sets of texts, and with runs the first steps of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                sets = [grams(t, words) for t in part.column("text").to_pylist()]
                keys = [_long(paths(t, runs, threshold, branch)) if runs else None for t in sets]
                out = [*(part.column(c) for c in ("node", "cluster", "size")), pa.array([t.tobytes() for t in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["node", "cluster", "size", "tokens", "keys"])

    return run


TOKENS = "node long, cluster long, size long, tokens binary, keys array<long>"


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections; columns of the incidence matrix are taken in slices."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    kept = common[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, (1 << 22) // max(n, 1))
    for low in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        out += m @ m.T
    return out


VERIFIED = "node long, links long, label long, blocks int"


def _earlier(keys: list[list[int]], key: int) -> np.ndarray:
    """Which pairs share a key smaller than this one."""
    return shared_counts([np.array([k for k in mine if k < key], np.int64).view(np.uint64) for mine in keys]) > 0


def _verifier(threshold: float):
    """Links of each node of a pair of blocks, and the spanning forest of them (label null: counts only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["part", "i", "j"]):
            nodes, weight, blocks = g.column("node").to_numpy(), g.column("size").to_numpy(), g.column("blocks")[0].as_py()
            sets = [np.frombuffer(t, np.uint64) for t in g.column("tokens").to_pylist()]
            n = np.array([len(s) for s in sets])
            both = shared_counts(sets)
            linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-4
            np.fill_diagonal(linked, False)
            if g.column("i")[0].as_py() != g.column("j")[0].as_py():
                block = g.column("block").to_numpy()
                linked &= block[:, None] != block[None, :]
            label = _roots(nodes, linked)
            keys = g.column("keys").to_pylist()
            if keys[0] is not None:
                linked &= ~_earlier(keys, g.column("part")[0].as_py())
            links = linked @ weight
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(label), pa.array(np.full(len(nodes), blocks), pa.int32())], ["node", "links", "label", "blocks"])

    return run


def _verified(members: DataFrame, rows: DataFrame, *, words: int, threshold: float, branch: float, runs: int) -> DataFrame:
    """Exact links within the clusters of members (node, cluster, size, id, text_hash)."""
    parts = partitions(members.sparkSession)
    sizes = settled(members.groupBy("cluster").agg(F.count("*").alias("m")), "cluster-sizes")
    large = sizes.where(F.col("m") > LARGE_BLOCKS * EXACT_BLOCK)
    chained = None
    if _some(large):
        told = _texts(rows, members.join(large.select("cluster"), "cluster").select("node", "id", "text_hash", "cluster", "size"))
        own = settled(told.mapInArrow(_tokens(words, range(runs, 2 * runs), threshold, branch), TOKENS), "large-clusters")
        on = own.select("cluster", F.explode("keys").alias("key"))
        below = settled(on.groupBy("cluster", "key").agg(F.count("*").alias("m")).where("m > 1"), "cluster-keys")
        cost = below.groupBy("cluster").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("cost"))
        chained = settled(large.join(cost, "cluster").where(2 * F.col("cost") < F.col("m").cast("double") * F.col("m")).select("cluster"), "chained")
    plain = members if chained is None else members.join(chained, "cluster", "left_anti")
    told = _texts(rows, plain.select("node", "id", "text_hash", "cluster", "size"))
    tokens = told.mapInArrow(_tokens(words), TOKENS).join(sizes, "cluster")
    names = ["part", "i", "j", "block", "blocks", "node", "size", "tokens", "keys"]
    dealt = _blocked(tokens.withColumnRenamed("cluster", "part"), "part", EXACT_BLOCK).select(*names)
    if chained is not None:
        counted = settled(below.join(chained, "cluster"), "chained-keys")
        met = own.join(chained, "cluster").select("cluster", "node", "size", "tokens", "keys", F.explode("keys").alias("key")).join(counted, ["cluster", "key"])
        met = _blocked(met.select(F.col("key").alias("part"), "node", "size", "tokens", "keys", "m"), "part", EXACT_BLOCK)
        dealt = dealt.unionAll(met.withColumn("blocks", F.lit(0)).select(*names))
    dealt = dealt.repartition(parts, "part", "i", "j").sortWithinPartitions("part", "i", "j")
    return settled(dealt.mapInArrow(_verifier(threshold), VERIFIED), "links")


def _told_apart(base: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """base and classes with nodes that no two sets share."""
    shared = classes.groupBy("node").agg(F.count("*").alias("__sets"), F.min("sig").alias("__least")).where("__sets > 1")
    others = settled(classes.join(shared, "node").where("sig <> __least").select("sig", F.xxhash64("sig", F.lit("other")).alias("__node")), "shared-nodes")
    if not _some(others):
        return base, classes
    renamed = lambda df: settled(df.join(others, "sig", "left").withColumn("node", F.coalesce("__node", "node")).select(*df.columns), "told-apart")
    return renamed(base), renamed(classes)


def join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    branch: float = BRANCH,
    small: int = SMALL,
    node_bits: int = 64,
) -> DataFrame:
    """(id, class_id, copy_of, n_copies, n_links, component, text_hash) of each row.

    class_id is the smallest id of the row's component of links, copy_of the smallest id with the
    same gram set, n_copies the rows with that set, n_links the rows of other sets (any id) whose
    similarity reaches the threshold, plus the other copies; component tells components apart (null
    for rows without words or id), text_hash is Spark's xxhash64 of the text.
    """
    runs = runs_for(recall, branch)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    base = settled(rows.mapInArrow(_describe(words, runs, threshold, branch, node_bits), f"id {kind}, text_hash long, {DESCRIBED}"), "grams")
    classes = base.where("sig is not null and id is not null").groupBy("sig").agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.count("*").alias("size"), F.any_value("node").alias("node"))
    classes = settled(classes.select("sig", "node", "size", "rep.id", "rep.text_hash"), "classes")
    base, classes = _told_apart(base, classes)
    # One row stands for each set: the first any task meets, without a shuffle of sketches for copies.
    sets = settled(base.where("sig is not null and id is not null").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys")), "sets")
    rows = _once(rows, base)
    clusters = _clusters(sets, classes, rows, words=words, threshold=threshold, branch=branch, small=small)
    members = settled(classes.join(clusters, "node").select("node", "cluster", "size", "id", "text_hash"), "members")
    verified = _verified(members, rows, words=words, threshold=threshold, branch=branch, runs=runs)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    single = verified.where("blocks = 1").select("node", "label")
    several = verified.where("blocks <> 1 and label <> node").select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = single.unionAll(components(several)) if _some(several) else single
    named = classes.withColumnRenamed("id", "copy_of").drop("text_hash").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    named = named.join(smallest, "label").join(links, "node", "left")
    named = named.select("sig", "class_id", "copy_of", "size", "label", F.coalesce("links", F.lit(0)).alias("links"))
    out = base.select("id", "text_hash", F.when(F.col("id").isNotNull(), F.col("sig")).alias("sig")).join(named, "sig", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("copy_of", "id").alias("copy_of"),
        F.coalesce("size", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.col("label").alias("component"),
        "text_hash",
    )


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay if one row of each component does: that of the smallest id.

    Rows without words stay all; of rows of one id and one text one stays; rows of a null id stay.
    """
    found = join(docs, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), "component")
    found = found.where("__id is not null")
    kept = found.where("component is not null").groupBy("component").agg(F.min(F.struct("__id", "__hash")).alias("kept")).select("kept.__id", "kept.__hash")
    kept = kept.unionAll(found.where("component is null").select("__id", "__hash")).distinct()
    rows = docs.where(F.col(id_col).isNotNull()).withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(F.col(text_col))}).join(kept, ["__id", "__hash"])
    once = rows.withColumn("__place", F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__hash"))).where("__place = 1")
    return once.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op9_chosen_path_join(spark, sf_dir: str) -> DataFrame:
    """Near copies among all documents: the class of each one and its number of links."""
    return join(table(spark, sf_dir, "documents")).drop("text_hash", "component")
