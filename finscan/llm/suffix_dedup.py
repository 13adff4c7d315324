"""Exact substring removal with enhanced suffix arrays over common-prefix intervals.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus
(smaller id, or the same document at an earlier start). All strings of all whole texts count.

A suffix array over every byte of a corpus cannot be dealt over a cluster. Two facts make it local.
Equal strings of ``length`` bytes hold the same anchor at the same offset: the leftmost k-gram of
smallest hash. And all starts that share an anchor lie side by side. So

1. each task finds the anchors of its texts (rolling hashes, no text is moved) and sends for each
   anchor its hash, the hash of its context (all bytes of the strings that share the anchor), its
   place and its number of starts, packed and dealt by the anchor's hash. Contexts that a batch
   has seen are settled on the spot, once their bytes have been compared, and sent as spans;
2. a bucket of anchors is sorted by (hash, context, place). All but the first place of an equal
   context are covered (anchor and context: two hashes of 64 bits); anchors with several contexts
   need to be looked at;
3. those contexts' bytes are cut from their texts and dealt by anchor hash again. For each bucket
   an enhanced suffix array (order and common prefixes of all starts in it) is built, and a stack
   scan of the prefixes gives the tree of intervals. An interval at least ``length`` deep whose
   occurrences differ in the byte on their left, or one of which begins its context, is a maximal
   repeat group. It holds all its occurrences; what it spells is removed from all but the first.
   Groups that can be extended to the left need no look: the extended group removes their bytes;
4. the covered starts of each document are joined with its text.

Buckets are as many as the bytes ask for (``bucket_bytes``), at least one for each shuffle partition,
and numbered so that each partition gets one; equal contexts are folded in each batch before any
shuffle, so copies of a passage do not pile up in its bucket, whatever their number. An anchor with
many different contexts (a line that a third of all documents hold, each in other surroundings) is
found by a count beforehand: its contexts are taken apart into their single strings, which are dealt
by their own hashes (two of 64 bits), so that no task meets them all.

repeat_groups() gives the groups themselves. A repeat longer than the context of one anchor is told
by several groups, one for each anchor in it.

Defined results: a null text is an empty one; texts shorter than ``length`` lose nothing; repeated
rows of one id are documents of their own, in the order of a hash of their texts; null ids come
before all others, in the order of such a hash. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finscan.llm.shared import partitions, placed, settled, table

LENGTH = 100
CHUNK = 1 << 17
BATCH_BYTES = 8 << 20
SUB = 32
HELD = 1 << 20
BUCKET_BYTES = 64 << 20
#: Different contexts of an anchor that make it a hot one, in a batch to be counted and in all; at most MOST_HOT are named.
LOCAL, HOT, MOST_HOT = 32, 4096, 1 << 16
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of the base and of its inverse modulo 2**64."""
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    n = CHUNK + 8 * 1024

    def powers(base: int) -> np.ndarray:
        out, size = np.ones(n, np.uint64), 1
        step = base
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = out[:more] * U(step)
            size, step = size + more, step * step & MASK
        return out

    return values, powers(BASE), powers(pow(BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(29))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width successive values."""
    size = 1
    n = len(a) - width + 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[width - size : width - size + n]) if size < width else a


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of starts that share an anchor, in segments of data: anchor hash, context hash, first start, number of starts.

    Every start of a string of ``length`` bytes inside a segment is in one run. Runs whose anchor is one
    of hot (sorted) are taken apart: a run for each start, with two hashes of its string.
    """
    k = length * 48 // 100
    w = length - k + 1
    n = len(data)
    usable = np.maximum(sizes - length + 1, 0)
    if not usable.sum():
        return tuple(np.zeros(0, np.uint64) for _ in range(2)) + tuple(np.zeros(0, np.int64) for _ in range(2))
    values, power, inverse = _tables()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * power[:n], out=total[1:])
    grams = _mix((total[k:] - total[: n + 1 - k]) * inverse[: n + 1 - k])
    keys = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(keys, w) & U(0xFFFFFFFF)).astype(np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(usable)[:-1]]), usable) + np.arange(usable.sum())
    anchor = at[first]
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    low, high = first[cut], first[np.concatenate([cut[1:] - 1, [len(first) - 1]])]
    anchor = anchor[cut]
    context = (total[high + length] - total[low]) * inverse[low]
    context = _mix(context + _mix(((anchor - low).astype(np.uint64) << U(20)) | (high - low).astype(np.uint64)))
    gram, count = grams[anchor], high - low + 1
    if hot is not None and len(hot):
        apart = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
        if apart.any():
            at, _ = _spread(low[apart], high[apart])
            mid = length // 2
            one, two = ((total[at + j] - total[at + i]) * inverse[at + i] for i, j in ((0, mid), (mid, length)))
            string = _mix(one + _mix(two + U(BASE))), _mix(two ^ _mix(one ^ U(BASE)))
            kept = ~apart
            parts = zip((gram, context, low, count), (*string, at, np.ones(len(at), np.int64)), strict=True)
            gram, context, low, count = (np.concatenate([x[kept], y]) for x, y in parts)
            order = np.argsort(low, kind="stable")
            gram, context, low, count = gram[order], context[order], low[order], count[order]
    return gram, context, low, count


def segments(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts in data, sizes, text number, offset in the text) of successive chunks that hold all texts.

    Long texts are cut so that every start of ``length`` bytes lies in one segment.
    """
    parts: list[bytes] = []
    rows: list[tuple[int, int, int, int]] = []
    held = 0

    def full():
        a = np.array(rows, np.int64).reshape(-1, 4)
        return np.frombuffer(b"".join(parts), np.uint8), a[:, 0], a[:, 1], a[:, 2], a[:, 3]

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, CHUNK // 2):
            part = text[at : at + CHUNK // 2 + length - 1]
            if held + len(part) > CHUNK and parts:
                yield full()
                parts, rows, held = [], [], 0
            parts.append(part)
            rows.append((held, len(part), i, at))
            held += len(part)
    if parts:
        yield full()


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, each by byte planes (their many zero bytes compress away)."""
    n = len(columns[0])
    raw = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    return n.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], 8 * n * columns, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def _joined(payloads: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [_unpacked(p, columns) for p in payloads]
    return [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.uint64) for j in range(columns)]


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    columns = [c[order] for c in columns]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), _packed(*(c[a:b] for c in columns))


ANCHORS, SPANS, CONTEXTS = 0, 1, 2
ROW = "bucket int, kind int, payload binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"])


def _bucket(values: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return buckets[(_mix(values.astype(np.uint64)) % U(len(buckets))).astype(np.int64)]


def _text_bucket(doc: np.ndarray, sub: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Rows of one id are dealt apart."""
    return _bucket(doc.astype(np.uint64) * U(BASE) + sub.astype(np.uint64), buckets)


class _Batch:
    """The contexts of some texts: hashes, text number, place in the text, starts; and which are not the first of their kind."""

    def __init__(self, texts: list[bytes], length: int, hot: np.ndarray | None = None):
        found = []
        for data, starts, sizes, number, offset in segments(texts, length):
            h, c, low, n = anchors(data, starts, sizes, length, hot)
            seg = np.searchsorted(starts, low, "right") - 1
            found.append((h, c, number[seg], low - starts[seg] + offset[seg], n))
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        self.h, self.c, self.number, self.at, self.n = (np.concatenate([f[j] for f in found]) for j in range(5)) if found else empty
        by = np.argsort(self.c, kind="stable")  # places are in order already
        new = np.ones(len(by), bool)
        new[1:] = (self.c[by][1:] != self.c[by][:-1]) | (self.h[by][1:] != self.h[by][:-1])
        first = by[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else by
        self.old = np.zeros(len(by), bool)
        self.old[by] = ~new
        rep = np.zeros(len(by), np.int64)
        rep[by] = first
        self._compare(texts, rep, length)

    def _compare(self, texts: list[bytes], rep: np.ndarray, length: int) -> None:
        """Contexts of equal hashes but other bytes are no copies: they get hashes of their own."""
        old = np.flatnonzero(self.old)
        if not len(old):
            return
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        sizes = self.n + length - 1
        width = int(sizes[old].max())
        data = np.frombuffer(b"".join([*texts, bytes(width)]), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(data, width)
        place = begin[self.number] + self.at
        for i in range(0, len(old), 8192):
            a, b = old[i : i + 8192], rep[old[i : i + 8192]]
            same = windows[place[a]] == windows[place[b]]
            same |= np.arange(width)[None, :] >= sizes[a][:, None]
            other = a[~same.all(1) | (sizes[a] != sizes[b])]
            for j in other.tolist():
                self.old[j] = False
                self.c[j] = U(xxhash.xxh3_64_intdigest(data[place[j] : place[j] + sizes[j]].tobytes()))


def _batches(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[bytes], list[list]]]:
    """Texts and other columns of about BATCH_BYTES at a time."""
    texts, rest, held = [], [[] for _ in names], 0
    for b in batches:
        for text, *more in zip(b.column("text"), *(b.column(n).to_pylist() for n in names), strict=True):
            texts.append(text.as_py())
            for x, y in zip(rest, more, strict=True):
                x.append(y)
            held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield texts, rest
                texts, rest, held = [], [[] for _ in names], 0
    if texts:
        yield texts, rest


COUNTED = "anchor long, contexts long, bytes long"


def _counter(length: int):
    """Anchors with many contexts in a batch, and (anchor null) the contexts and bytes of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _batches(batches, ()):
            b = _Batch(texts, length)
            h, many = np.unique(b.h[~b.old], return_counts=True)
            often = many >= LOCAL
            columns = [pa.array([*h[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*many[often].tolist(), int(many.sum())], pa.int64()), pa.array([0] * int(often.sum()) + [sum(map(len, texts))], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "contexts", "bytes"])

    return run


def hot_anchors(texts: DataFrame, length: int = LENGTH) -> tuple[np.ndarray, int]:
    """Anchors (sorted hashes, at most MOST_HOT) with so many contexts that they must be taken apart, and the bytes of all texts (binary)."""
    counted = texts.select("text").mapInArrow(_counter(length), COUNTED).groupBy("anchor").agg(F.sum("contexts").alias("contexts"), F.sum("bytes").alias("bytes"))
    counted = settled(counted.where(F.col("anchor").isNull() | (F.col("contexts") >= HOT)), "anchors")
    all_ = counted.where("anchor is null").first()
    if all_ is None:
        return np.zeros(0, np.uint64), 0
    # More than a MOST_HOT-th of all contexts: no more than MOST_HOT anchors can have that many.
    hot = counted.where(F.col("anchor").isNotNull() & (F.col("contexts") > all_["contexts"] // MOST_HOT)).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in hot], np.int64).view(np.uint64)), all_["bytes"]


def _finder(length: int, buckets: np.ndarray, hot: np.ndarray):
    """Step 1: anchors of a task's texts, and the spans its own batches settle."""

    def batch_rows(texts: list[bytes], docs: np.ndarray, subs: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        order = np.lexsort((subs, docs))
        texts, docs, subs = [texts[i] for i in order], docs[order], subs[order]
        b = _Batch(texts, length, hot)
        doc, at, old, new = docs[b.number], b.at + (subs[b.number] << SUB), b.old, ~b.old
        if old.any():
            yield int(_bucket(doc[old][:1], buckets)[0]), SPANS, _packed(doc[old], at[old], b.n[old])
        for bucket, p in _dealt(_bucket(b.h[new], buckets), b.h[new], b.c[new], doc[new], at[new], b.n[new]):
            yield bucket, ANCHORS, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (docs, subs) in _batches(batches, ("doc", "sub")):
            rows = list(batch_rows(texts, np.array(docs, np.int64), np.array(subs, np.int64)))
            for i in range(0, len(rows), 1024):
                yield _rows(rows[i : i + 1024])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows of each bucket in turn; the input is sorted by bucket."""
    current, rows = None, []
    for b in batches:
        for bucket, kind, payload in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
            if bucket != current:
                if rows:
                    yield current, rows
                current, rows = bucket, []
            rows.append((kind, payload))
    if rows:
        yield current, rows


def _place(at: np.ndarray) -> np.ndarray:
    return at.astype(np.int64)


class _Outbox:
    """Rows of columns by kind, dealt by text bucket once enough are held: a task sends few, large payloads."""

    def __init__(self, buckets: np.ndarray):
        self.buckets, self.held, self.columns = buckets, 0, {}

    def add(self, kind: int, doc_at: int, *columns: np.ndarray) -> None:
        """columns have the document at doc_at, and its place after it."""
        if len(columns[0]):
            self.columns.setdefault((kind, doc_at), []).append(columns)
            self.held += len(columns[0])

    def rows(self, *, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if self.held < HELD and not all_:
            return
        out = []
        for (kind, doc_at), parts in self.columns.items():
            columns = [np.concatenate([p[j] for p in parts]) for j in range(len(parts[0]))]
            out += [(b, kind, p) for b, p in _dealt(_text_bucket(columns[doc_at], _place(columns[doc_at + 1]) >> SUB, self.buckets), *columns)]
        self.columns, self.held = {}, 0
        if out:
            yield _rows(out)


def _settler(text_buckets: np.ndarray):
    """Step 2: spans of repeated contexts, and the contexts that must be looked at, dealt by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(text_buckets)
        for _, rows in _by_bucket(batches):
            box.add(SPANS, 0, *_joined([p for kind, p in rows if kind == SPANS], 3))
            h, c, doc, at, n = _joined([p for kind, p in rows if kind == ANCHORS], 5)
            if len(h):
                order = np.lexsort((_place(at), _place(doc), c, h))
                h, c, doc, at, n = h[order], c[order], doc[order], at[order], n[order]
                new_h = np.concatenate([[True], h[1:] != h[:-1]])
                new = new_h | np.concatenate([[True], c[1:] != c[:-1]])
                group = np.cumsum(new_h) - 1
                open_ = new & (np.bincount(group, weights=new)[group] > 1)
                old = ~new
                box.add(SPANS, 0, doc[old], at[old], n[old])
                box.add(CONTEXTS, 1, h[open_], doc[open_], at[open_], n[open_])
            yield from box.rows()
        yield from box.rows(all_=True)

    return run


def _united(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of half-open spans of each document."""
    if not len(doc):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    base = np.cumsum(new_doc).astype(np.int64) - 1
    # Running maximum of the ends within a document: documents are set apart by a stride beyond any end.
    reach = np.empty(len(doc), np.int64)
    for a, b in zip(np.flatnonzero(new_doc), [*np.flatnonzero(new_doc)[1:], len(doc)], strict=True):
        reach[a:b] = np.maximum.accumulate(high[a:b])
    new = new_doc | np.concatenate([[True], (low[1:] > reach[:-1]) | (base[1:] != base[:-1])])
    cut = np.flatnonzero(new)
    return doc[cut], low[cut], reach[np.concatenate([cut[1:] - 1, [len(doc) - 1]])]


def _texts_of(left: pa.Table) -> dict[tuple[int, int], pa.Scalar]:
    return {(d, s): t for d, s, t in zip(left.column("doc").to_pylist(), left.column("sub").to_pylist(), left.column("text"), strict=True)}


def _cutter(length: int, buckets: np.ndarray):
    """Step 3a: the bytes of contexts, dealt by anchor; the spans so far, united."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        kinds, payloads = right.column("kind").to_pylist(), right.column("payload").to_pylist()
        doc, at, n = map(_place, _joined([p for k, p in zip(kinds, payloads, strict=True) if k == SPANS], 3))
        if len(doc):
            d, low, high = _united(doc, at, at + n)
            rows.append((int(_bucket(d[:1], buckets)[0]), SPANS, _packed(d, low, high - low)))
        h, doc, at, n = _joined([p for k, p in zip(kinds, payloads, strict=True) if k == CONTEXTS], 4)
        if len(h):
            bucket = _bucket(h, buckets)
            order = np.lexsort((_place(at), _place(doc), bucket))
            h, doc, at, n, bucket = h[order], _place(doc)[order], _place(at)[order], _place(n)[order], bucket[order]
            texts, pieces = _texts_of(left), []
            last, text = None, b""
            for d, a, m in zip(doc.tolist(), at.tolist(), n.tolist(), strict=True):
                key = (d, a >> SUB)
                if key != last:
                    last, text = key, texts[key].as_py()
                a &= (1 << SUB) - 1
                pieces.append(text[a : a + m + length - 1])
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
                data = pa.Codec("zstd", 1).compress(b"".join(pieces[a:b]), asbytes=True)
                head = _packed(h[a:b], doc[a:b], at[a:b], n[a:b])
                rows.append((int(bucket[a]), CONTEXTS, len(head).to_bytes(8, "little") + head + data))
        return pa.Table.from_batches([_rows(rows)])

    return run


def suffix_array(data: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts, of room bytes each (ties in the given order), and the common prefix of each with the one before."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(room.max())
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    view[np.arange(width)[None, :] >= room[:, None]] = 0
    order = np.argsort(view.view(f"S{width}").ravel(), kind="stable")
    view = view[order]
    differ = view[1:] != view[:-1]
    deep = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate([[0], np.minimum(deep, np.minimum(room[order][1:], room[order][:-1]))])


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and last of the intervals of the common-prefix tree that are at least ``least`` deep.

    A stack scan; stretches of one depth are intervals at once and don't pass the stack.
    """
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    cut = np.flatnonzero(np.concatenate([[True], np.diff(hot) > 1]))
    begin, end = hot[cut], hot[np.concatenate([cut[1:] - 1, [len(hot) - 1]])]
    depths = lcp[hot]
    top, low = np.maximum.reduceat(depths, cut), np.minimum.reduceat(depths, cut)
    plain = top == low
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for a, b in zip(begin[~plain].tolist(), end[~plain].tolist(), strict=True):
        for i, depth in enumerate(lcp[a : b + 1].tolist(), a):
            left = i - 1
            while stack and stack[-1][0] > depth:
                deep, left = stack.pop()
                found.append((deep, left, i - 1))
            if not stack or stack[-1][0] < depth:
                stack.append((depth, left))
        while stack:
            deep, left = stack.pop()
            found.append((deep, left, b))
    more = np.array(found, np.int64).reshape(-1, 3)
    return tuple(np.concatenate([x, more[:, j]]) for j, x in enumerate((top[plain], begin[plain] - 1, end[plain])))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first..last of each interval, and the interval of each place."""
    sizes = last - first + 1
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


def repeat_intervals(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal repeat groups: depth of each, and of all occurrences the suffix and the number of its group.

    They are the intervals at least ``least`` deep whose suffixes differ in the byte on their left; before
    has the byte before each suffix, 256 where nothing precedes it or it cannot be told (which differs from all).
    """
    depth, first, last = intervals(lcp, least)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    at, owner = _spread(first, last)
    members = order[at]
    left = before[members]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    high = np.maximum.reduceat(left, begin)
    diverse = (high == 256) | (np.minimum.reduceat(left, begin) != high)
    number = np.cumsum(diverse) - 1
    kept = diverse[owner]
    return depth[diverse], members[kept], number[owner[kept]]


def repeats(data: np.ndarray, starts: np.ndarray, room: np.ndarray, before: np.ndarray, least: int = LENGTH) -> list[tuple[int, np.ndarray]]:
    """(length, suffixes) of the maximal repeat groups of data's suffixes at starts."""
    depth, members, group = repeat_intervals(*suffix_array(data, starts, room), before, least)
    return [(int(d), np.sort(members[group == j])) for j, d in enumerate(depth)]


def _unpacked_contexts(rows: list[tuple[int, bytes]], length: int) -> list[np.ndarray] | None:
    heads, data = [], []
    for kind, p in rows:
        if kind != CONTEXTS:
            continue
        size = int.from_bytes(p[:8], "little")
        heads.append(_unpacked(p[8 : 8 + size], 4))
        n = int((_place(heads[-1][3]) + length - 1).sum())
        data.append(pa.Codec("zstd").decompress(p[8 + size :], n, asbytes=True))
    if not heads:
        return None
    h, doc, at, n = (np.concatenate([x[j] for x in heads]) for j in range(4))
    return [h, _place(doc), _place(at), _place(n), np.frombuffer(b"".join(data), np.uint8)]


def _scanner(length: int, text_buckets: np.ndarray):
    """Step 3b: what the repeat groups of each bucket's enhanced suffix array spell, but at their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(text_buckets)
        for _, rows in _by_bucket(batches):
            box.add(SPANS, 0, *_joined([p for kind, p in rows if kind == SPANS], 3))
            contexts = _unpacked_contexts(rows, length)
            if contexts is not None:
                spans: list[tuple[np.ndarray, ...]] = []
                for depth, doc, place, group, _ in groups(*contexts, length):
                    later = np.concatenate([[False], group[1:] == group[:-1]])  # occurrences are in the order of places
                    spans.append((doc[later], place[later], place[later] + depth[group[later]] - length + 1))
                if spans:
                    d, low, high = _united(*(np.concatenate([x[j] for x in spans]) for j in range(3)))
                    box.add(SPANS, 0, d.view(np.uint64), low.view(np.uint64), (high - low).view(np.uint64))
            yield from box.rows()
        yield from box.rows(all_=True)

    return run


WINDOWS = 1 << 17


def _string_hash(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each start."""
    weights = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, length, dtype=np.uint64) * U(2) + U(1)
    view, out = np.lib.stride_tricks.sliding_window_view(data, length), np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), 1 << 14):
        out[i : i + (1 << 14)] = view[starts[i : i + (1 << 14)]].astype(np.uint64) @ weights
    return _mix(out)


def groups(h: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Maximal repeat groups in contexts of one bucket: depth of each, then of all occurrences document, place, group and context.

    Occurrences of a group are side by side, in the order of places. Anchors are independent of each
    other, so as many of them as make WINDOWS starts are taken at once; the starts of a larger one are
    taken in parts by a hash of their strings, which keeps equal strings together.
    """
    sizes = n + length - 1
    offset = np.cumsum(sizes) - sizes
    order = np.argsort(h, kind="stable")
    h, doc, at, n, offset = h[order], doc[order], at[order], n[order], offset[order]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    many = np.concatenate([[0], np.cumsum(n)])
    first = 0
    for last in range(1, len(cut)):
        a, b = cut[first], cut[last]
        if last + 1 < len(cut) and many[cut[last + 1]] - many[a] <= WINDOWS:
            continue
        first = last
        within = np.arange(many[b] - many[a]) - np.repeat(many[a:b] - many[a], n[a:b])
        owner = np.repeat(np.arange(b - a), n[a:b])
        starts = offset[a:b][owner] + within
        parts = -(-len(starts) // WINDOWS)
        chosen = _string_hash(data, starts, length) % U(parts) if parts > 1 else None
        for part in range(parts):
            mine = slice(None) if chosen is None else np.flatnonzero(chosen == part)
            own, start, inside = owner[mine], starts[mine], within[mine]
            d, place = doc[a:b][own], at[a:b][own] + inside
            by = np.lexsort((place, d))
            own, start, inside, d, place = own[by], start[by], inside[by], d[by], place[by]
            before = np.where(inside > 0, data[np.maximum(start - 1, 0)].astype(np.int64), 256)
            depth, members, group = repeat_intervals(*suffix_array(data, start, n[a:b][own] + length - 1 - inside), before, length)
            side = np.lexsort((members, group))
            members, group = members[side], group[side]
            if len(depth):
                yield depth, d[members], place[members], group, order[a:b][own[members]]


RESULT = "doc long, sub long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _remover(length: int, want: bool):
    """Step 4: the removed spans of each text and the bytes that are left."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, at, n = map(_place, _joined([p for p in right.column("payload").to_pylist()], 3))
        doc, low, high = _united(doc, at, at + n + length - 1)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        part = (1 << SUB) - 1
        for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist(), strict=True):
            spans.setdefault((d, a >> SUB), []).append((a & part, (a & part) + b - a))
        docs, subs, sizes, cuts, kept = [], [], [], [], []
        carried = [c for c in left.column_names if c not in ("bucket", "doc", "sub", "text")]
        for (d, s), text in _texts_of(left).items():
            mine = spans.get((d, s), [])
            raw = text.as_buffer()
            data = raw.to_pybytes() if raw is not None else b""
            ends = [0, *(b for _, b in mine)]
            rest = b"".join(data[x:y] for x, y in zip(ends, [*(a for a, _ in mine), len(data)], strict=True)) if mine else data
            docs.append(d)
            subs.append(s)
            sizes.append(len(data))
            cuts.append([{"start": a, "end": b} for a, b in mine])
            kept.append(rest.decode("utf-8", "ignore").encode() if want else hashlib.sha256(rest).digest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(subs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary()), *(left.column(c) for c in carried)], ["doc", "sub", "n_bytes", "spans", "kept", *carried])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc long, sub long, text binary, c0, c1, ...): sub tells rows of one id apart, c0 ... are the carried columns."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    more = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    names = [f"c{i}" for i in range(len(carry))]
    # Rows of a null id are documents of their own, below all ids.
    alone = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64(text), 24)
    doc = F.coalesce(F.col(id_col).cast("long"), alone)
    rows = docs.select(doc.alias("doc"), text.alias("text"), *more)
    repeated = docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").limit(1).count()
    if not repeated:
        return rows.select("doc", F.lit(0).cast("long").alias("sub"), "text", *names)
    # 128 parts of a hash, so that the rows of one id are numbered by many tasks; numbers leave gaps.
    rows = rows.withColumn("__part", F.shiftright(F.xxhash64("text"), 57) + 64)
    order = Window.partitionBy("doc", "__part").orderBy(F.xxhash64("text"), "text")
    return rows.select("doc", (F.col("__part") * (1 << 24) + F.row_number().over(order) - 1).cast("long").alias("sub"), "text", *names)


def _contexts(texts: DataFrame, length: int, bucket_bytes: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Steps 1 to 3a: the buckets, the texts dealt to them, and spans and contexts dealt by anchor."""
    hot, size = hot_anchors(texts, length)
    parts = max(partitions(texts.sparkSession), -(-size // bucket_bytes))
    buckets = placed(parts)
    found = texts.select("doc", "sub", "text").mapInArrow(_finder(length, buckets, hot), ROW)
    settled_ = found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_settler(buckets), ROW)
    by_text = texts.mapInArrow(_bucketed(buckets), T.StructType([T.StructField("bucket", T.IntegerType()), *texts.schema.fields])).repartition(parts, "bucket")
    contexts = by_text.groupBy("bucket").cogroup(settled_.repartition(parts, "bucket").groupBy("bucket")).applyInArrow(_cutter(length, buckets), ROW)
    return buckets, by_text, contexts.repartition(parts, "bucket").sortWithinPartitions("bucket")


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kept: bool = False, carry: list[str] = (), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, sub, n_bytes, spans, kept, c0, ...) of each row: the maximal removed runs [start, end) in bytes, and what is left.

    kept is the SHA-256 of the bytes left, or with kept=True those of its bytes that are whole characters;
    c0, c1, ... are the columns named by carry.
    """
    texts = _numbered(docs, id_col, text_col, list(carry))
    buckets, by_text, contexts = _contexts(texts, length, bucket_bytes)
    scanned = contexts.mapInArrow(_scanner(length, buckets), ROW).repartition(len(buckets), "bucket")
    return by_text.groupBy("bucket").cogroup(scanned.groupBy("bucket")).applyInArrow(_remover(length, kept), T.StructType([*T._parse_datatype_string(RESULT).fields, *texts.schema.fields[3:]]))


CONTEXT = "h long, c long, doc long, at long, n long"
GROUPED = "first_doc long, first_at long, length long, rep_doc long, rep_at long, offset long"


def _plain(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64), pa.int64()) for c in columns], [x.split()[0] for x in names.split(", ")])


def _lister(length: int, hot: np.ndarray):
    """All contexts, copies too, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (docs, subs) in _batches(batches, ("doc", "sub")):
            b, docs, subs = _Batch(texts, length, hot), np.array(docs, np.int64), np.array(subs, np.int64)
            if len(b.h):
                yield _plain(CONTEXT, b.h, b.c, docs[b.number], b.at + (subs[b.number] << SUB), b.n)

    return run


def _grouper(length: int):
    """Occurrences of the maximal repeat groups in the different contexts of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            contexts = _unpacked_contexts(rows, length)
            if contexts is None:
                continue
            for depth, doc, place, group, context in groups(*contexts, length):
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                yield _plain(GROUPED, doc[first][group], place[first][group], depth[group], contexts[1][context], contexts[2][context], place - contexts[2][context])

    return run


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(first_doc, first_sub, first_start, length, doc, sub, start): every occurrence of each maximal repeat group.

    A group is told by its first place and its length in bytes. Suffix arrays are built over different
    contexts; their copies are joined to them by hash, so a task holds no more of a passage than one.
    """
    texts = _numbered(docs, id_col, text_col, [])
    hot, _ = hot_anchors(texts, length)
    all_ = settled(texts.select("doc", "sub", "text").mapInArrow(_lister(length, hot), CONTEXT), "contexts")
    classes = all_.groupBy("h", "c").agg(F.min(F.struct("doc", "at", "n")).alias("rep"), F.count("*").alias("copies"))
    classes = settled(classes.select("h", "c", F.col("rep.doc").alias("rep_doc"), F.col("rep.at").alias("rep_at"), F.col("rep.n").alias("n"), "copies"), "classes")
    _, _, contexts = _contexts(texts, length, bucket_bytes)
    shared = settled(contexts.mapInArrow(_grouper(length), GROUPED), "groups")
    # Copies of a whole context, unless the context is part of another one: then that group holds them.
    own = classes.where("copies > 1").withColumns({"offset": F.lit(0).cast("long"), "length": F.col("n") + length - 1}).join(shared, ["rep_doc", "rep_at", "offset", "length"], "left_anti")
    own = own.select("h", "c", F.col("rep_doc").alias("first_doc"), F.col("rep_at").alias("first_at"), "length", "offset")
    shared = shared.join(classes.select("h", "c", "rep_doc", "rep_at"), ["rep_doc", "rep_at"])
    found = own.unionByName(shared.select(*own.columns)).join(all_, ["h", "c"]).withColumn("place", F.col("at") + F.col("offset"))
    part = lambda c: (F.shiftright(c, SUB), F.col(c).bitwiseAND(F.lit((1 << SUB) - 1)))
    first, place = part("first_at"), part("place")
    return found.select("first_doc", first[0].alias("first_sub"), first[1].alias("first_start"), "length", "doc", place[0].alias("sub"), place[1].alias("start")).distinct()


def _bucketed(buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = _text_bucket(b.column("doc").to_numpy(), b.column("sub").to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *b.columns], ["bucket", *b.schema.names])

    return run


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """docs with repeated strings removed from their texts (null: empty); size_col, if there, counts the characters left."""
    carry = [c for c in docs.columns if c != text_col]
    found = removed_spans(docs, id_col=id_col, text_col=text_col, length=length, kept=True, carry=carry)
    text = F.col("kept").cast("string")
    columns = {c: F.col(f"c{i}") for i, c in enumerate(carry)} | {text_col: text}
    if size_col in carry:
        columns[size_col] = F.length(text).cast(docs.schema[size_col].dataType)
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every whole text once repeated strings of 100 bytes are gone."""
    found = removed_spans(table(spark, sf_dir, "documents"), carry=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("c0").cast("long").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))
