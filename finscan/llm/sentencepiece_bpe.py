"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, without the SentencePiece library: pieces with their scores and
types, the trainer's model type, byte fallback and unknown id, the normaliser's character map and
white-space rules. From these a tokenizers pipeline is rebuilt: normaliser (precompiled map,
white-space squeezing, the metaspace marker, the dummy prefix), a unigram model with the pieces'
scores or a BPE model whose merges follow from them, byte fallback, and the matching decoder.

Batches of whole texts are encoded by the library's threads. A long text is encoded in parts that
are cut where a marker follows another character; that is exact if no piece holds a marker behind
another character (checked on the pieces; otherwise the text is encoded in one go). Decoding joins
the pieces' bytes, byte pieces among them, and reads them as UTF-8.

``verify`` compares each text's ids with the SentencePiece library's own, and the text that they decode
to with the one that that library decodes them to (column ``parity``). Tests hold the decoding against
the pipeline's decoder as well.

Defined results: a null text has null ids, tokens and decoded text; an empty text has no ids; a
lone surrogate cannot occur in Spark's strings. Other columns are carried through; ``prefix`` keeps
new names from clashing with them.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from finscan.llm.shared import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
PART_CHARS = 1 << 16
BATCH_CHARS = 1 << 18
CUT = re.compile(rf"[^{MARK}](?={MARK})")
# Fixed values of the model's protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"protobuf wire type {kind}")
            size = varint()
        yield number, data[at : at + size]
        at += size


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_id = trainer.get(40, 0)
        self.suffix = bool(trainer.get(24, 0))
        self.unk_surface = trainer.get(44, " \u2047 ".encode())
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with escaped, leading white space are supported")
        self.splittable = not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED))


def merges(model: Model) -> list[tuple[str, str]]:
    """The BPE merges that a model's piece scores imply: best piece first, each way to make it."""
    usable = {p: (s, i) for i, (p, s, t) in enumerate(model.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
    out = []
    for piece, _ in sorted(usable.items(), key=lambda x: (-x[1][0], x[1][1])):
        ways = ((piece[:i], piece[i:]) for i in range(1, len(piece)))
        out += sorted((w for w in ways if w[0] in usable and w[1] in usable), key=lambda w: (usable[w[0]][1], usable[w[1]][1]))
    return out


class Codec:
    """Encodes and decodes batches of texts with a tokenizers pipeline rebuilt from a model."""

    def __init__(self, model: Model, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        steps = []
        if model.charsmap:
            steps.append(normalizers.Precompiled(model.charsmap))
        if model.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        steps.append(normalizers.Replace(" ", MARK))
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        self.plain = not (model.charsmap or model.squeeze)
        self.prefix = MARK if model.dummy_prefix else ""
        self.normalizer = normalizers.Sequence(steps)
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        if model.kind == BPE:
            core = models.BPE(vocab=vocab, merges=merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
        else:
            core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
        self.tokenizer = Tokenizer(core)
        tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
        self.splittable = model.splittable
        surface = {UNKNOWN: model.unk_surface, CONTROL: b""}
        self.special = frozenset(i for i, (_, _, t) in enumerate(model.pieces) if t in surface)
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else surface.get(t, p.replace(MARK, " ").encode()) for p, _, t in model.pieces]

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return self.prefix + text.replace(" ", MARK) if self.plain else self.normalizer.normalize_str(text)

    def _parts(self, form: str) -> list[str]:
        """The form, cut into parts of about PART_CHARS where that changes nothing."""
        if len(form) <= 2 * PART_CHARS or not self.splittable:
            return [form]
        cuts, at = [0], PART_CHARS
        while at < len(form) and (m := CUT.search(form, at)):
            cuts.append(m.end())
            at = m.end() + PART_CHARS
        return [form[a:b] for a, b in zip(cuts, [*cuts[1:], len(form)], strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self._parts(self.normalise(t)) for t in texts]
        found = iter(self.tokenizer.encode_batch_fast([x for p in parts for x in p], add_special_tokens=False))
        return [next(found).ids if len(p) == 1 else [i for _ in p for i in next(found).ids] for p in parts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        table, skip = self.bytes, len(self.prefix)
        joined = (b"".join([table[i] for i in x]) for x in ids)
        return [(b[1:] if skip and b[:1] == b" " else b).decode("utf-8", "replace") for b in joined]


    def decoded_alike(self, ids: list[list[int]], texts: list[str]) -> list[bool]:
        """Whether the pipeline's own decoder gives the same texts."""
        own = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [a == b or not self.special.isdisjoint(x) for a, b, x in zip(own, texts, ids, strict=True)]


@lru_cache(maxsize=2)
def _codec(data: bytes, threads: int) -> Codec:
    return Codec(Model(data), threads)


@lru_cache(maxsize=2)
def _own(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def _chunks(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """First and last rows of chunks of about BATCH_CHARS."""
    start = size = 0
    for i, n in enumerate(sizes):
        size += n or 0
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, model: str | bytes = MODEL, *, text_col: str = "text", prefix: str = "", threads: int = THREADS, decode: bool = False, verify: bool = False, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, then_schema: str | None = None) -> DataFrame:
    """docs with token_ids array<int> and n_tokens int; with decode also decoded string, with verify also parity boolean.

    model is the model file's bytes, or its path on the driver. then makes rows of then_schema of each
    batch while it is at hand.
    """
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    Model(model)
    new = [("token_ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType(), False)), ("n_tokens", pa.int32(), T.IntegerType())]
    new += [("decoded", pa.string(), T.StringType())] * decode + [("parity", pa.bool_(), T.BooleanType())] * verify
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, t) for n, _, t in new)])
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, threads)
        for batch in batches:
            column = batch.column(at)
            for a, b in _chunks(pc.utf8_length(column).to_pylist()):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                found = codec.encode([t or "" for t in texts])
                ids = [None if t is None else x for t, x in zip(texts, found, strict=True)]
                out = [pa.array(ids, pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int32())]
                back = codec.decode(found) if decode or verify else []
                if decode:
                    out.append(pa.array([None if t is None else x for t, x in zip(texts, back, strict=True)], pa.string()))
                if verify:
                    own = _own(model).encode([t or "" for t in texts], num_threads=threads)
                    alike = [a == b for a, b in zip(back, _own(model).decode(found, num_threads=threads), strict=True)]
                    out.append(pa.array([None if t is None else x == y and same for t, x, y, same in zip(texts, found, own, alike, strict=True)], pa.bool_()))
                done = pa.RecordBatch.from_arrays([*part.columns, *out], schema.names)
                yield then(done) if then else done

    return docs.mapInArrow(run, then_schema if then else schema)


def decode(tokens: DataFrame, model: str | bytes = MODEL, *, ids_col: str = "token_ids", to: str = "decoded", threads: int = THREADS) -> DataFrame:
    """tokens with the text that the ids of each row stand for (null ids: null)."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    schema = T.StructType([*tokens.schema.fields, T.StructField(to, T.StringType())])
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, threads)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            texts = codec.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], schema.names)

    return tokens.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, n_tokens int, ids_sha256 string, round_trip boolean, parity boolean"


def _digest(b: pa.RecordBatch) -> pa.RecordBatch:
    ids, text = b.column("token_ids"), b.column("text")
    flat, ends = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    sha = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() if ok else None for x, y, ok in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
    sizes = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).cast(pa.int64())
    return pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, b.column("n_tokens"), pa.array(sha, pa.string()), pc.equal(text, b.column("decoded")), b.column("parity")], [x.split()[0] for x in DIGEST.split(", ")])


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: number and digest of its ids, exact round trip, parity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decode=True, verify=True, then=_digest, then_schema=DIGEST)
