"""Language identification by nearest centroids.

Every text becomes a vector of hashed letter n-grams (1 to 3 letters of lower-cased words, with
word ends marked), weighted log(1 + tf) * idf and scaled to unit length. Spherical k-means gives
several centroids for each language; a text gets the language of the centroid of highest cosine.

The classifier (idf, centroids, limits) is fitted on at most ``sample`` labelled rows, dealt evenly
over the languages and drawn by a hash of id and text; equal rows count as one. A text is ``rejected`` if its cosine is below its
language's limit for its number of letters. A limit is ``margin`` times a low quantile of the
cosines that the language's own sample texts of about that length have; the smallest ones are left
out, so a few wrongly labelled rows do not lower it, and clusters of only such rows are left out; no
limit is above the middle one of its language. Where the sample has too few texts so short, the limit of the
next longer ones is scaled by the root of the length, as the cosine of a part of a text is. So texts of any length can be rejected.

Prediction sees whole texts and nothing else, row by row, without a shuffle; a long text is counted
in pieces cut at word ends, so that memory does not follow its length.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; so is
every text if nothing was learned; equal cosines go to the smaller language name. Other columns are
carried through; ``prefix`` keeps new names from clashing with them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finscan.llm.shared import table

DIMENSIONS = 2048
SAMPLE = 4000
CENTROIDS = 4
#: The share of a language's texts whose cosines do not count for its limits, and the part of the next one that a text must reach.
QUANTILE = 0.01
MARGIN = 0.75
#: Texts of about one length that a limit needs; limits are kept for the powers of 2 up to 2 ** LENGTHS letters.
LEAST_TEXTS = 20
LENGTHS = 24
#: Clusters with a smaller share of their language's sample are left out: a few odd rows name no language.
LEAST_SHARE = 0.01
#: The share of a language's sample, farthest from its mean, that no centroid starts from: odd rows make no clusters of their own.
OUTER = 0.05
PIECE = 1 << 18
ROWS = 256
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x33480)] + [False])


def _codes(text: str) -> np.ndarray:
    """Code points with everything but letters as one space, and a space at either end."""
    a = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(a, 0x33480)]
    a = np.where(letter, a, np.uint32(32))
    space = a == 32
    return a[np.concatenate([[True], ~(space[1:] & space[:-1])])]


def _pieces(text: str) -> Iterator[str]:
    """text in parts of about PIECE characters, cut at spaces where there are any."""
    at, n = 0, len(text)
    while n - at > 2 * PIECE:
        cut = text.find(" ", at + PIECE, at + 2 * PIECE)
        cut = at + PIECE if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def _tally(codes: list[np.ndarray], owners: list[int], n: int, size: int) -> np.ndarray:
    """Hashed n-gram counts of each owner: n-grams inside words, word ends included."""
    x = np.concatenate(codes).astype(np.uint32)
    owner = np.repeat(np.array(owners, np.int64), [len(c) for c in codes]) * size
    space = x == 32
    shift = np.uint32(32 - (size.bit_length() - 1))
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = ((x * a) ^ (x >> np.uint32(3))) * b >> shift
    keys = [(owner + one)[~space]]
    two = (x[:-1] * a + x[1:]) * b
    two = ((two ^ (two >> np.uint32(15))) * c) >> shift
    keys.append((owner[:-1] + two)[~(space[:-1] & space[1:])])
    three = ((x[:-2] * a + x[1:-1]) * b + x[2:]) * c
    three = ((three ^ (three >> np.uint32(15))) * a) >> shift
    keys.append((owner[:-2] + three)[~space[1:-1]])
    return np.bincount(np.concatenate(keys), minlength=n * size)[: n * size].reshape(n, size)


def counts(texts: list[str | None], size: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram counts, letters) for successive groups of rows."""
    for first in range(0, len(texts), ROWS):
        group = texts[first : first + ROWS]
        total, letters = np.zeros((len(group), size)), np.zeros(len(group), np.int64)
        codes, owners, held = [], [], 0
        for i, text in enumerate(group):
            for piece in _pieces((text or "").lower()):
                code = _codes(piece)
                letters[i] += int((code != 32).sum())
                codes.append(code)
                owners.append(i)
                held += len(code)
                if held >= 2 * PIECE:
                    total += _tally(codes, owners, len(group), size)
                    codes, owners, held = [], [], 0
        if held > 2:
            total += _tally(codes, owners, len(group), size)
        yield first, total, letters


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: of each language, for texts of 1, 2, 4, ... letters
    limits: np.ndarray

    def limit(self, language: int, letters: int) -> float:
        return float(np.interp(np.log2(letters), np.arange(LENGTHS + 1), self.limits[language]))

    def vectors(self, tallies: np.ndarray) -> np.ndarray:
        v = np.log1p(tallies, dtype=np.float32)
        v *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        v /= np.where(norm > 0, norm, 1)
        return v

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        """The best cosine of each unit vector with each language's centroids."""
        if not self.languages:
            return np.zeros((len(vectors), 0))
        c = vectors @ self.centroids.T
        return np.stack([c[:, self.owner == j].max(1) for j in range(len(self.languages))], 1)


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; starts from vectors far from each other, but not from those farthest from all."""
    mean = v.mean(0)
    central = v @ mean
    inner = central >= np.quantile(central, OUTER) if len(v) >= LEAST_TEXTS else np.ones(len(v), bool)
    picked = [int(central.argmax())]
    near = np.where(inner, v @ v[picked[0]], np.inf)
    while len(picked) < min(k, int(inner.sum())):
        far = int(near.argmin())
        if near[far] >= 1 - 1e-9:
            break
        picked.append(far)
        near = np.maximum(near, v @ v[far])
    c = v[picked]
    for _ in range(rounds):
        at = (v @ c.T).argmax(1)
        new = np.stack([v[at == j].sum(0) if (at == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.sqrt((new * new).sum(1, keepdims=True)), 1e-12)
        if np.allclose(new, c, atol=1e-9):
            break
        c = new
    return c


def _limits(cosines: np.ndarray, letters: np.ndarray, margin: float) -> np.ndarray:
    """The limit for each power of 2 of letters, from the cosines of a language's own texts."""
    grid = np.arange(LENGTHS + 1)
    length = np.log2(letters)
    near = [np.sort(cosines[np.abs(length - g) <= 1]) for g in grid]
    if max(map(len, near)) < LEAST_TEXTS:  # a small sample is judged as one
        g = int(round(float(np.median(length))))
        near[min(g, LENGTHS)] = np.sort(cosines)
    least = min(LEAST_TEXTS, max(map(len, near)))
    known = [g for g in grid if len(near[g]) >= least]
    out = np.zeros(len(grid))
    for g in known:
        n = len(near[g])
        out[g] = margin * near[g][max(1, int(QUANTILE * n)) if n >= LEAST_TEXTS else 0]
    # No length is held to more than the middle one of them: a few words said over and over are no other language.
    out[known] = np.minimum(out[known], np.median(out[known]))
    for g in range(known[0] + 1, len(grid)):
        out[g] = out[g] if g in known else out[g - 1]
    for g in reversed(range(known[0])):
        out[g] = out[g + 1] * math.sqrt(0.5)
    return out


def fit_arrays(labels: list[str], tallies: np.ndarray, letters: np.ndarray, *, centroids: int = CENTROIDS, margin: float = MARGIN) -> Model:
    size = tallies.shape[1] if tallies.ndim == 2 else DIMENSIONS
    kept = letters > 0
    if not kept.all():
        labels, tallies, letters = [x for x, k in zip(labels, kept, strict=True) if k], tallies[kept], letters[kept]
    languages = tuple(sorted(set(labels)))
    idf = np.log((1 + len(labels)) / (1 + np.count_nonzero(tallies, axis=0))) + 1 if len(labels) else np.ones(size)
    idf = idf.astype(np.float32)
    model = Model(languages, idf, np.zeros((0, size), np.float32), np.zeros(0, np.int64), np.zeros((0, LENGTHS + 1)))
    if not languages:
        return model
    v, own = model.vectors(tallies), np.array([languages.index(x) for x in labels])
    parts = [_kmeans(v[own == j], centroids) for j in range(len(languages))]
    for j, part in enumerate(parts):
        held = np.bincount((v[own == j] @ part.T).argmax(1), minlength=len(part))
        parts[j] = part[(held >= LEAST_SHARE * held.sum()) | (held == held.max())]
    owner = np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    model = Model(languages, idf, np.concatenate(parts), owner, np.zeros((len(languages), LENGTHS + 1)))
    near = model.cosines(v)
    limits = [_limits(near[own == j, j], letters[own == j], margin) for j in range(len(languages))]
    return Model(languages, idf, model.centroids, owner, np.array(limits))


def fit(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dimensions: int = DIMENSIONS, **options) -> Model:
    """A model of at most ``sample`` of the rows where training holds and text and language are given.

    Only the sample's vectors (``sample`` times ``dimensions`` numbers) come to the driver.
    """
    labelled = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    lang, text = F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    rows = labelled.select(lang, F.xxhash64(F.col(id_col), text).alias("row"), text)
    # Different rows of each language: repeated ones must not starve the draw.
    sizes = {r["lang"]: r["rows"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("row", 0.02).alias("rows")).limit(sample // 4 + 1).collect()}
    if len(sizes) > sample // 4:
        raise ValueError(f"more than {sample // 4} languages")
    each = max(1, sample // max(1, len(sizes)))
    # A uniform draw by hash first, so that no language's rows meet in one task to be ranked.
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (1.3 * each + 60) / max(1, n))))), F.col("lang")) if sizes else F.lit(1.0)
    drawn = rows.where(draw <= share).groupBy("lang", "row").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(draw, "row")
    texts = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, tally, letters in counts(b.column("text").to_pylist(), dimensions):
                raw = [r.astype(np.float32).tobytes() for r in tally]
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(first, len(raw)), pa.array(raw, pa.binary()), pa.array(letters, pa.int64())], ["lang", "tally", "letters"])

    got = texts.mapInArrow(run, "lang string, tally binary, letters long").toArrow().sort_by([("lang", "ascending"), ("tally", "ascending")])
    tallies = np.frombuffer(b"".join(x.as_buffer() for x in got.column("tally")), np.float32).reshape(-1, dimensions)
    return fit_arrays(got.column("lang").to_pylist(), tallies, np.array(got.column("letters").to_pylist(), np.int64), **options)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[bool]]:
    names, scores, rejected = [], [], []
    for _, tally, letters in counts(texts, len(model.idf)):
        for row, n in zip(model.cosines(model.vectors(tally)), letters, strict=True):
            if n == 0 or not len(row):
                names.append(UNDETERMINED)
                scores.append(0.0)
                rejected.append(True)
                continue
            j = int(row.argmax())
            score = float(min(1.0, max(0.0, row[j])))
            names.append(model.languages[j])
            scores.append(score)
            rejected.append(bool(score <= 0 or row[j] < model.limit(j, n)))
    return names, scores, rejected


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred string, score double and rejected boolean."""
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, t) for n, t in new)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rejected = predict(b.column(at).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every text; learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
