"""TIFF media columns: one row per page of each image, and a lossless writer for byte payloads.

The reader walks the chain of image directories, decodes strips or tiles (none, PackBits, LZW or
deflate), undoes the horizontal predictor and assembles 8- or 16-bit samples, for either byte
order. It works on whole files, a page at a time, so a task's memory follows the largest file and
its largest page (2 GiB at most). Sizes that a file claims are checked against what its data can
hold before anything is allocated, and no decoder makes more than its strip or tile needs.

Defined results: a null or empty file has no pages; a file that cannot be read, or one of whose
pages cannot, gives one row with a null page and the reason in ``error``; missing strips and a
directory chain that loops are such errors;
samples come in row order, pixels interleaved, 16-bit samples little-endian. Other columns are
carried through, and the names of the new columns can be prefixed to keep them from clashing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finscan.llm.shared import table

WIDTH = 64
STRIP_ROWS = 1024
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
# Fixed values of the TIFF 6.0 format: bytes of each field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class TiffError(ValueError):
    pass


def packbits_decode(data: bytes, most: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        end = i + 1
        while end < n and end - i < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def lzw_decode(data: bytes, most: int) -> bytes:
    """TIFF's LZW: codes most significant bit first, 9 to 12 bits, widened one code early."""
    out, entries, before = bytearray(), [], b""
    acc = bits = 0
    width = 9
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = acc >> bits
            acc &= (1 << bits) - 1
            if code == 257 or len(out) >= most:
                return bytes(out)
            if code == 256:
                entries, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if not entries:
                raise TiffError("LZW data does not begin with a clear code")
            if not before:
                text = entries[code]
            else:
                if code < len(entries):
                    text = entries[code]
                elif code == len(entries):
                    text = before + before[:1]
                else:
                    raise TiffError("LZW code out of range")
                entries.append(before + text[:1])
            out += text
            before = text
            size = len(entries)
            width = 12 if size >= 2047 else 11 if size >= 1023 else 10 if size >= 511 else 9
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc = bits = 0
    out = bytearray()
    codes: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits)
            acc &= (1 << bits) - 1

    put(256)
    codes = {bytes([i]): i for i in range(256)}
    top, text = 258, b""
    for i in range(len(data)):
        more = text + data[i : i + 1]
        if more in codes:
            text = more
            continue
        put(codes[text])
        codes[more] = top
        top += 1
        if top == 4094:
            put(256)
            codes, top, width = {bytes([j]): j for j in range(256)}, 258, 9
        else:
            width = 12 if top > 2047 else 11 if top > 1023 else 10 if top > 511 else 9
        text = data[i : i + 1]
    if text:
        put(codes[text])
        top += 1
        width = 12 if top > 2047 else 11 if top > 1023 else 10 if top > 511 else 9
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes, and the checksum where the data ends there."""
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, most)
        z.decompress(z.unconsumed_tail, 1)
    except zlib.error as e:
        raise TiffError(f"deflate data: {e}") from e
    return out


DECODERS = {NONE: lambda b, most: b, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: packbits_decode}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}
#: The most bytes that a byte of stored data can stand for, and the most bytes of a page (an Arrow value).
GROWTH = {NONE: 1, LZW: 2560, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 128}
LARGEST = (1 << 31) - 1


def _blocks(image: np.ndarray, strip_rows: int, tile: int | None) -> Iterator[np.ndarray]:
    if tile is None:
        for at in range(0, len(image), strip_rows):
            yield image[at : at + strip_rows]
        return
    height, width = image.shape
    image = np.pad(image, ((0, -height % tile), (0, -width % tile)))
    for top in range(0, height, tile):
        for left in range(0, width, tile):
            yield image[top : top + tile, left : left + tile]


def write_tiff(payload: bytes, *, width: int = WIDTH, compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: int | None = None, page_rows: int | None = None) -> bytes:
    """A grey 8-bit image whose rows are the payload, of a positive multiple of width bytes.

    The rows are dealt over pages of page_rows (default: one page), each in strips or, with tile (a
    multiple of 16), in square tiles.
    """
    height, rest = divmod(len(payload), width)
    if rest or not height:
        raise ValueError("the payload must be a positive multiple of the width")
    if tile is not None and (tile <= 0 or tile % 16):
        raise ValueError("the side of a tile must be a positive multiple of 16")
    image = np.frombuffer(payload, np.uint8).reshape(height, width)
    out, at = [b"II*\0", struct.pack("<I", 8)], 8
    step = page_rows or height
    for first in range(0, height, step):
        page, stored = image[first : first + step], []
        for block in _blocks(page, strip_rows, tile):
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            stored.append(ENCODERS[compression](block.astype(np.uint8).tobytes()))
        n = len(stored)
        sizes = [len(s) for s in stored]
        fields = [(256, 4, [width]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        fields += [(273, 4, [0] * n), (278, 4, [strip_rows]), (279, 4, sizes)] if tile is None else [(322, 4, [tile]), (323, 4, [tile]), (324, 4, [0] * n), (325, 4, sizes)]
        tail = at + 2 + 12 * len(fields) + 4
        data_at = tail + (8 * n if n > 1 else 0)
        starts = (np.cumsum([0, *sizes[:-1]]) + data_at).tolist()
        out.append(struct.pack("<H", len(fields)))
        extra = b""
        for tag, kind, values in sorted(fields):
            values = starts if tag in (273, 324) else values
            raw = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(values), *values)
            if len(raw) > 4:
                out.append(struct.pack("<HHII", tag, kind, len(values), tail + len(extra)))
                extra += raw
            else:
                out.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        at = data_at + sum(sizes) + sum(sizes) % 2
        out += [struct.pack("<I", at if first + step < height else 0), extra, *stored, b"\0" * (sum(sizes) % 2)]
    return b"".join(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise TiffError("the directory chain loops")
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = SIZES.get(kind, 0) * n
            if size > len(data):
                raise TiffError(f"field {tag} is longer than the file")
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if kind in (1, 2, 7):
                fields[tag] = list(data[where : where + n])
            elif kind in (3, 4):
                fields[tag] = list(struct.unpack_from(order + {3: "H", 4: "I"}[kind] * n, data, where))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def _page(data: bytes, order: str, f: dict[int, list]) -> tuple[int, int, int, int, bytes]:
    width, height, samples = f[256][0], f[257][0], f.get(277, [1])[0]
    bits = f.get(258, [1])
    if len(set(bits)) > 1 or bits[0] not in (8, 16):
        raise TiffError(f"{bits} bits a sample are not supported")
    if f.get(284, [1])[0] != 1 and samples > 1:
        raise TiffError("separate planes are not supported")
    decode = DECODERS.get(f.get(259, [1])[0])
    if decode is None:
        raise TiffError(f"compression {f[259][0]} is not supported")
    kind = np.dtype(np.uint8 if bits[0] == 8 else f"{order}u2")
    predictor = f.get(317, [1])[0]
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not supported")
    tiled = 322 in f
    if not (width and height and samples):
        raise TiffError("an empty page")
    if width * height * samples * kind.itemsize > LARGEST:
        raise TiffError("a page of more than 2 GiB")
    if tiled:
        w, h, offsets, counts = f[322][0], f[323][0], f[324], f[325]
    else:
        w, h, offsets = width, min(f.get(278, [height])[0], height), f[273]
        counts = f.get(279) or [height * width * samples * kind.itemsize]
    if not (w and h):
        raise TiffError("empty strips")
    across = -(-width // w)
    blocks = across * -(-height // h)
    if len(offsets) < blocks or len(counts) < blocks:
        raise TiffError(f"{len(offsets)} places and {len(counts)} sizes for {blocks} strips or tiles")
    growth = GROWTH[f.get(259, [1])[0]]
    needs = [(h if tiled else min(h, height - i // across * h)) * w * samples * kind.itemsize for i in range(blocks)]
    if any(at + n > len(data) for at, n in zip(offsets[:blocks], counts[:blocks], strict=True)):
        raise TiffError("a strip or tile reaches beyond the file")
    if any(need > min(LARGEST, growth * n) for need, n in zip(needs, counts, strict=False)):
        raise TiffError("a strip or tile is larger than its data can hold")
    image = np.zeros((height, width, samples), kind.newbyteorder("<"))
    for i, (at, n, need) in enumerate(zip(offsets, counts, needs, strict=False)):
        top, left = i // across * h, i % across * w
        rows = need // (w * samples * kind.itemsize)
        raw = decode(data[at : at + n], need)
        if len(raw) < need:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(raw, kind, rows * w * samples).reshape(rows, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        image[top : top + rows, left : left + w] = block[: height - top, : width - left]
    return width, height, samples, bits[0], image.tobytes()


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(width, height, samples, bits, pixels) of each page, one at a time."""
    try:
        for order, f in _directories(data):
            yield _page(data, order, f)
    except TiffError:
        raise
    except (struct.error, LookupError, ValueError, ArithmeticError, TypeError, MemoryError) as e:
        raise TiffError(f"damaged: {e!r}") from e


def read_tiff(data: bytes) -> list[tuple[int, int, int, int, bytes]]:
    return list(pages(data))


def sound(data: bytes) -> Iterable[tuple[int, int, int, int, bytes]]:
    """The pages, once all have been seen to be readable; of large files only some are held and all read twice."""
    held, size, rest = [], 0, pages(data)
    for page in rest:
        held.append(page)
        size += len(page[4])
        if size > BATCH_BYTES:
            break
    else:
        return held
    del held
    for _ in rest:
        pass
    return pages(data)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    c = batch.column(name)
    return c.cast(pa.binary()) if not pa.types.is_binary(c.type) else c


PAGE = [("page", pa.int32(), T.IntegerType()), ("width", pa.int32(), T.IntegerType()), ("height", pa.int32(), T.IntegerType()), ("samples", pa.int32(), T.IntegerType()), ("bits", pa.int32(), T.IntegerType()), ("pixels", pa.binary(), T.BinaryType()), ("error", pa.string(), T.StringType())]
BATCH_BYTES = 8 << 20


def _grown(batch: pa.RecordBatch, rows: list[int], more: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    kept = batch.take(pa.array(rows, pa.int32()))
    new = [pa.array([m[j] for m in more], k) for j, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*kept.columns, *new], [*kept.schema.names, *names])


def decode_pages(df: DataFrame, media_col: str = "media", *, prefix: str = "") -> DataFrame:
    """One row per page of each image: df's columns without media_col, then page, width, height, samples, bits, pixels, error."""
    kept = [c for c in df.columns if c != media_col]
    names, kinds = [prefix + n for n, _, _ in PAGE], [k for _, k, _ in PAGE]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(prefix + n, t) for n, _, t in PAGE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, rest = _column(batch, media_col), batch.select(kept)
            rows, out, held = [], [], 0
            for i in range(batch.num_rows):
                data = media[i].as_py()
                if not data:
                    continue
                try:
                    found = ((j, *page, None) for j, page in enumerate(sound(data)))
                except TiffError as e:
                    found = [(*(None,) * 6, str(e))]
                for page in found:
                    rows.append(i)
                    out.append(page)
                    held += len(page[5] or b"")
                    if held >= BATCH_BYTES:
                        yield _grown(rest, rows, out, kinds, names)
                        rows, out, held = [], [], 0
            yield _grown(rest, rows, out, kinds, names)

    return df.mapInArrow(run, schema)


def encode_payloads(df: DataFrame, payload_col: str, *, media_col: str = "media", width: int = WIDTH, style: Callable[[bytes], dict] | None = None, **options) -> DataFrame:
    """Each payload (null: empty), padded with zero bytes to a positive multiple of width, as an image.

    Returns df's columns without payload_col, then n_bytes (before padding) and media_col. options are
    those of write_tiff; style may choose more of them for a padded payload.
    """
    kept = [c for c in df.columns if c != payload_col]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])
    options = {"predictor": 2, **options}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, rest = _column(batch, payload_col), batch.select(kept)
            rows, out, held = [], [], 0
            for i in range(batch.num_rows):
                raw = data[i].as_py() or b""
                padded = raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0")
                media = write_tiff(padded, width=width, **(options | (style(padded) if style else {})))
                rows.append(i)
                out.append((len(raw), media))
                held += len(media)
                if held >= BATCH_BYTES:
                    yield _grown(rest, rows, out, [pa.int64(), pa.binary()], ["n_bytes", media_col])
                    rows, out, held = [], [], 0
            yield _grown(rest, rows, out, [pa.int64(), pa.binary()], ["n_bytes", media_col])

    return df.mapInArrow(run, schema)


class Described:
    """Digest and features of one image, from its pages of 8-bit grey samples in turn."""

    def __init__(self, width: int):
        self.width, self.rows, self.sha, self.tail, self.last, self.steps = width, 0, hashlib.sha256(), b"", None, 0
        self.levels = np.zeros(256, np.int64)

    def add(self, pixels: bytes) -> None:
        a = np.frombuffer(pixels, np.uint8).reshape(-1, self.width)
        self.levels += np.bincount(a.ravel(), minlength=256)
        b = a if self.last is None else np.vstack([self.last, a])
        self.steps += int(np.abs(np.diff(b.astype(np.int16), axis=0)).sum())
        self.rows, self.last, self.tail = self.rows + len(a), a[-1:], (self.tail + pixels[-64:])[-64:]
        self.sha.update(pixels)

    def feature(self) -> str:
        """Size, mean, deviation, entropy and mean vertical step."""
        p, levels = self.levels / self.levels.sum(), np.arange(256)
        # Of whole numbers, so that no order of sums shows in the last digit.
        mean = int(self.levels @ levels) / int(self.levels.sum())
        deviation = float(np.sqrt(max(0.0, p @ (levels - mean) ** 2)))
        entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
        step = self.steps / ((self.rows - 1) * self.width) if self.rows > 1 else 0.0
        return f"{self.width}x{self.rows} mean={mean:.3f} dev={deviation:.3f} entropy={entropy + 0.0:.4f} step={step:.3f}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each image; its pages come one after another, in one task."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    row, seen, out = None, None, []

    def done() -> tuple:
        return (row["doc_id"], row["n_bytes"], seen.rows * seen.width, seen.sha.hexdigest(), zlib.crc32(seen.tail), row["media_bytes"], row["media_sha256"], seen.feature())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names)

    for b in batches:
        for r in b.to_pylist():
            if r["error"] is not None:
                raise TiffError(f"document {r['doc_id']}: {r['error']}")
            if r["page"] == 0:
                if row is not None:
                    out.append(done())
                row, seen = {k: r[k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256")}, Described(r["width"])
            seen.add(r["pixels"])
        if out:
            yield batch()
            out = []
    if row is not None:
        out.append(done())
        yield batch()


#: What the query's files look like, by the payload's checksum: each decoder takes a part.
STYLES = [{"compression": DEFLATE}] * 4 + [{"compression": DEFLATE, "tile": 32, "predictor": 1}, {"compression": PACKBITS}, {"compression": LZW, "predictor": 1}, {"compression": NONE, "predictor": 1}]
PAGE_ROWS = 256


def style_of(payload: bytes) -> dict:
    return STYLES[zlib.crc32(payload) % len(STYLES)]


def op5_tiff_pages(spark, sf_dir: str) -> DataFrame:
    """Each whole text stored as a TIFF image of one or more pages, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    media = encode_payloads(docs, "text", style=style_of, page_rows=PAGE_ROWS)
    described = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return decode_pages(described).mapInArrow(_digests, DIGEST)
