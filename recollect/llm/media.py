"""Media columns: Netpbm and BMP images in a binary column, decoded to numpy arrays.

Images are written to a table in the shared folder and read back from it; what is read is area-resized by integral
images, described by a difference hash, and written as NPY tiles, again to a table that the caller reads.

Defined results: a null text counts as empty; an empty payload becomes one row of 64 zero samples; a null or
malformed image (also one without samples, or with samples beyond its greatest value) gives null features; rows are independent, so repeats give equal values; further columns of the
input pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, flat, fresh

#: Samples in a row of the images that hold a payload.
WIDTH = 64
HASH_ROWS, HASH_COLUMNS = 8, 9


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greyscale Netpbm (P5) of a two-dimensional array of 8-bit samples."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette for two dimensions, 24 bits for (height, width, 3) RGB."""
    height, width = samples.shape[:2]
    grey = samples.ndim == 2
    row = samples if grey else samples[:, :, ::-1].reshape(height, width * 3)
    padded = np.zeros((height, -(-row.shape[1] // 4) * 4), np.uint8)
    padded[:, : row.shape[1]] = row
    palette = b"".join(struct.pack("<BBBB", i, i, i, 0) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    body = padded[::-1].tobytes()
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette + body


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers after the magic, comments skipped, and where the samples begin."""
    at, found = 2, []
    while len(found) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap = kind in (1, 4)
    fields, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height, most = (*fields, 1) if bitmap else fields
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 4:
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)
        samples = 1 - bits[:, :width]
    elif kind == 1:
        digits = np.frombuffer(data[at - 1 :], np.uint8)
        samples = 1 - (digits[(digits == 48) | (digits == 49)][:n] - 48)
    elif kind in (2, 3):
        samples = np.array(data[at - 1 :].split()[:n], np.int64)
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at)
    if samples.size != n:
        raise ValueError("samples are missing")
    if n == 0 or not 0 < most < 65536 or samples.max() > most:
        raise ValueError("no samples, or some beyond the greatest value")
    if most != 255:
        samples = (samples.astype(np.int64) * 255 + most // 2) // most
    shape = (height, width, 3) if channels == 3 else (height, width)
    return samples.astype(np.uint8).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("not an uncompressed BMP of a known depth and some size")
    upward, height = height > 0, abs(height)
    stride = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    rows = rows[::-1] if upward else rows
    if depth >= 24:
        pixels = rows[:, : width * depth // 8].reshape(height, width, depth // 8)
        return pixels[:, :, 2::-1].copy()
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if depth == 8:
        index = rows[:, :width]
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        index = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, :width]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    """8-bit samples of a Netpbm (P1 to P6) or BMP image: (height, width), or (height, width, 3) for RGB."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    """ITU-R 601 luma for RGB; greyscale as it is."""
    return image if image.ndim == 2 else (image @ np.array([0.299, 0.587, 0.114])).astype(np.float64)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas; edges that fall within a sample count in proportion.

    The integral image is interpolated between its corners, which integrates the samples exactly.
    """
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])

    def at(n: int, parts: int):
        where = np.arange(parts + 1) * n / parts
        low = np.minimum(where.astype(np.int64), n - 1)
        return low, where - low

    y, fy = at(image.shape[0], height)
    x, fx = at(image.shape[1], width)
    rows = table[y] * (1 - fy)[:, None] + table[y + 1] * fy[:, None]
    corners = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (image.shape[0] / height * image.shape[1] / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hexadecimal digits: whether each mean is greater than its left neighbour in 8 x 9 areas."""
    small = np.round(area_resize(grey(image), HASH_ROWS, HASH_COLUMNS), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = 32, width: int = 32) -> bytes:
    """The area-resized grey tile in NPY format."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.round(area_resize(grey(image), height, width)).astype(np.uint8)), allow_pickle=False)
    return out.getvalue()


def with_payload_images(docs: DataFrame, text: str, media: str, form: str = "pgm", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) and a binary one: the text's bytes, zero-padded to a positive multiple of 64, as a lossless image."""
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    source = fresh(docs, "payload_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(batch.num_columns - 1))
            for first, last in chunks(offsets):
                images = []
                for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1], strict=True):
                    samples = np.zeros(max(-(-(b - a) // WIDTH), 1) * WIDTH, np.uint8)
                    samples[: b - a] = data[a:b]
                    images.append(encode(samples.reshape(-1, WIDTH)))
                columns = [*batch.slice(first, last - first).columns[:-1], pa.array(images, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], media])

    kept = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(media, T.BinaryType())])
    return docs.select(*kept, F.col(text).cast("string").alias(source)).mapInArrow(run, schema)


#: What media_features() adds.
FEATURES = T.StructType(
    [
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("difference_hash", T.StringType()),
        T.StructField("tile", T.BinaryType()),
    ]
)


def features_of(data: bytes | None, tile: int) -> dict:
    if data is None:
        return dict.fromkeys(FEATURES.names)
    out = dict.fromkeys(FEATURES.names) | {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        image = decode(data)
    except (ValueError, IndexError, OverflowError, struct.error):
        return out
    payload = image.tobytes()
    return out | {
        "height": image.shape[0],
        "width": image.shape[1],
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "difference_hash": difference_hash(image),
        "tile": npy_tile(image, tile, tile),
    }


def media_features(images: DataFrame, media: str, into: str = "features", tile: int = 32) -> DataFrame:
    """Decodes the stored bytes of a media column and adds a struct of FEATURES in its place."""
    kept = [c for c in images.columns if c != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(x.as_py(), tile) for x in batch.column(batch.num_columns - 1)]
            kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("difference_hash", pa.string()), ("tile", pa.binary())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], into])

    schema = T.StructType([*(images.schema[c] for c in kept), T.StructField(into, FEATURES)])
    return images.select(*kept, media).mapInArrow(run, schema)


def stored_features(docs: DataFrame, text: str, tile: int = 32, form: str = "pgm") -> DataFrame:
    """docs without text, with `features`: the texts' bytes are stored as images, read back, and described.

    Two tables in the shared folder: the media column, which goes once it has been read, and the features with tiles.
    """
    scratch = Scratch(docs.sparkSession, "media")
    media, into = fresh(docs, "media", "features")
    images = with_payload_images(docs, text, media, form, [c for c in docs.columns if c != text])
    stored = scratch.table("media", images)
    out = scratch.table("tiles", media_features(stored, media, into, tile))
    scratch.drop("media")
    return out


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of stored_features() over every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = stored_features(docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")), "text")
    return found.select(
        "doc_id",
        "n_bytes",
        "features.payload_bytes",
        "features.payload_sha256",
        "features.tail_crc32",
        "features.media_bytes",
        "features.media_sha256",
        F.concat(F.lit("dhash:"), "features.difference_hash").alias("feature"),
        F.sha2("features.tile", 256).alias("tile_sha256"),
    )
