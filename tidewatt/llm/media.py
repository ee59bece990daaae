"""Media columns: Netpbm and BMP images as arrays, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, stage, texts

WIDTH = 64
_HEADER = re.compile(rb"(?:\s*#([^\n]*)\n|\s)*([0-9A-Za-z]+)")


def encode_pgm(samples: np.ndarray, comment: str = "") -> bytes:
    """A two-dimensional array of bytes as binary Netpbm (P5)."""
    height, width = samples.shape
    note = f"# {comment}\n" if comment else ""
    return f"P5\n{note}{width} {height}\n255\n".encode() + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A two-dimensional array of bytes as BMP with 8 bits a pixel and a grey palette."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + np.array([start + rows.size, 0, start, 40, width, height], "<u4").tobytes()
    head += np.array([1, 8], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 256, 0], "<u4").tobytes()
    return head + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> tuple[np.ndarray, str]:
    at, fields, comment = 0, [], ""
    need = 3 if data[:2] in (b"P1", b"P4") else 4
    while len(fields) < need:
        found = _HEADER.match(data, at)
        if not found:
            raise ValueError("a Netpbm header ends early")
        comment = (found[1] or comment.encode()).decode("latin-1").strip()
        fields.append(found[2])
        at = found.end()
    kind, width, height = fields[0], int(fields[1]), int(fields[2])
    depth = int(fields[3]) if need == 4 else 1
    planes = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        numbers = [x - 48 for x in body if x in b"01"] if kind == b"P1" else body.split()
        flat = np.array(numbers, dtype=np.int64)
    elif kind == b"P4":
        packed = np.frombuffer(data, np.uint8, offset=at + 1, count=-(-width // 8) * height)
        flat = np.unpackbits(packed.reshape(height, -1), axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if depth < 256 else ">u2", offset=at + 1, count=width * height * planes)
    if flat.size != width * height * planes:
        raise ValueError("a Netpbm image has too few samples")
    if kind in (b"P1", b"P4"):
        flat = (1 - flat) * 255
    shape = (height, width, 3) if planes == 3 else (height, width)
    return flat.reshape(shape), comment


def _bmp(data: bytes) -> np.ndarray:
    start, _, width = np.frombuffer(data, "<u4", offset=10, count=3)
    height = int(np.frombuffer(data, "<i4", offset=22, count=1)[0])
    bits = int(np.frombuffer(data, "<u2", offset=28, count=1)[0])
    if bits not in (8, 24, 32) or np.frombuffer(data, "<u4", offset=30, count=1)[0] not in (0, 3):
        raise ValueError("this BMP form is not supported")
    width, count = int(width), abs(height)
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, offset=int(start), count=stride * count).reshape(count, stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = int(np.frombuffer(data, "<u4", offset=46, count=1)[0]) or 256
        palette = np.frombuffer(data, np.uint8, offset=54, count=4 * colours).reshape(colours, 4)[:, 2::-1]
        pixels = palette[rows[:, :width]]
        return pixels[..., 0] if (palette == palette[:, :1]).all() else pixels
    return rows[:, : width * bits // 8].reshape(count, width, bits // 8)[..., 2::-1]


def decode(data: bytes) -> tuple[np.ndarray, str]:
    """The samples of a Netpbm (P1 to P6) or BMP file, and a Netpbm file's comment."""
    return (_bmp(data), "") if data[:2] == b"BM" else _netpbm(data)


def _overlap(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(out + 1) * (size / out)
    low = np.minimum(edges.astype(np.int64), size - 1)
    return low, edges - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each output pixel is the mean of the area that it covers, read from an integral image.

    The integral is linear inside a pixel, so fractional edges are exact.
    """
    grey = image.mean(axis=2) if image.ndim == 3 else image
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(grey, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    row, part = _overlap(grey.shape[0], height)
    lines = total[row] + (total[row + 1] - total[row]) * part[:, None]
    col, part = _overlap(grey.shape[1], width)
    corners = lines[:, col] + (lines[:, col + 1] - lines[:, col]) * part
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums * (height * width / grey.size)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether a pixel of the 9 x 8 reduction is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image reduced to ``side`` x ``side`` bytes, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store_bytes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm") -> DataFrame:
    """Each text's UTF-8 as an image of 64 pixels a row: ``doc_id, n_bytes, media``.

    The last row is filled with zero bytes; the empty or null text is one row
    of them.  Rows are independent: null ids, repeated rows and ties are kept
    as they come, and an empty table gives an empty one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                padded = raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")
                samples = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
                sizes.append(len(raw))
                files.append(encode_bmp(samples) if form == "bmp" else encode_pgm(samples, f"bytes {len(raw)}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(texts(df, id_col, text_col), task, f"doc_id {kind}, n_bytes long, media binary")


def read_features(media: DataFrame, *, tile_side: int = 32) -> DataFrame:
    """Decode stored media: payload and media digests, difference hash and NPY tile.

    Takes ``doc_id, n_bytes, media`` and keeps one row for each.  A null
    ``media`` has null results.  Extra columns are left out.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                if data is None:
                    rows.append((None,) * 7)
                    continue
                image, _ = decode(data)
                payload = np.ascontiguousarray(image, np.uint8).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), npy_tile(image, tile_side) if tile_side else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return map_arrow(media.select("doc_id", "n_bytes", "media"), task, schema)


def media_columns(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", tile_side: int = 32) -> DataFrame:
    """Store every text as an image in the shared folder, read it back and describe it."""
    stored = stage(store_bytes(df, id_col=id_col, text_col=text_col, form=form), "media", compression="zstd")
    return read_features(stored, tile_side=tile_side)

