"""Media columns: Netpbm and BMP images as numpy arrays, resized by integral images, tiled as NPY, difference-hashed.

``encode`` and ``decode`` are exact inverses on 8-bit samples for PGM, PPM and 24-bit BMP. ``area_resize`` averages
the source area under each target pixel through one summed-area table. ``tiles`` cuts an image into NPY blobs;
``tiled`` writes those of each stored image to the shared folder, and ``describe_tiles`` rereads them: the payload is
rebuilt from the tiles, the media digests run over their blobs in order (rows first), and the feature is the tiles'
difference hashes one after another.

Defined cases: a null or empty text is one row of 192 blanks; very long texts are tall images, tiled whole; equal texts
give equal values whatever their row; neighbouring pixels of equal brightness count as no rise; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shapelake.llm.common import Scratch, map_batches, text_rows, texts_of

ROW = 192  # bytes: 64 pixels of three samples


def encode(pixels: np.ndarray, form: str = "ppm") -> bytes:
    """(height, width) gray or (height, width, 3) colour samples as a PGM, PPM or BMP file."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    height, width = pixels.shape[:2]
    if form in ("ppm", "pgm"):
        if (pixels.ndim == 3) != (form == "ppm"):
            raise ValueError("ppm holds colour, pgm holds gray")
        return f"{'P6' if form == 'ppm' else 'P5'}\n{width} {height}\n255\n".encode() + pixels.tobytes()
    if form != "bmp" or pixels.ndim != 3:
        raise ValueError(f"no such form: {form}")
    pad = -3 * width % 4
    rows = np.zeros((height, 3 * width + pad), dtype=np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _netpbm_header(blob: bytes) -> tuple[list[int], int]:
    """The numbers after the magic, and where the samples begin. Comments run from # to the end of a line."""
    want, numbers, at = 2 if blob[:2] in (b"P1", b"P4") else 3, [], 2
    while len(numbers) < want:
        while blob[at : at + 1].isspace() or blob[at : at + 1] == b"#":
            at = blob.index(b"\n", at) + 1 if blob[at : at + 1] == b"#" else at + 1
        end = at
        while blob[end : end + 1].isdigit():
            end += 1
        numbers.append(int(blob[at:end]))
        at = end
    return numbers, at + 1


def decode(blob: bytes) -> np.ndarray:
    """Samples of a PBM, PGM, PPM (plain or raw) or an uncompressed 24- or 32-bit BMP."""
    kind = bytes(blob[:2])
    if kind == b"BM":
        offset, = struct.unpack_from("<I", blob, 10)
        width, height, _, bits, packing = struct.unpack_from("<iiHHI", blob, 18)
        if bits not in (24, 32) or packing:
            raise ValueError("only plain 24- or 32-bit BMP")
        step = bits // 8
        rows = np.frombuffer(blob, dtype=np.uint8, count=abs(height) * ((step * width + 3) // 4 * 4), offset=offset).reshape(abs(height), -1)
        pixels = rows[:, : step * width].reshape(abs(height), width, step)[:, :, 2::-1]
        return pixels[::-1] if height > 0 else pixels
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("neither Netpbm nor BMP")
    numbers, at = _netpbm_header(blob)
    width, height = numbers[:2]
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8, count=height * ((width + 7) // 8), offset=at).reshape(height, -1), axis=1)
        return (255 * (1 - bits[:, :width])).astype(np.uint8)
    if kind == b"P1":
        bits = np.frombuffer(bytes(c for c in blob[at - 1 :] if c in b"01"), dtype=np.uint8) - 48
        return (255 * (1 - bits.reshape(shape))).astype(np.uint8)
    top = numbers[2]
    if kind in (b"P2", b"P3"):
        samples = np.array(blob[at:].split(), dtype=np.int64).astype(np.uint8 if top < 256 else np.uint16).reshape(shape)
    else:
        samples = np.frombuffer(blob, dtype=np.dtype(np.uint8) if top < 256 else np.dtype(">u2"), count=int(np.prod(shape)), offset=at).reshape(shape)
    full = 255 if top < 256 else 65535
    if top in (255, 65535):
        return samples
    return ((samples.astype(np.int64) * full + top // 2) // top).astype(np.uint8 if top < 256 else np.uint16)  # to the full range


def gray(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, fractional borders weighted, from one integral image."""
    rows, cols = image.shape
    table = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=table[1:, 1:])

    def along(t: np.ndarray, n: int, m: int) -> np.ndarray:
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n)
        part = (at - low)[:, None]
        return t[low] * (1 - part) + t[np.minimum(low + 1, n)] * part

    sums = along(along(table, rows, height).T, cols, width).T
    area = (rows / height) * (cols / width)
    return (sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]) / area


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Bits of whether brightness rises to the right in a (size, size + 1) reduction, as hexadecimal."""
    small = area_resize(image, size, size + 1)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def tiles(image: np.ndarray, side: int = 32) -> list[tuple[int, int, bytes]]:
    """(tile row, tile column, NPY blob) of each tile; border tiles are smaller."""
    out = []
    for r in range(0, image.shape[0], side):
        for c in range(0, image.shape[1], side):
            np.save(blob := io.BytesIO(), image[r : r + side, c : c + side])
            out.append((r // side, c // side, blob.getvalue()))
    return out


def text_media(text: str, form: str = "ppm") -> tuple[bytes, int]:
    """The text's UTF-8 bytes, blanks to a positive multiple of ROW, as pixels of an image file; the unpadded length."""
    raw = text.encode("utf-8", "surrogatepass")
    payload = raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))
    pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW // 3, 3)
    return encode(pixels, form), len(raw)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int"
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
TILED_SCHEMA = "doc_id long, n_bytes long, height int, width int, tiles array<binary>"
TILE_SCHEMA = "doc_id long, tile_row int, tile_col int, npy binary, feature string"


def store(docs: DataFrame, form: str = "ppm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an image file."""

    def rows(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out, ids, made, size = [], [], [], 0
        for i, text in zip(batch.column("doc_id"), texts_of(batch), strict=True):
            made.append(text_media(text, form))
            ids.append(i.as_py())
            size += len(made[-1][0])
            if size > 8 << 20:  # small batches, whatever the texts' lengths
                out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([m for m, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"]))
                ids, made, size = [], [], 0
        return [*out, pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([m for m, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])]

    return map_batches(text_rows(docs, id_col, text_col), rows, MEDIA_SCHEMA)


def describe(media: DataFrame, side: int = 32) -> DataFrame:
    """Digests and features of stored images, all taken from the decoded samples."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for blob in batch.column("media").to_pylist():
            pixels = decode(blob)
            payload = np.ascontiguousarray(pixels).tobytes()
            image = gray(pixels)
            h, w = -(-image.shape[0] // side), -(-image.shape[1] // side)
            made.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), difference_hash(image), h * w))
        columns = list(zip(*made, strict=True)) or [()] * 7
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(media, rows, SCHEMA)


def untile(blobs: list[bytes], height: int, width: int, side: int = 32) -> tuple[np.ndarray, list[np.ndarray]]:
    """The image that ``tiles`` cut up, from its NPY blobs in order, and the tiles themselves."""
    held = [np.load(io.BytesIO(b)) for b in blobs]
    image = np.empty((height, width, *held[0].shape[2:]), dtype=held[0].dtype)
    across = -(-width // side)
    for i, tile in enumerate(held):
        r, c = side * (i // across), side * (i % across)
        image[r : r + side, c : c + side] = tile
    return image, held


def tiled(media: DataFrame, side: int = 32, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, height, width, tiles): stored images cut into NPY tiles, written and read again."""

    def rows(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for i in range(len(batch)):
            pixels = decode(batch.column("media")[i].as_py())
            own = [npy for _, _, npy in tiles(pixels, side)]
            columns = [batch.column("doc_id").slice(i, 1), batch.column("n_bytes").slice(i, 1), pa.array([pixels.shape[0]], pa.int32()), pa.array([pixels.shape[1]], pa.int32()), pa.array([own], pa.list_(pa.binary()))]
            out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "height", "width", "tiles"]))
        return out

    return (scratch or Scratch(media.sparkSession, "media")).save(map_batches(media, rows, TILED_SCHEMA), "tiles")


def describe_tiles(stored: DataFrame, side: int = 32) -> DataFrame:
    """Digests and features of tiled images, all taken from the NPY blobs as read."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for height, width, blobs in zip(*(batch.column(c) for c in ("height", "width", "tiles")), strict=True):
            blobs = blobs.as_py()
            pixels, held = untile(blobs, height.as_py(), width.as_py(), side)
            payload, whole = pixels.tobytes(), hashlib.sha256()
            for b in blobs:
                whole.update(b)
            feature = "".join(difference_hash(gray(t)) for t in held)
            made.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), sum(map(len, blobs)), whole.hexdigest(), feature, len(blobs)))
        columns = list(zip(*made, strict=True)) or [()] * 7
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(stored, rows, SCHEMA)


def tile_rows(media: DataFrame, side: int = 32) -> DataFrame:
    """NPY tiles of stored images (gray), each with its own difference hash."""

    def rows(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for i, blob in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            image = gray(decode(blob))
            made = [(i, r, c, npy, difference_hash(image[r * side : (r + 1) * side, c * side : (c + 1) * side])) for r, c, npy in tiles(image, side)]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*made, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()], strict=True)], names=["doc_id", "tile_row", "tile_col", "npy", "feature"]))
        return out

    return map_batches(media, rows, TILE_SCHEMA)
