"""TIFF images as columns: strips or tiles, uncompressed, deflated or LZW, with
or without differencing, any count of bands of equal type, interleaved or band
after band, and the place that GeoTIFF tags give an image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RASTER = "struct<width:int,height:int,nBands:int,data:array<double>>"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


#: Gives so many bytes from an offset on.
Read = Callable[[int, int], bytes]


def _of(data: bytes) -> Read:
    return lambda n, at: data[at : at + n]


def _tags(read: Read) -> tuple[str, dict[int, tuple]]:
    """The byte order and the tags of the first image; also of the form for
    files of more than 4 GB."""
    head = read(16, 0)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    large = struct.unpack_from(order + "H", head, 2)[0] == 43
    count, word, at_word = ("Q", "Q", 8) if large else ("H", "I", 4)
    at = struct.unpack_from(order + word, head, at_word)[0]
    size, wide = struct.calcsize(f"{order}HH{word}{word}"), struct.calcsize(order + word)
    (n,) = struct.unpack(order + count, read(struct.calcsize(order + count), at))
    entries = read(size * n, at + struct.calcsize(order + count))
    out = {}
    for i in range(n):
        tag, kind, many = struct.unpack_from(f"{order}HH{word}", entries, size * i)
        if kind not in _CODES:
            continue
        held = entries[size * (i + 1) - wide : size * (i + 1)]
        own = _SIZES[kind] * many
        if own > wide:
            held = read(own, struct.unpack(order + word, held)[0])
        out[tag] = struct.unpack_from(f"{order}{many}{_CODES[kind]}", held)
    return order, out


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first; 256 starts a
    table and 257 ends the data."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    out, table, last, width, bits, held = bytearray(), list(first), b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


_UNPACKED = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32946: zlib.decompress}


def _block(raw: bytes, kind: np.dtype, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """The pixels of a strip or tile as (row, column, sample)."""
    rows, columns, samples = shape
    if predictor == 3:  # bytes of a row by significance, differenced
        width = columns * samples
        by = np.frombuffer(raw, np.uint8, rows * width * kind.itemsize).reshape(rows, -1)
        by = np.cumsum(by.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width)
        return np.ascontiguousarray(by.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    pixels = np.frombuffer(raw, kind, rows * columns * samples).reshape(shape)
    return np.cumsum(pixels, axis=1, dtype=pixels.dtype.newbyteorder("=")) if predictor == 2 else pixels


class Tiff:
    """An image by its tags, whose strips or tiles are read one by one."""

    def __init__(self, read: Read):
        self.read = read
        order, t = _tags(read)
        self.tags, self.width, self.height, self.bands = t, t[256][0], t[257][0], t.get(277, (1,))[0]
        self.unpack, planar, self.predictor = _UNPACKED.get(t.get(259, (1,))[0]), t.get(284, (1,))[0], t.get(317, (1,))[0]
        if self.unpack is None or self.predictor not in (1, 2, 3):
            raise ValueError("a compression that is not read")
        self.kind = np.dtype(f"{order}{_KINDS[t.get(339, (1,))[0]]}{t[258][0] // 8}")
        self.tiled = 322 in t
        self.columns, self.rows = (t[322][0], t[323][0]) if self.tiled else (self.width, min(t.get(278, (self.height,))[0], self.height))
        self.across, down = -(-self.width // self.columns), -(-self.height // self.rows)
        self.samples = 1 if planar == 2 else self.bands
        self.per_plane = self.across * down
        self.offsets, self.sizes = (t[324], t[325]) if self.tiled else (t[273], t[279])

    def block(self, i: int) -> tuple[int, int, int, np.ndarray]:
        """The first band, row and column of a strip or tile, and its pixels as
        (band, row, column)."""
        plane, place = divmod(i, self.per_plane)
        y, x = place // self.across * self.rows, place % self.across * self.columns
        shape = (self.rows if self.tiled else min(self.rows, self.height - y), self.columns, self.samples)
        raw = self.unpack(self.read(self.sizes[i], self.offsets[i]))
        pixels = _block(raw, self.kind, shape, self.predictor)[: self.height - y, : self.width - x]
        return plane * self.samples, y, x, pixels.transpose(2, 0, 1)


def read_tiff(data: bytes) -> np.ndarray:
    """The pixels as (band, row, column)."""
    image = Tiff(_of(data))
    out = np.zeros((image.bands, image.height, image.width), image.kind.newbyteorder("="))
    for i in range(len(image.offsets)):
        band, y, x, pixels = image.block(i)
        n, rows, columns = pixels.shape
        out[band : band + n, y : y + rows, x : x + columns] = pixels
    return out


def box(data: bytes, width: int, height: int) -> tuple[float, float, float, float]:
    """``xmin, ymin, xmax, ymax`` of an image by its GeoTIFF tags: a scale and a
    tie point, or a transformation; in pixels if it has neither."""
    _, t = _tags(_of(data))
    if 34264 in t and len(t[34264]) >= 8:
        m = t[34264]
        corners = [(m[0] * i + m[1] * j + m[3], m[4] * i + m[5] * j + m[7]) for i in (0, width) for j in (0, height)]
    elif 33550 in t and 33922 in t:
        (sx, sy), (i, j, _, x, y) = t[33550][:2], t[33922][:5]
        corners = [(x - i * sx, y + j * sy), (x + (width - i) * sx, y - (height - j) * sy)]
    else:
        corners = [(0.0, 0.0), (float(width), float(height))]
    xs, ys = zip(*corners, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def write_tiff(pixels: np.ndarray, place: tuple[float, float, float, float] | None = None) -> bytes:
    """Doubles of (band, row, column) in one strip a band; ``place`` is the box
    of the image."""
    bands, height, width = pixels.shape
    raw = np.ascontiguousarray(pixels, "<f8").tobytes()
    size = width * height * 8
    offsets = [8 + i * size for i in range(bands)]
    after = 8 + len(raw)
    extra = b""

    def entry(tag: int, kind: int, values: list) -> bytes:
        nonlocal extra
        packed = struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
        if len(packed) > 4:
            at = struct.pack("<I", after + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            at = packed.ljust(4, b"\0")
        return struct.pack("<HHI", tag, kind, len(values)) + at

    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [64] * bands), (259, 3, [1]), (262, 3, [1]), (273, 4, offsets), (277, 3, [bands]), (278, 4, [height]), (279, 4, [size] * bands), (284, 3, [2]), (339, 3, [3] * bands)]
    if place is not None:
        xmin, ymin, xmax, ymax = place
        tags += [(33550, 12, [(xmax - xmin) / width, (ymax - ymin) / height, 0.0]), (33922, 12, [0.0, 0.0, 0.0, xmin, ymax, 0.0])]
    entries = b"".join(entry(*t) for t in tags)
    return b"II*\0" + struct.pack("<I", after + len(extra)) + raw + extra + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


PLACED = "struct<width:int,height:int,nBands:int,data:array<double>,xmin:double,ymin:double,xmax:double,ymax:double>"


def placed(content: Column) -> Column:
    """As ``decoded``, with the box of the image."""

    def parse(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                p = read_tiff(v)
                rows.append((p.shape[2], p.shape[1], p.shape[0], p.astype(np.float64).ravel(), *box(v, p.shape[2], p.shape[1])))
            except UNREADABLE:
                rows.append((None,) * 8)
        frame = pd.DataFrame(rows, columns=["width", "height", "nBands", "data", "xmin", "ymin", "xmax", "ymax"])
        return frame.astype({c: "Int32" for c in ("width", "height", "nBands")})

    return F.pandas_udf(parse, PLACED)(content)


UNREADABLE = (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error)


def decoded(content: Column) -> Column:
    """``struct<width, height, nBands, data>``, its fields null for what is no
    image that can be read."""

    def parse(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                p = read_tiff(v)
                rows.append((p.shape[2], p.shape[1], p.shape[0], p.astype(np.float64).ravel()))
            except UNREADABLE:
                rows.append((None, None, None, None))
        frame = pd.DataFrame(rows, columns=["width", "height", "nBands", "data"])
        return frame.astype({c: "Int32" for c in ("width", "height", "nBands")})

    return F.pandas_udf(parse, RASTER)(content)


def encoded(raster: Column, place: Column | None = None) -> Column:
    """TIFF bytes of a raster struct, with the place of its ``struct<xmin, ymin,
    xmax, ymax>`` if there is one; null for a null raster."""

    def pack(values: pd.DataFrame, places: pd.DataFrame) -> pd.Series:
        out = []
        for w, h, n, d, *box_ in zip(*(values[c] for c in ("width", "height", "nBands", "data")), *(places[c] for c in ("xmin", "ymin", "xmax", "ymax")), strict=True):
            where = None if pd.isna(box_[0]) else tuple(box_)
            out.append(None if d is None else write_tiff(np.asarray(d, np.float64).reshape(int(n), int(h), int(w)), where))
        return pd.Series(out, dtype=object)

    nowhere = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    return F.pandas_udf(pack, "binary")(raster, nowhere if place is None else place)


def raster(width: Column, height: Column, n_bands: Column, data: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), n_bands.cast("int").alias("nBands"), data.cast("array<double>").alias("data"))


def band_of(r: Column, index: int) -> Column:
    """One band of a raster struct, from 0."""
    size = r["width"] * r["height"]
    return F.slice(r["data"], size * index + 1, size)


def with_band(r: Column, values: Column, index: Column | int) -> Column:
    """The raster with one more band, put before band ``index``."""
    size, i = r["width"] * r["height"], F.lit(index) if isinstance(index, int) else index
    head, tail = F.slice(r["data"], F.lit(1), size * i), F.slice(r["data"], size * i + 1, size * (r["nBands"] - i))
    return raster(r["width"], r["height"], r["nBands"] + 1, F.concat(head, values, tail))


def array_from_binary(content: Column, bands: list[int] | None = None) -> Column:
    """The pixels of the bands asked for (all), band after band."""
    r = decoded(content)
    return r["data"] if bands is None else F.flatten(F.array(*(band_of(r, b) for b in bands)))
