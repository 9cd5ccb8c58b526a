"""Bytes of PNG, TIFF and GeoPackage files to arrays and polygons, and back.

What isn't supported is an error, never a wrong picture.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

Ring = list[tuple[float, float]]


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8- or 16-bit PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head, palette = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or interlaced:
        raise ValueError("this PNG's depth or interlacing isn't supported")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, step)).reshape(height, width * step)
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    pixels = pixels.reshape(height, width, -1)
    return palette[pixels[:, :, 0]] if colour == 3 and palette is not None else pixels


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Bytes (height, width, step) from the differences that each line's filter left."""
    height, width, step = lines.shape
    if not np.isin(kinds, (3, 4)).any():
        out = np.zeros((height, width, step), np.uint8)
        for y, kind in enumerate(kinds):
            line = lines[y]
            out[y] = np.cumsum(line, 0, dtype=np.uint8) if kind == 1 else line + out[y - 1] if kind == 2 and y else line
        return out
    # a pixel needs those to its left and above, so all pixels of a diagonal are made at once
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width, channels) of 8 bits with one, two, three or four channels."""
    h, w, c = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, w * c)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Bytes and struct letter of each type of a TIFF tag.
TAG_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Numpy's letter by the sample format of a TIFF.
SAMPLE_KINDS = {1: "u", 2: "i", 3: "f"}


def lzw(data: bytes) -> bytes:
    """What LZW codes of a TIFF stand for: codes of 9 to 12 bits, high bits first; 256 clears, 257 ends."""
    out, table, previous = [], [], b""
    held = bits = at = 0
    size = 9
    while True:
        while bits < size and at < len(data):
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        if bits < size:
            return b"".join(out)
        code = held >> (bits - size)
        bits -= size
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, size, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("damaged LZW codes")
        out.append(entry)
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        size = min(12, max(9, (len(table) + 1).bit_length()))


def packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


@dataclass
class Page:
    """One image of a TIFF; ``read`` gives bytes from an offset on, so that a window needs its own chunks only."""

    read: Callable[[int, int], bytes]
    tags: dict[int, tuple]
    order: str

    def __post_init__(self) -> None:
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.channels = one(256, 0), one(257, 0), one(277, 1)
        self.planar, self.compression, self.predictor = one(284, 1) == 2, one(259, 1), one(317, 1)
        bits, kinds = set(self.tags.get(258, (1,))), set(self.tags.get(339, (1,)))
        if len(bits) != 1 or len(kinds) != 1 or min(bits) not in (8, 16, 32, 64) or min(kinds) not in SAMPLE_KINDS:
            raise ValueError("this TIFF's samples aren't supported")
        if self.compression not in UNPACK:
            raise ValueError("this TIFF's compression isn't supported")
        if self.predictor not in (1, 2) or one(266, 1) != 1 or one(262, 1) == 3:
            raise ValueError("this TIFF's predictor, bit order or palette isn't supported")
        if self.predictor == 2 and min(kinds) == 3:
            raise ValueError("differences of floats aren't supported")
        self.kind = np.dtype(f"{self.order}{SAMPLE_KINDS[min(kinds)]}{min(bits) // 8}")
        self.tiled = 322 in self.tags
        self.chunk_width = one(322, self.width)
        self.chunk_height = one(323, 0) if self.tiled else min(one(278, self.height), self.height)
        self.offsets, self.sizes = self.tags[324 if self.tiled else 273], self.tags[325 if self.tiled else 279]

    def chunk(self, plane: int, row: int, column: int) -> np.ndarray:
        across, down = -(-self.width // self.chunk_width), -(-self.height // self.chunk_height)
        i = (plane * down + row) * across + column
        channels = 1 if self.planar else self.channels
        height = self.chunk_height if self.tiled else min(self.chunk_height, self.height - row * self.chunk_height)
        raw = UNPACK[self.compression](self.read(self.offsets[i], self.sizes[i]))
        wanted = height * self.chunk_width * channels
        pixels = np.frombuffer(raw, self.kind, wanted).reshape(height, self.chunk_width, channels)
        if self.predictor == 2:
            native = pixels.astype(self.kind.newbyteorder("="))
            pixels = np.cumsum(native, 1, dtype=native.dtype)
        return pixels

    def window(self, top: int = 0, bottom: int | None = None, left: int = 0, right: int | None = None) -> np.ndarray:
        """(height, width, channels) of a window, held to the image; an empty one is an error."""
        top, left = max(top, 0), max(left, 0)
        bottom, right = (limit if end is None else min(end, limit) for end, limit in ((bottom, self.height), (right, self.width)))
        if top >= bottom or left >= right:
            raise ValueError("the window is empty")
        out = np.zeros((bottom - top, right - left, self.channels), self.kind.newbyteorder("="))
        ch, cw = self.chunk_height, self.chunk_width
        for plane in range(self.channels if self.planar else 1):
            to = slice(plane, plane + 1) if self.planar else slice(None)
            for row in range(top // ch, -(-bottom // ch)):
                for column in range(left // cw, -(-right // cw)):
                    y0, y1, x0, x1 = max(top, row * ch), min(bottom, (row + 1) * ch), max(left, column * cw), min(right, (column + 1) * cw)
                    part = self.chunk(plane, row, column)[y0 - row * ch : y1 - row * ch, x0 - column * cw : x1 - column * cw]
                    out[y0 - top : y1 - top, x0 - left : x1 - left, to] = part
        return out


def tiff_pages(read: Callable[[int, int], bytes]) -> list[Page]:
    """The images of a TIFF or BigTIFF."""
    head = read(0, 16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF")
    order = "<" if head[:2] == b"II" else ">"
    (magic,) = struct.unpack(order + "H", head[2:4])
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    word, size, count_kind, entry = ("Q", 8, "Q", 20) if big else ("I", 4, "H", 12)
    at, pages = struct.unpack_from(order + word, head, 8 if big else 4)[0], []
    while at:
        count_size = struct.calcsize(order + count_kind)
        (n,) = struct.unpack(order + count_kind, read(at, count_size))
        table = read(at + count_size, n * entry + size)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HH{word}", table, i * entry)
            if kind not in TAG_TYPES:
                continue
            letter = TAG_TYPES[kind]
            length = count * struct.calcsize(order + letter)
            place = i * entry + entry - size
            raw = table[place : place + length] if length <= size else read(struct.unpack_from(order + word, table, place)[0], length)
            tags[tag] = struct.unpack(f"{order}{count}{letter}", raw)
        pages.append(Page(read, tags, order))
        (at,) = struct.unpack_from(order + word, table, n * entry)
    return pages


def decode_tiff(data: bytes) -> np.ndarray:
    """(pages, height, width, channels); pages of different shapes are an error."""
    return np.stack([p.window() for p in tiff_pages(lambda at, n: data[at : at + n])])


def encode_tiff(pixels: np.ndarray, tile: int | None = None, strip: int | None = None, compression: int = 8, predictor: int = 1, planar: bool = False, big: bool = False) -> bytes:
    """A TIFF of (height, width, channels), or of pages of these, of any whole or float numbers: in tiles, or in strips of some rows."""
    pages = pixels if pixels.ndim == 4 else pixels[None]
    kind = pages.dtype.newbyteorder("<")
    word, size = ("Q", 8) if big else ("I", 4)
    out = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) if big else b"II" + struct.pack("<HI", 42, 8))
    link = 8 if big else 4
    for page in pages:
        h, w, c = page.shape
        ch, cw = (tile, tile) if tile else (strip or h, w)
        if tile and tile % 16:
            raise ValueError("a tile's side is a multiple of 16")
        offsets, sizes = [], []
        for plane in [page[:, :, i : i + 1] for i in range(c)] if planar else [page]:
            for y in range(0, h, ch):
                for x in range(0, w, cw):
                    part = plane[y : y + ch, x : x + cw]
                    if tile:
                        part = np.pad(part, ((0, ch - part.shape[0]), (0, cw - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                    raw = np.ascontiguousarray(part, kind).tobytes()
                    raw = zlib.compress(raw) if compression == 8 else raw
                    offsets.append(len(out))
                    sizes.append(len(raw))
                    out += raw
        long = 16 if big else 4
        chunks = [(322, long, [cw]), (323, long, [ch]), (324, long, offsets), (325, long, sizes)] if tile else [(273, long, offsets), (278, long, [ch]), (279, long, sizes)]
        tags = [(256, long, [w]), (257, long, [h]), (258, 3, [8 * kind.itemsize] * c), (259, 3, [compression]), (262, 3, [2 if c == 3 and kind.kind == "u" else 1]), (277, 3, [c]), (284, 3, [2 if planar else 1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * c), *chunks]
        entries = []
        for tag, type_, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{TAG_TYPES[type_]}", *values)
            if len(raw) > size:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<" + word, at)
            entries.append(struct.pack(f"<HH{word}", tag, type_, len(values)) + raw.ljust(size, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<" + word, out, link, len(out))
        out += struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack("<" + word, 0)
    return bytes(out)


def geometry(blob: bytes) -> list[list[list[dict]]]:
    """Polygons (rings of points) of a GeoPackage geometry; collections are flattened, other kinds left out."""
    flags = blob[3]
    start = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(flags >> 1) & 7]

    def read(at: int) -> tuple[list, int]:
        order = "<" if blob[at] else ">"
        kind = struct.unpack_from(order + "I", blob, at + 1)[0]
        at += 5
        kind, wide = kind % 1000, 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
        if kind == 1:
            return [], at + 8 * wide
        n = struct.unpack_from(order + "I", blob, at)[0]
        at += 4
        if kind == 2:
            return [], at + 8 * wide * n
        if kind == 3:
            rings = []
            for _ in range(n):
                m = struct.unpack_from(order + "I", blob, at)[0]
                at += 4
                values = struct.unpack_from(f"{order}{m * wide}d", blob, at)
                at += 8 * m * wide
                rings.append([{"x": values[i], "y": values[i + 1]} for i in range(0, len(values), wide)])
            return [rings] if rings else [], at
        if kind in (4, 5, 6, 7):
            found = []
            for _ in range(n):
                part, at = read(at)
                found += part
            return found, at
        raise ValueError("this kind of geometry isn't read")

    return [] if flags & 16 else read(start)[0]


def wkb(polygons: list[list[Ring]], collection: bool = False) -> bytes:
    """One polygon, or several as a multipolygon or a collection."""
    one = lambda rings: b"\x01" + struct.pack("<II", 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
    if len(polygons) == 1 and not collection:
        return one(polygons[0])
    return b"\x01" + struct.pack("<II", 7 if collection else 6, len(polygons)) + b"".join(map(one, polygons))


def encode_geopackage(layer: str, rows: Iterable[tuple[int, list[list[Ring]] | None]], collection: bool = False) -> bytes:
    """A GeoPackage of one layer (fid, geom) of polygons; a row's geometry may be null or empty, and the layer may have no rows."""
    with sqlite3.connect(":memory:") as c:
        c.execute("PRAGMA application_id = 1196444487")
        c.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT)")
        c.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined')")
        c.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
        c.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, -1)", (layer, layer))
        c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', -1, 0, 0)", (layer,))
        c.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB)')
        head = lambda empty: b"GP\x00" + bytes([1 | 16 * empty]) + struct.pack("<i", -1)
        c.executemany(f'INSERT INTO "{layer}" VALUES (?, ?)', [(fid, None if p is None else head(not p) + wkb(p, collection)) for fid, p in rows])  # noqa: S608
        c.commit()
        return c.serialize()


def decode_geopackage(data: bytes, layer: str, geom: str = "geom") -> list[tuple[int, bytes | None]]:
    """(fid, geometry) of a layer's rows, from the file's bytes alone."""
    with sqlite3.connect(":memory:") as c:
        c.deserialize(data)
        return c.execute(f'SELECT rowid, "{geom}" FROM "{layer}" ORDER BY rowid').fetchall()  # noqa: S608
