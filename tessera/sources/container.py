"""Tagged containers (TIFF and its raw-photo kin): header, directories, typed values, strips and tiles; and their writer.

A file is one binary value; all functions run on its bytes, one file a row. Where strips and tiles are concerned the
public TIFF 6 rules hold: a short last strip, tiles padded to the right and below, rows of n-bit samples from a byte on.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import codec
from .tags import NUMBER

#: Struct letter and bytes of the field types 1 to 12. Fractions are two numbers.
FIELDS = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
TAG_SCHEMA = "path string, ifd_no int, ifd_type string, tag_id int, field_type int, cnt bigint, ints array<bigint>, doubles array<double>, nums array<bigint>, dens array<bigint>, text string, raw binary"
_MOSAIC, _RGB = 32803, 2


def header(data: bytes) -> tuple[str, int]:
    """Byte order ('<' or '>') and where the first directory is."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("no tagged container")
    return order, struct.unpack_from(f"{order}I", data, 4)[0]


def entries(data: bytes, order: str, offset: int) -> tuple[dict[int, tuple[int, int, bytes]], int]:
    """Field type, count and bytes of each tag of a directory, and where the next one is (0: nowhere). Fields of unknown types are left out."""
    if offset + 2 > len(data):
        raise ValueError("a directory past the end")
    n = struct.unpack_from(f"{order}H", data, offset)[0]
    if offset + 6 + 12 * n > len(data):
        raise ValueError("a directory past the end")
    out = {}
    for k in range(n):
        at = offset + 2 + 12 * k
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at)
        if kind not in FIELDS:
            continue
        size = FIELDS[kind][1] * count
        place = at + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, at + 8)[0]
        if place + size > len(data):
            raise ValueError(f"the values of tag {tag} are past the end")
        out[tag] = (kind, count, data[place : place + size])
    return out, struct.unpack_from(f"{order}I", data, offset + 2 + 12 * n)[0]


def values(order: str, kind: int, count: int, raw: bytes) -> list:
    """Numbers of an entry; fractions are pairs."""
    letter = FIELDS[kind][0]
    found = struct.unpack(f"{order}{count * len(letter)}{letter[0]}", raw)
    return list(zip(found[::2], found[1::2])) if len(letter) == 2 else list(found)


def directories(data: bytes) -> list[tuple[str, dict[int, tuple[int, int, bytes]]]]:
    """The chain of directories (BASELINE), then of each its EXIF and SUB directories."""
    order, at = header(data)
    chain, inner, seen = [], [], set()
    while at:
        if at in seen:
            raise ValueError("directories in a circle")
        seen.add(at)
        found, at = entries(data, order, at)
        chain.append(("BASELINE", found))
    for _, found in chain:
        for tag, kind in ((NUMBER["ExifIFD"], "EXIF"), (NUMBER["SubIFDs"], "SUB")):
            if tag in found:
                inner += [(kind, entries(data, order, place)[0]) for place in values(order, *found[tag])]
    return chain + inner


def tag_rows(path: str, data: bytes) -> list[dict]:
    order, _ = header(data)
    rows = []
    for no, (kind, found) in enumerate(directories(data)):
        for tag, (field, count, raw) in found.items():
            v = values(order, field, count, raw)
            row = {"path": path, "ifd_no": no, "ifd_type": kind, "tag_id": tag, "field_type": field, "cnt": count, "ints": [], "doubles": [], "nums": [], "dens": [], "text": None, "raw": raw if field in (1, 7) else None}
            if field in (5, 10):
                row["nums"], row["dens"] = [a for a, _ in v], [b for _, b in v]
            elif field in (11, 12):
                row["doubles"] = v
            elif field == 2:
                row["text"] = raw.decode("latin-1").strip("".join(map(chr, range(33))))
            else:
                row["ints"] = v
            rows.append(row)
    return rows


def _numbers(order: str, found: dict, name: str, default=None) -> list[int]:
    if NUMBER[name] not in found:
        if default is None:
            raise ValueError(f"no {name}")
        return [default]
    return values(order, *found[NUMBER[name]])


def raster(data: bytes, found: dict, photometrics: tuple[int, ...] = (_MOSAIC, _RGB)) -> np.ndarray:
    """height x width x samples of a directory's image."""
    order, _ = header(data)
    get = lambda name, default=None: _numbers(order, found, name, default)
    if get("PlanarConfiguration", 1)[0] != 1:
        raise ValueError("planes apart can't be read")
    if get("PhotometricInterpretation")[0] not in photometrics:
        raise ValueError(f"photometric interpretation {get('PhotometricInterpretation')[0]}")
    width, height, parts, bits = get("ImageWidth")[0], get("ImageLength")[0], get("SamplesPerPixel", 1)[0], get("BitsPerSample", 1)[0]
    decode, little = codec(get("Compression", 1)[0]), order == "<"
    out = np.zeros((height, width, parts), np.int32)
    if NUMBER["StripOffsets"] in found:
        rows = min(height, get("RowsPerStrip", height)[0]) or height
        for k, (at, size) in enumerate(zip(get("StripOffsets"), get("StripByteCounts"))):
            n = min(rows, height - k * rows)
            if n > 0:
                out[k * rows : k * rows + n] = decode(data[at : at + size], n, width * parts, bits, little).reshape(n, width, parts)
        return out
    tw, th = get("TileWidth")[0], get("TileLength")[0]
    across = -(-width // tw)
    for k, (at, size) in enumerate(zip(get("TileOffsets"), get("TileByteCounts"))):
        y, x = k // across * th, k % across * tw
        tile = decode(data[at : at + size], th, tw * parts, bits, little).reshape(th, tw, parts)
        out[y : y + th, x : x + tw] = tile[: height - y, : width - x]
    return out


def raw_image(data: bytes) -> tuple[np.ndarray, dict, str]:
    """The full-size image, its directory and the byte order."""
    order, _ = header(data)
    for _, found in directories(data):
        if NUMBER["NewSubfileType"] in found and values(order, *found[NUMBER["NewSubfileType"]])[0] == 0:
            return raster(data, found), found, order
    raise ValueError("no full-size image")


def build(order: str, ifds: list[dict]) -> bytes:
    """A file of directories {tag: (field type, values)}. A tag of type 0 holds data blocks: its values become their offsets. 'sub' and 'exif' are lists of inner directories."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))

    def place(raw: bytes) -> int:
        if len(out) % 2:
            out.append(0)
        at = len(out)
        out.extend(raw)
        return at

    def packed(kind: int, held: list) -> bytes:
        letter = FIELDS[kind][0]
        flat = [x for v in held for x in v] if len(letter) == 2 else held
        return struct.pack(f"{order}{len(flat)}{letter[0]}", *flat)

    def directory(ifd: dict) -> tuple[int, int]:
        """Where it is, and where its link to the next one is."""
        ifd = dict(ifd)
        for key, tag in (("sub", NUMBER["SubIFDs"]), ("exif", NUMBER["ExifIFD"])):
            if key in ifd:
                ifd[tag] = (4, [directory(inner)[0] for inner in ifd.pop(key)])
        rows = []
        for tag, (kind, held) in sorted(ifd.items()):
            if kind == 0:
                kind, held = 4, [place(block) for block in held]
            raw = packed(kind, list(held))
            rows.append((tag, kind, len(held), raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", place(raw))))
        body = struct.pack(f"{order}H", len(rows)) + b"".join(struct.pack(f"{order}HHI", tag, kind, n) + at for tag, kind, n, at in rows) + bytes(4)
        at = place(body)
        return at, at + len(body) - 4

    link = 4
    for ifd in ifds:
        at, following = directory(ifd)
        struct.pack_into(f"{order}I", out, link, at)
        link = following
    return bytes(out)


def image_directory(image: np.ndarray, order: str = "<", bits: int = 16, photometric: int = _MOSAIC, tile: tuple[int, int] | None = None, rows: int | None = None, encode=None, compression: int = 1, more: dict | None = None) -> dict:
    """A directory for build() with the image (height x width x samples) in strips of so many rows, or in tiles (height, width)."""
    height, width, parts = image.shape
    n = NUMBER

    def plain(block: np.ndarray) -> bytes:
        if bits in (8, 16):
            return block.astype("u1" if bits == 8 else f"{order}u2").tobytes()
        lines = block.reshape(block.shape[0], -1)
        return b"".join(np.packbits((line[:, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8)).tobytes() for line in lines)

    encode = encode or plain
    if tile:
        th, tw = tile
        filled = np.pad(image, ((0, -height % th), (0, -width % tw), (0, 0)), mode="edge")
        blocks = [encode(filled[y : y + th, x : x + tw]) for y in range(0, height, th) for x in range(0, width, tw)]
        held = {n["TileWidth"]: (3, [tw]), n["TileLength"]: (3, [th]), n["TileOffsets"]: (0, blocks), n["TileByteCounts"]: (4, [len(b) for b in blocks])}
    else:
        rows = rows or height
        blocks = [encode(image[y : y + rows]) for y in range(0, height, rows)]
        held = {n["RowsPerStrip"]: (4, [rows]), n["StripOffsets"]: (0, blocks), n["StripByteCounts"]: (4, [len(b) for b in blocks])}
    common = {n["NewSubfileType"]: (4, [0]), n["ImageWidth"]: (4, [width]), n["ImageLength"]: (4, [height]), n["BitsPerSample"]: (3, [bits] * parts), n["Compression"]: (3, [compression]), n["PhotometricInterpretation"]: (3, [photometric]), n["SamplesPerPixel"]: (3, [parts])}
    return common | held | (more or {})


def files(spark: SparkSession, folder: str, pattern: str = "*.[dD][nN][gG]", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files of a folder, by name where they are listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def listing(spark: SparkSession, folder: str, pattern: str = "*.[dD][nN][gG]") -> DataFrame:
    """path and length, sorted by name; contents aren't read."""
    return files(spark, folder, pattern).select("path", "length").orderBy("path")


def read_tags(found: DataFrame) -> DataFrame:
    """All tags of files (path, content), a row each; TAG_SCHEMA. A file that is no container raises."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(tag_rows(path, bytes(content)), columns=[c.split(" ")[0] for c in TAG_SCHEMA.split(", ")])

    return found.select("path", "content").mapInPandas(run, TAG_SCHEMA)


def read_planes(found: DataFrame) -> DataFrame:
    """path, y, x, c, s of the full-size images of files (path, content), a row for each sample, some rows of pixels at a time."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                image, _, _ = raw_image(bytes(content))
                height, width, parts = image.shape
                step = max(1, 100_000 // (width * parts))
                for top in range(0, height, step):
                    part = image[top : top + step]
                    yy, xx, cc = np.mgrid[top : top + len(part), :width, :parts]
                    yield pd.DataFrame({"path": path, "y": yy.ravel(), "x": xx.ravel(), "c": cc.ravel(), "s": part.ravel()})

    return found.select("path", "content").mapInPandas(run, "path string, y int, x int, c int, s int")


def written(plane: DataFrame, name: str, **options) -> DataFrame:
    """path, content: each image of a plane (image_id, y, x, s) as a container, one task an image. Options are those of image_directory; order, components."""
    order, components = options.pop("order", "<"), options.pop("components", 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from .codecs import LOSSLESS_JPEG, to_lossless_jpeg

        image = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, 1), np.int32)
        image[pdf["y"], pdf["x"], 0] = pdf["s"]
        packing = {"encode": lambda block: to_lossless_jpeg(block.reshape(len(block), -1), components), "compression": LOSSLESS_JPEG} if components else {}
        return pd.DataFrame({"path": [f"{name}-{pdf['image_id'].iloc[0]}.dng"], "content": [build(order, [image_directory(image, order, **packing, **options)])]})

    return plane.select("image_id", "y", "x", "s").groupBy("image_id").applyInPandas(run, "path string, content binary")


def without_repeated_headers(lines: DataFrame, first: str) -> DataFrame:
    """Rows of joined CSV logs without the header lines that came along: rows whose first column is its own name."""
    return lines.filter(F.trim(F.col(first)) != first)
