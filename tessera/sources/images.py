"""Rendered images as files: PNG, TIFF, BMP and JPEG out; PNG, TIFF and BMP in, told apart by their first bytes. JPEG comes in through Spark's own image source."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import container

_PNG = b"\x89PNG\r\n\x1a\n"
#: What a name for saving stands for: format and bits a sample.
FORMATS = {"TIFF16": ("tiff", 16), "TIFF8": ("tiff", 8), "PNG16": ("png", 16), "PNG8": ("png", 8), "JPEG": ("jpeg", 8), "BMP": ("bmp", 8)}


def sniffed(data: bytes) -> str | None:
    """png, tiff, bmp, jpeg or null."""
    for name, starts in (("png", (_PNG,)), ("tiff", (b"II*\0", b"MM\0*")), ("bmp", (b"BM",)), ("jpeg", (b"\xff\xd8\xff",))):
        if data.startswith(starts):
            return name
    return None


def to_8_bits(image: np.ndarray) -> np.ndarray:
    """0..65535 to 0..255, truncated."""
    return (image / 65535.0 * 255).astype(np.uint8)


def from_unit(image: np.ndarray, bits: int = 16) -> np.ndarray:
    """0..1 to samples of so many bits, clamped and truncated."""
    return (np.clip(image, 0, 1) * ((1 << bits) - 1)).astype(np.int32)


def write_png(image: np.ndarray, bits: int = 16) -> bytes:
    """height x width x 1 or 3."""
    height, width, parts = image.shape
    rows = image.astype(">u2" if bits == 16 else "u1").reshape(height, -1)
    raw = b"".join(b"\0" + row.tobytes() for row in rows)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, {1: 0, 3: 2}[parts], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from its differences to the left, above, their mean, or the nearest of three."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (3, 4):
        raise ValueError(f"row filter {kind}")
    out, up = bytearray(row.tobytes()), above.tobytes()
    for i in range(len(out)):
        a, b, c = (out[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if kind == 3:
            guess = a + b >> 1
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = out[i] + guess & 255
    return np.frombuffer(bytes(out), np.uint8)


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """The image (without its opacity) and its bits a sample: grey or colour, 8 or 16 bits, not interlaced."""
    at, stream, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
    if head is None or head[2] not in (8, 16) or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError(f"a PNG of kind {head}")
    width, height, bits, kind = head[:4]
    parts = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    step, raw = parts * bits // 8, np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    size = width * step
    if len(raw) < height * (size + 1):
        raise ValueError("a PNG that is cut off")
    rows = raw[: height * (size + 1)].reshape(height, size + 1)
    out, above = np.empty((height, size), np.uint8), np.zeros(size, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, step)
    image = out.view(">u2") if bits == 16 else out
    return image.reshape(height, width, parts)[:, :, : 1 if parts < 3 else 3].astype(np.int32), bits


def write_bmp(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    colours = np.repeat(image, 3, 2) if image.shape[2] == 1 else image
    rows = np.pad(colours[::-1, :, ::-1].astype(np.uint8).reshape(height, -1), ((0, 0), (0, -3 * width % 4)))
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def read_bmp(data: bytes) -> tuple[np.ndarray, int]:
    """24 or 32 bits a pixel, not compressed; rows from below or from above."""
    start = struct.unpack_from("<I", data, 10)[0]
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError(f"a BMP of {bits} bits, compression {packed}")
    size, n = -(-width * bits // 32) * 4, abs(height)
    rows = np.frombuffer(data, np.uint8, n * size, start).reshape(n, size)[:, : width * bits // 8].reshape(n, width, bits // 8)
    return (rows[::-1] if height > 0 else rows)[:, :, 2::-1].astype(np.int32), 8


def write_tiff(image: np.ndarray, bits: int = 16, order: str = "<") -> bytes:
    return container.build(order, [container.image_directory(image, order, bits, 2 if image.shape[2] == 3 else 1, rows=64)])


def read_tiff(data: bytes) -> tuple[np.ndarray, int]:
    order, _ = container.header(data)
    _, found = container.directories(data)[0]
    return container.raster(data, found, (0, 1, 2, 32803)), container.values(order, *found[container.NUMBER["BitsPerSample"]])[0]


def _zigzag() -> np.ndarray:
    """Places of an 8 x 8 block by rising diagonals that turn each time."""
    return np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))


def write_jpeg(image: np.ndarray, quality: float = 0.9) -> bytes:
    """Baseline JPEG of 8-bit colours without subsampling. Steps of the coefficients grow with their frequency and with 1 - quality; codes are of one length for all symbols."""
    height, width, parts = image.shape
    rgb = (np.repeat(image, 3, 2) if parts == 1 else image).astype(float)
    to_yuv = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    planes = np.pad(rgb @ to_yuv.T - np.array([128, 0, 0]), ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    k = np.arange(8)
    dct = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    steps = np.clip(np.rint(1 + (1 - quality) * 8 * (1 + k[:, None] + k)), 1, 255)
    blocks = planes.reshape(planes.shape[0] // 8, 8, planes.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3)
    levels = np.rint(dct @ blocks @ dct.T / steps).astype(int).reshape(-1, 3, 64)[:, :, _zigzag()]
    runs = [(r, s) for s in range(1, 11) for r in range(16)] + [(0, 0), (15, 0)]
    ac = {rs[0] << 4 | rs[1]: f"{n:08b}" for n, rs in enumerate(runs)}
    out, before = [], [0, 0, 0]

    def bits(v: int) -> tuple[int, str]:
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    for block in levels.tolist():
        for c, line in enumerate(block):
            size, tail = bits(line[0] - before[c])
            before[c] = line[0]
            out.append(f"{size:04b}" + tail)
            zeros = 0
            last = max((i for i in range(1, 64) if line[i]), default=0)
            for v in line[1 : last + 1]:
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    out.append(ac[0xF0])
                    zeros -= 16
                size, tail = bits(v)
                out.append(ac[zeros << 4 | size] + tail)
                zeros = 0
            if last < 63:
                out.append(ac[0])
    text = "".join(out)
    text += "1" * (-len(text) % 8)
    stream = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    tables = b"\0" + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12)) + b"\x10" + bytes([*[0] * 7, len(runs), *[0] * 8]) + bytes(r << 4 | s for r, s in runs)
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    quantised = b"\0" + bytes(steps.reshape(64)[_zigzag()].astype(np.uint8).tolist())
    jfif = b"JFIF\0\1\1\0\0\1\0\1\0\0"
    return b"\xff\xd8" + part(0xE0, jfif) + part(0xDB, quantised) + part(0xC0, frame) + part(0xC4, tables) + part(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + stream + b"\xff\xd9"


def encoded(image: np.ndarray, kind: str, quality: float = 0.9) -> bytes:
    """0..65535 samples in one of FORMATS."""
    name, bits = FORMATS[kind]
    shown = image if bits == 16 else to_8_bits(image)
    if name == "jpeg":
        return write_jpeg(shown, quality)
    return write_bmp(shown) if name == "bmp" else write_png(shown, bits) if name == "png" else write_tiff(shown, bits)


def decoded(data: bytes) -> tuple[np.ndarray, int]:
    """The image and its bits a sample."""
    name = sniffed(data)
    if name not in ("png", "tiff", "bmp"):
        raise ValueError(f"a file of kind {name}")
    return {"png": read_png, "tiff": read_tiff, "bmp": read_bmp}[name](data)


def as_files(pixels: DataFrame, kind: str, names: tuple[str, ...] = ("r", "g", "b"), quality: float = 0.9) -> DataFrame:
    """path, content: each image of pixels (image_id, y, x, and the named channels of 0..65535) in one of FORMATS; one task an image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, len(names)), np.int32)
        for c, n in enumerate(names):
            image[pdf["y"], pdf["x"], c] = pdf[n]
        return pd.DataFrame({"path": [f"{pdf['image_id'].iloc[0]}.{FORMATS[kind][0]}"], "content": [encoded(image, kind, quality)]})

    return pixels.select("image_id", "y", "x", *names).groupBy("image_id").applyInPandas(run, "path string, content binary")


def as_pixels(found: DataFrame) -> DataFrame:
    """path, bits, y, x, r, g, b of files (path, content); grey images have three equal channels."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                image, bits = decoded(bytes(content))
                image = np.repeat(image, 3, 2) if image.shape[2] == 1 else image
                step = max(1, 100_000 // image.shape[1])
                for top in range(0, len(image), step):
                    part = image[top : top + step]
                    yy, xx = np.mgrid[top : top + len(part), : image.shape[1]]
                    yield pd.DataFrame({"path": path, "bits": bits, "y": yy.ravel(), "x": xx.ravel()} | {n: part[:, :, c].ravel() for c, n in enumerate("rgb")})

    return found.select("path", "content").mapInPandas(run, "path string, bits int, y int, x int, r int, g int, b int")


class _Files(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        for row in iterator:
            path = os.path.join(self.folder, os.path.basename(row["path"]))
            held = f"{path}.part-{os.getpid()}"
            with open(held, "wb") as f:
                f.write(row["content"])
            os.replace(held, path)  # a task that runs again replaces the whole file
        return WriterCommitMessage()


class FileSink(DataSource):
    """Rows path, content as files of those names in a folder that all executors share: df.write.format("image_files").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        folder = self.options["path"].removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        return _Files(folder)
