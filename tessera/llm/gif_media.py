"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

Null content gives no frames. Bytes that are not a GIF, code streams that no encoder makes, and images of over MOST_PIXELS
pixels raise ValueError in `decode` and come out of `frames_of` as one row with an error and null columns. A stream that
is cut off gives its frames up to there: an image says how many of its samples are missing (they are 0), and its row in
`frames_of` has both the picture and the error. For `store_texts`, null texts are empty; equal texts give equal rows. An
empty table gives an empty result; names of other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: Samples in a row of a stored payload, and rows in a frame at most.
ROW = 576
FRAME_ROWS = 448
#: Pixels of a canvas or an image at most: a picture of 4 bytes each is held.
MOST_PIXELS = 1 << 26
GREY = bytes(x for i in range(256) for x in (i, i, i))
KEEP, TO_BACKGROUND, TO_PREVIOUS = 1, 2, 3
#: Codes that fit between two clear codes, for 8-bit samples.
_FULL = 4096 - 258


def _widths(least: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code, and where each starts, one more at the end."""
    first = (1 << least) + 1
    k = np.arange(n)
    bits = np.minimum(12, np.maximum(least + 1, np.floor(np.log2(first + k)).astype(np.int64) + 1))
    return np.concatenate([[0], np.cumsum(bits)])


_STARTS = {least: _widths(least, 1 << 14) for least in range(2, 9)}


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    clear, starts = 1 << least, _STARTS[least]
    codes: list[int] = []
    marks: list[int] = []  # how many codes stand before each clear code
    # Codes are kept times 256, so that a code and the next sample make a key by one `or`.
    emit, seen = codes.append, {}
    get, free, full = seen.get, clear + 2 << 8, 4096 << 8
    rest = iter(samples)
    prefix = next(rest, -1) << 8
    for c in rest:
        code = get(prefix | c)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        seen[prefix | c] = free
        prefix = c << 8
        free += 256
        if free == full:
            marks.append(len(codes))
            seen.clear()
            free = clear + 2 << 8
    if prefix >= 0:
        emit(prefix)
    # Lay out: a clear code, then the codes up to each mark with a clear code after them, at last the end code.
    at, previous, values = least + 1, 0, np.array(codes, np.int64) >> 8
    place, value = [np.array([0])], [np.array([clear])]
    for mark in [*marks, len(codes)]:
        n = mark - previous
        place.append(at + starts[: n + 1])
        value.append(np.append(values[previous:mark], clear))
        at += int(starts[n + 1])
        previous = mark
    value[-1][-1] = clear + 1
    position, value = np.concatenate(place), np.concatenate(value).astype(np.uint64)
    word, shift = position >> 6, (position & 63).astype(np.uint64)
    out = np.zeros((at >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    cross = np.flatnonzero(shift > 52)
    out[word[cross] + 1] |= value[cross] >> (np.uint64(64) - shift[cross])
    return out.astype("<u8").tobytes()[: (at + 7) // 8]


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """Samples of a code stream, `most` of them at most. Clear codes may come early, or late with the table full."""
    if least not in _STARTS:
        raise ValueError(f"a least code size of {least}")
    clear, starts = 1 << least, _STARTS[least]
    buffer = data + bytes(8)
    at = np.ndarray((len(buffer) - 3,), "<u4", buffer, strides=(1,))
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    emit, size, position, end = out.append, 0, 0, 8 * len(data)
    bits = np.diff(starts)
    while position + least < end and size < most:
        n, chunk = min(len(bits), _FULL + 2 if least == 8 else len(bits)), 0
        entries = roots.copy()
        add, previous, done = entries.append, b"", False
        while not done:  # more than one round only where a clear code is late
            place = position + starts[chunk : chunk + n] - starts[chunk] if chunk + n <= len(bits) else position + 12 * np.arange(n)
            width = bits[chunk : chunk + n] if chunk + n <= len(bits) else np.full(n, 12)
            fits = int(np.searchsorted(place + width, end, side="right"))
            place, width = place[:fits], width[:fits]
            codes = (at[place >> 3] >> (place & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            used = int(stop[0]) if len(stop) else fits
            run = codes[:used].tolist()
            if not chunk and run:
                if run[0] >= clear:
                    raise ValueError("a code points past the table")
                previous = entries[run[0]]
                emit(previous)
                run = run[1:]
            known = len(entries)
            for code in run:
                if code < known:
                    entry = entries[code]
                elif code == known:
                    entry = previous + previous[:1]
                else:
                    raise ValueError("a code points past the table")
                emit(entry)
                if known < 4096:
                    add(previous + entry[:1])
                    known += 1
                previous = entry
            if len(stop):
                if codes[used] == clear + 1:
                    return b"".join(out)[:most]
                position, done = int(place[used] + width[used]), True
            elif fits < n:
                return b"".join(out)[:most]
            else:
                position, chunk = int(place[-1] + width[-1]), chunk + n
        if len(out) > 1 << 16:
            out[:] = [b"".join(out)]
            size = len(out[0])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


@dataclass
class Frame:
    """Indices of one image as stored, with its place, times in ms, and palette."""

    indices: np.ndarray
    left: int = 0
    top: int = 0
    delay_ms: int = 0
    disposal: int = KEEP
    transparent: int | None = None
    palette: bytes | None = None
    interlaced: bool = False
    missing: int = 0


@dataclass
class Gif:
    width: int
    height: int
    palette: bytes | None
    background: int = 0
    frames: list[Frame] = field(default_factory=list)

    def rendered(self):
        """Each frame as shown: start in ms, height x width x 4 (red, green, blue, opaque)."""
        canvas, now = np.zeros((self.height, self.width, 4), np.uint8), 0
        for f in self.frames:
            before = canvas.copy() if f.disposal == TO_PREVIOUS else None
            h, w = f.indices.shape
            h, w = max(0, min(h, self.height - f.top)), max(0, min(w, self.width - f.left))
            area, index = canvas[f.top : f.top + h, f.left : f.left + w], f.indices[:h, :w]
            colours = np.frombuffer((f.palette or self.palette or GREY).ljust(768, b"\0"), np.uint8).reshape(-1, 3)
            shown = np.dstack([colours[index], np.full(index.shape, 255, np.uint8)])
            area[...] = shown if f.transparent is None else np.where((index == f.transparent)[..., None], area, shown)
            yield now, canvas.copy()
            now += f.delay_ms
            if f.disposal == TO_BACKGROUND:
                canvas[f.top : f.top + h, f.left : f.left + w] = 0
            elif before is not None:
                canvas = before


def _table(palette: bytes) -> tuple[int, bytes]:
    bits = max(1, (len(palette) // 3 - 1).bit_length())
    return bits - 1, palette.ljust(3 << bits, b"\0")


def encode(gif: Gif) -> bytes:
    flag, colours = _table(gif.palette) if gif.palette else (0, b"")
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, (0xF0 | flag) if gif.palette else 0x70, gif.background, 0), colours]
    for f in gif.frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay_ms // 10, f.transparent or 0) + b"\0")
        own, table = _table(f.palette) if f.palette else (0, b"")
        h, w = f.indices.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, (0x80 | own if f.palette else 0) | 0x40 * f.interlaced) + table)
        rows = f.indices[_interlace(h)] if f.interlaced else f.indices
        out += [b"\x08", _blocks(lzw_encode(rows.astype(np.uint8).tobytes()))]
    return b"".join([*out, b"\x3b"])


def _interlace(height: int) -> np.ndarray:
    """The order in which rows are stored."""
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> Gif:
    """The images of a GIF with their times and rules; raises ValueError for what is none."""
    try:
        return _decoded(data, most_pixels)
    except (IndexError, struct.error) as e:
        raise ValueError(f"cut off before an image: {e}") from e


def _decoded(data: bytes, most_pixels: int) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    if width * height > most_pixels:
        raise ValueError(f"a canvas of {width} x {height}")
    palette = None
    if packed & 0x80:
        palette, at = data[at : at + (6 << (packed & 7))], at + (6 << (packed & 7))
    gif = Gif(width, height, palette, background)
    control = (0, 0, None)

    def body(at: int) -> tuple[bytes, int]:
        found = []
        while at < len(data) and (n := data[at]):
            found.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(found), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            content, at = body(at + 2)
            if label == 0xF9:
                flags, delay, clear = struct.unpack_from("<BHB", content)
                control = (flags >> 2 & 7, 10 * delay, clear if flags & 1 else None)
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            if w * h > most_pixels:
                raise ValueError(f"an image of {w} x {h}")
            own = None
            if flags & 0x80:
                own, at = data[at : at + (6 << (flags & 7))], at + (6 << (flags & 7))
            least = data[at]
            content, at = body(at + 1)
            samples = lzw_decode(content, max(2, least), w * h)
            missing = w * h - len(samples)
            index = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:
                straight = np.empty_like(index)
                straight[_interlace(h)] = index
                index = straight
            gif.frames.append(Frame(index, left, top, control[1], control[0], control[2], own, bool(flags & 0x40), missing))
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")
    return gif


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of ROW bytes as frames of grey samples, 40 ms each."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return encode(Gif(ROW, min(FRAME_ROWS, len(rows)), GREY, 0, [Frame(rows[i : i + FRAME_ROWS], delay_ms=40) for i in range(0, len(rows), FRAME_ROWS)]))


def restore(media: bytes) -> tuple[bytes, Gif]:
    gif = decode(media)
    if any(f.missing for f in gif.frames):
        raise ValueError("the payload is cut off")
    return b"".join(f.indices.tobytes() for f in gif.frames), gif


def histogram(gif: Gif, bins: int = 16) -> np.ndarray:
    """Pixels by frame, channel and bin of the channel's value, palettes applied."""
    out = np.zeros((len(gif.frames), 3, bins), np.int64)
    for k, f in enumerate(gif.frames):
        by_index = np.bincount(f.indices.reshape(-1), minlength=256)
        colours = np.frombuffer((f.palette or gif.palette or GREY).ljust(768, b"\0"), np.uint8).reshape(-1, 3)
        for c in range(3):
            out[k, c] = np.bincount(colours[:, c].astype(np.int64) * bins >> 8, by_index, bins)
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\xff"), len(raw)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Each text as a GIF, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (frames; duration in ms; share of each grey bin in thousandths), frames, duration_ms and, if asked for, media."""

    def run(batch):
        for d, t in zip(batch.column(0), batch.column(1)):
            payload, n = padded(t.as_py())
            media = store(payload)
            back, gif = restore(media)
            grey = histogram(gif)[:, 0].sum(0)
            duration = sum(f.delay_ms for f in gif.frames)
            feature = f"{len(gif.frames)};{duration};" + ",".join(str(1000 * x // len(back)) for x in grey.tolist())
            row = {"doc_id": [d.as_py()], "n_bytes": [n], "payload_bytes": [len(back)], "payload_sha256": [hashlib.sha256(back).hexdigest()], "tail_crc32": [zlib.crc32(back[-32:])], "media_bytes": [len(media)], "media_sha256": [hashlib.sha256(media).hexdigest()], "feature": [feature], "frames": [len(gif.frames)], "duration_ms": [duration]}
            yield row | ({"media": [media]} if with_media else {})

    def joined(batch):  # one batch out for many rows
        out: dict[str, list] = {}
        for row in run(batch):
            for k, v in row.items():
                out.setdefault(k, []).extend(v)
            if with_media and sum(map(len, out["media"])) > 32 << 20:
                yield out
                out = {}
        if out:
            yield out

    src = texts_of(df, id_col, text_col)
    return map_batches(src, joined, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames int, duration_ms bigint" + ", media binary" * with_media)


def frames_of(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row for each frame as shown: doc_id, frame, start_ms, delay_ms, width, height, opaque (pixels), red, green, blue (16-bin histograms of opaque pixels), rgba, error."""

    def run(batch):
        for d, m in zip(batch.column(0), batch.column(1)):
            if not m.is_valid:
                continue
            row = dict.fromkeys(("frame", "start_ms", "delay_ms", "width", "height", "opaque", "red", "green", "blue", "rgba", "error"))
            try:
                gif = decode(m.as_py(), most_pixels)
            except ValueError as e:
                yield {"doc_id": [d.as_py()]} | {k: [v] for k, v in (row | {"error": str(e)}).items()}
                continue
            for k, (start, image) in enumerate(gif.rendered()):
                solid = image[image[..., 3] > 0]
                hist = [np.bincount(solid[:, c] >> 4, minlength=16).tolist() for c in range(3)]
                out = row | {"frame": k, "start_ms": start, "delay_ms": gif.frames[k].delay_ms, "width": gif.width, "height": gif.height, "opaque": len(solid), "red": hist[0], "green": hist[1], "blue": hist[2], "rgba": image.tobytes(), "error": f"{gif.frames[k].missing} samples are missing" if gif.frames[k].missing else None}
                yield {"doc_id": [d.as_py()]} | {k: [v] for k, v in out.items()}

    src = df.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{media_col}` AS binary) AS media")
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, frame int, start_ms bigint, delay_ms bigint, width int, height int, opaque bigint, red array<bigint>, green array<bigint>, blue array<bigint>, rgba binary, error string")
