"""Sample codecs of strips and tiles: plain 8, 16 and n-bit samples, and lossless JPEG. Each runs on the bytes of one strip or tile."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

#: Compressions by their number; only those with a codec can be read.
UNCOMPRESSED, LOSSLESS_JPEG = 1, 7
#: Lines, or samples in a line, that a frame's fields of 16 bits can name.
MOST_LINES = 65535
#: Samples that the writer codes at once.
SLICE_SAMPLES = 1 << 20
_SOI, _SOF3, _DHT, _SOS, _EOI = 0xD8, 0xC3, 0xC4, 0xDA, 0xD9


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    """`count` unsigned samples of so many bits, the most significant first."""
    if len(data) * 8 < bits * count:
        raise ValueError(f"{len(data)} bytes for {count} samples of {bits} bits")
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count).reshape(count, bits)
    return raw.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def plain(data: bytes, rows: int, width: int, bits: int, little: bool) -> np.ndarray:
    """rows x width samples; rows of odd sizes of samples begin at a byte."""
    if bits in (8, 16):
        kind = np.uint8 if bits == 8 else "<u2" if little else ">u2"
        found = np.frombuffer(data, kind, min(rows * width, len(data) * 8 // bits))
        if len(found) < rows * width:
            raise ValueError(f"{len(found)} of {rows * width} samples")
        return found.reshape(rows, width).astype(np.int32)
    size = -(-width * bits // 8)
    if len(data) < rows * size:
        raise ValueError(f"{len(data)} bytes for {rows} rows of {size}")
    return np.stack([unpack_bits(data[k * size : (k + 1) * size], bits, width) for k in range(rows)]).astype(np.int32)


class Huffman:
    """Canonical codes from the numbers of codes of each length (1 to 16) and the symbols in order."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.table = np.zeros(1 << 16, np.int32)  # length << 8 | symbol; 0: no code
        self.code, at, code = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                if code >> length:
                    raise ValueError("more codes than fit")
                self.table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
                self.code[symbol] = (code, length)
                code += 1
            at += n
            code <<= 1


def _differences(data: bytes, tables: list[Huffman], n: int) -> np.ndarray:
    """n signed differences, the tables taking turns. A category of 16 has no bits of its own."""
    plain_bytes = data.replace(b"\xff\x00", b"\xff") + bytes(8)
    out, at, end = np.empty(n, np.int64), 0, 8 * (len(plain_bytes) - 8)
    lookups = [t.table for t in tables]
    words = np.ndarray((len(plain_bytes) - 7,), ">u8", plain_bytes, strides=(1,))
    for k in range(n):
        word = int(words[at >> 3]) << (at & 7) & 0xFFFFFFFFFFFFFFFF
        entry = int(lookups[k % len(lookups)][word >> 48])
        if not entry or at >= end:
            raise ValueError(f"the stream ends after {k} of {n} samples")
        length, category = entry >> 8, entry & 255
        if category == 16:
            out[k] = 32768
            at += length
            continue
        value = (word >> 64 - length - category) & (1 << category) - 1
        out[k] = value if not category or value >> category - 1 else value - (1 << category) + 1
        at += length + category
    return out


def lossless_jpeg(data: bytes) -> np.ndarray:
    """lines x (samples * components): each sample is predicted from the one before it, a line's first from the line above."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG stream")
    at, frame, tables = 2, None, {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == _SOF3:
            precision, lines, samples, parts = struct.unpack_from(">BHHB", body)
            frame = precision, lines, samples, [body[6 + 3 * k] for k in range(parts)]
        elif marker == _DHT:
            place = 0
            while place < len(body):
                counts = list(body[place + 1 : place + 17])
                tables[body[place]] = Huffman(counts, list(body[place + 17 : place + 17 + sum(counts)]))
                place += 17 + sum(counts)
        elif marker == _SOS:
            if frame is None:
                raise ValueError("a scan without a lossless frame")
            precision, lines, samples, ids = frame
            of = {body[1 + 2 * k]: body[2 + 2 * k] >> 4 for k in range(body[0])}
            predictor = body[1 + 2 * body[0]]
            if predictor != 1:
                raise ValueError(f"predictor {predictor}")
            stop = at
            while (stop := data.find(b"\xff", stop)) >= 0 and stop + 1 < len(data) and data[stop + 1] == 0:
                stop += 2
            d = _differences(data[at : stop if stop >= 0 else len(data)], [tables[of[i]] for i in ids], lines * samples * len(ids)).reshape(lines, samples, len(ids))
            d[:, 0] = np.cumsum(d[:, 0], axis=0) + (1 << precision - 1)
            return (np.cumsum(d, axis=1) & 0xFFFF).reshape(lines, -1).astype(np.int32)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError(f"frame type {marker:#x} is not lossless")
    raise ValueError("no scan")


def _coded(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and their bits of differences -32767 to 32768: the category in 5 bits, then as many bits of the value; none for a category of 16."""
    category = np.frexp(np.abs(d))[1].astype(np.int64)  # bits of the number
    own = np.where(category < 16, category, 0)
    value = np.where(d < 0, d + (1 << category) - 1, d) * (category < 16)
    return category << own | value, own + 5


def _stream(d: np.ndarray) -> bytes:
    """The codes of all differences one after the other, the most significant bit first; the last byte is filled with ones."""
    parts = [d[k : k + SLICE_SAMPLES] for k in range(0, len(d), SLICE_SAMPLES)]
    total = sum(int(_coded(part)[1].sum()) for part in parts)
    out, at = np.zeros(total // 32 + 2, np.uint32), 0
    for part in parts:
        words, sizes = _coded(part)
        starts = at + np.cumsum(sizes) - sizes
        # Each word lies in one or two units of 32 bits, as the halves of a number of 64.
        place = words.astype(np.uint64) << (64 - (starts & 31) - sizes).astype(np.uint64)
        unit = starts >> 5
        first = np.flatnonzero(np.diff(unit, prepend=-1))
        held = np.bitwise_or.reduceat(place, first)
        out[unit[first]] |= (held >> np.uint64(32)).astype(np.uint32)
        out[unit[first] + 1] |= (held & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = int(starts[-1] + sizes[-1])
    data = bytearray(out.astype(">u4").tobytes()[: -(-total // 8)])
    if total % 8:
        data[-1] |= (1 << 8 - total % 8) - 1
    return bytes(data)


def frame(lines: int, width: int, components: int = 1) -> tuple[int, int]:
    """Lines and samples of a frame for lines x width samples, each at most MOST_LINES: what is too large for its fields is folded, as readers go by the number of samples; a last line may be filled up."""
    if lines <= MOST_LINES and width % components == 0 and width // components <= MOST_LINES:
        return lines, width // components
    samples = -(-lines * width // components)
    wide = min(samples, max(1, min(width // components, MOST_LINES)))
    wide = max(wide, -(-samples // MOST_LINES))
    if wide > MOST_LINES:
        raise ValueError(f"{lines} x {width} samples are more than a frame holds")
    return -(-samples // wide), wide


def to_lossless_jpeg(samples: np.ndarray, components: int = 1, precision: int = 16) -> bytes:
    """The stream that lossless_jpeg reads, with one code of 5 bits for each category. The frame's shape is that of frame()."""
    lines, wide = frame(*samples.shape, components)
    flat = samples.reshape(-1).astype(np.int32)
    missing = lines * wide * components - len(flat)
    s = np.concatenate([flat, np.full(missing, flat[-1])]) if missing else flat
    s = s.reshape(lines, wide, components)
    d = s.copy()
    d[:, 1:] -= s[:, :-1]
    d[1:, 0] -= s[:-1, 0]
    d[0, 0] -= 1 << precision - 1
    d = (((d + 32767) & 0xFFFF) - 32767).reshape(-1)  # -32767 to 32768
    stream = _stream(d).replace(b"\xff", b"\xff\x00")
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    head = struct.pack(">BHHB", precision, lines, wide, components) + b"".join(bytes([k, 0x11, 0]) for k in range(components))
    table = b"\0" + bytes([0, 0, 0, 0, 17, *[0] * 11]) + bytes(range(17))
    scan = bytes([components]) + b"".join(bytes([k, 0]) for k in range(components)) + b"\1\0\0"
    return b"\xff\xd8" + part(_SOF3, head) + part(_DHT, table) + part(_SOS, scan) + stream + b"\xff\xd9"


#: Codecs by the number of the compression: bytes, rows, samples in a row, bits, byte order to an array. More can be added.
CODECS: dict[int, Callable[[bytes, int, int, int, bool], np.ndarray]] = {
    UNCOMPRESSED: plain,
    LOSSLESS_JPEG: lambda data, rows, width, bits, little: _fitted(lossless_jpeg(data), rows, width),
}


def _fitted(found: np.ndarray, rows: int, width: int) -> np.ndarray:
    if found.size < rows * width:
        raise ValueError(f"{found.size} of {rows * width} samples")
    return found.reshape(-1)[: rows * width].reshape(rows, width) if found.shape[1] != width else found[:rows]


def codec(compression: int) -> Callable[[bytes, int, int, int, bool], np.ndarray]:
    if compression not in CODECS:
        raise ValueError(f"compression {compression} can't be read")
    return CODECS[compression]
