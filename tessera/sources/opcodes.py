"""Lists of image operations (opcodes) that containers carry: parsed, never applied. All numbers are big-endian."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame

#: The names of the operations 1 to 13.
NAMES = "WarpRectilinear WarpFisheye FixVignetteRadial FixBadPixelsConstant FixBadPixelsList TrimBounds MapTable MapPolynomial GainMap DeltaPerRow DeltaPerColumn ScalesPerRow ScalesPerColumn".split()
_AREA = "top left bottom right plane planes row_pitch col_pitch".split()


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, letter: str, n: int = 1) -> list:
        found = struct.unpack_from(f">{n}{letter}", self.data, self.at)
        self.at += struct.calcsize(f">{n}{letter}")
        return list(found)

    def one(self, letter: str):
        return self.take(letter)[0]


def _warp(r: _Reader, coefficients: int) -> dict:
    sets = r.one("I")
    return {"coefficients": [r.take("d", coefficients) for _ in range(sets)], "center": r.take("d", 2)}


def _bad_pixels(r: _Reader) -> dict:
    phase, points, rectangles = r.take("I", 3)
    return {"phase": phase, "points": [r.take("I", 2) for _ in range(points)], "rectangles": [r.take("I", 4) for _ in range(rectangles)]}


def _area(r: _Reader) -> dict:
    return dict(zip(_AREA, r.take("I", 8)))


def _gains(r: _Reader) -> dict:
    out = _area(r)
    v, h = r.take("I", 2)
    out |= {"spacing": r.take("d", 2), "origin": r.take("d", 2)}
    planes = r.one("I")
    return out | {"gains": [[r.take("f", planes) for _ in range(h)] for _ in range(v)]}


_PARSERS = {
    1: lambda r: _warp(r, 6),
    2: lambda r: _warp(r, 4),
    3: lambda r: {"k": r.take("d", 5), "center": r.take("d", 2)},
    4: lambda r: dict(zip(("constant", "phase"), r.take("I", 2))),
    5: _bad_pixels,
    6: lambda r: dict(zip(_AREA[:4], r.take("I", 4))),
    7: lambda r: _area(r) | {"table": r.take("H", r.one("I"))},
    8: lambda r: _area(r) | {"coefficients": r.take("d", r.one("I") + 1)},
    9: _gains,
    **{k: lambda r: _area(r) | {"values": r.take("f", r.one("I"))} for k in (10, 11, 12, 13)},
}


def parse(data: bytes) -> list[dict]:
    """pos, id, name, spec_version, flags, nbytes, payload, fields of each operation of a list; an unknown one raises."""
    r, out = _Reader(data), []
    for pos in range(r.one("I")):
        number, version, flags, size = r.take("I", 4)
        if number not in _PARSERS:
            raise ValueError(f"unknown operation {number}")
        payload = data[r.at : r.at + size]
        r.at += size
        out.append({"pos": pos, "id": number, "name": NAMES[number - 1], "spec_version": version, "flags": flags, "nbytes": size, "payload": payload, "fields": _PARSERS[number](_Reader(payload))})
    return out


def parse_opcodes(lists: DataFrame) -> DataFrame:
    """A row for each operation of lists (path, list_no, data); its fields as JSON."""
    ddl = "path string, list_no int, pos int, id int, name string, spec_version bigint, flags bigint, nbytes bigint, payload binary, fields string"

    def run(frames):
        for pdf in frames:
            rows = [{"path": p, "list_no": n} | row | {"fields": json.dumps(row["fields"])} for p, n, d in zip(pdf["path"], pdf["list_no"], pdf["data"]) if d is not None for row in parse(bytes(d))]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ddl.split(", ")])

    return lists.select("path", "list_no", "data").mapInPandas(run, ddl)
