"""Public vocabulary files and memos over them. The files are read where they lie, never copied.

A memo holds what a piece of text (a run between spaces) encodes to. It is a cache alone: it is emptied when
full, and whatever it lacks is computed anew.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import regex

from .common import cached

MEMO_ENTRIES = 200_000
#: Characters of a text that are told into words at once; and where only the library can tell part of them.
STRETCH, SHORT = 1 << 14, 1 << 8
#: White space as the tokenizer libraries see it (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0  -     　"
_CUT = regex.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")


def vocabulary(name: str) -> str:
    """A vocabulary file's place; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@cached
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_pieces(text: str) -> list[str]:
    """Cuts a text at single spaces between two non-spaces; the space itself is left out and belongs to the piece after it.

    The split pattern of byte-level vocabularies always starts a match at such a space, so that the pieces, each
    with its space again, can be encoded one by one.
    """
    pieces = text.split(" ")
    if len(text.split()) == len(pieces) + text.count("\n"):  # no two white spaces in a row, none at an end, no other kind
        return pieces
    return _CUT.split(text)


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """A text cut at spaces into stretches of `most` characters and up to the next space; the spaces of the cuts are left out."""
    at = 0
    while len(text) - at > most and (cut := text.find(" ", at + most)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


class Memo(dict):
    """What pieces encode to; computes what it lacks, and is emptied between texts when full."""

    def __init__(self, encode, prefix: str = "", most: int = MEMO_ENTRIES):
        super().__init__()
        self.encode, self.prefix, self.most = encode, prefix, most

    def __missing__(self, piece: str):
        value = self[piece] = self.encode(self.prefix + piece if self.prefix else piece)
        return value

    def values_of(self, pieces: list[str]) -> list:
        if len(self) > self.most:
            self.clear()
        return [*map(self.__getitem__, pieces)]


#: How the library shows bytes as characters; those that print stand for themselves.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: The splits of the two library files.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[\x00-\u024f]*")


def split_regex(text: str) -> regex.Pattern:
    """The split with the libraries' idea of white space, which Python's differs from in a few control characters."""
    return regex.compile(text.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", rf"[{WHITE}]").replace(r"\S", rf"[^{WHITE}]"))


@lru_cache(1)
def plain_words() -> re.Pattern:
    """WORD_SPLIT for lower-cased texts of _PLAIN, whose letters and numbers are listed: it gives the same words sooner."""
    held = sorted({c for i in range(0x250) for c in chr(i).lower()})
    letters, numbers = ("".join(re.escape(c) for c in held if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(WORD_SPLIT.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", WHITE))


#: Options of a file's model that change what its merges give.
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class Merges:
    """The merges of a library file as ranks over bytes, run by tiktoken's merge loop.

    A word-end suffix becomes the byte 255, which UTF-8 never has: joining a byte with it comes before all merges.
    Raises ValueError for a file whose merges can't be told so: a model with other options, a byte or a merge
    without an id, a merge of parts that no earlier rank makes, or one that stands twice.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        odd = {k: model.get(k) for k, v in _PLAIN_MODEL.items() if (model.get(k) or None) != (v or None)}
        if odd:
            raise ValueError(f"{path}: a model with {odd}")
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        byte_of = {c: b for b, c in _AS_CHAR.items()}
        raw = lambda t: bytes(byte_of[c] for c in t.removesuffix(suffix)) + b"\xff" if suffix and t.endswith(suffix) else bytes(byte_of[c] for c in t)
        tokens = [bytes([b]) for b in range(256)] + ([bytes([b, 255]) for b in range(256)] if suffix else [])
        own = {raw(t): i for t, i in ids.items() if all(c in byte_of for c in t.removesuffix(suffix))}
        known = set(tokens)
        for m in model["merges"]:
            parts = [raw(x) for x in (m if isinstance(m, list) else m.split(" "))]
            joined = b"".join(parts)
            if joined in known or not known.issuperset(parts):
                raise ValueError(f"{path}: the merge {m} can't be told by ranks")
            known.add(joined)
            tokens.append(joined)
        self.end = b"\xff" if suffix else b""
        if lost := [t for t in tokens if t not in own]:
            raise ValueError(f"{path}: no id for {lost[:3]}")
        self.ids = np.array([own[t] for t in tokens], "<u4")
        self.text = tiktoken.Encoding(os.path.basename(path), pat_str=pattern(), mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
        self.piece = self.text._core_bpe.encode_single_piece

    @cached_property
    def packed(self) -> list[bytes]:
        """Each rank's id as four bytes."""
        data = self.ids.tobytes()
        return [data[i : i + 4] for i in range(0, len(data), 4)]

    def of_word(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.piece(word.encode() + self.end)])

    def count(self, word: str) -> int:
        return len(self.piece(word.encode() + self.end))

    def of_text(self, text: str) -> bytes:
        """A whole text of a file that has the byte-level split and no normaliser."""
        return self.ids[self.text.encode_to_numpy(text, disallowed_special=())].tobytes()


class LibraryWords:
    """Pieces, or stretches of them, to pre-tokens. What needs more (special strings, scripts whose normalisation or case has rules) goes to the library as it is."""

    def __init__(self, path: str):
        self.lib, self.merges = library(path), Merges(path)
        self.lower = self.lib.normalizer is not None
        self.split = plain_words().findall if self.lower else split_regex(pattern()).findall  # for what pre_tokens lets through
        self.special = sorted(str(t.content) for t in self.lib.get_added_tokens_decoder().values())

    def pre_tokens(self, piece: str) -> list[str] | None:
        """None: only the library can tell."""
        if not (piece.isascii() or _PLAIN.fullmatch(piece)) or "<" in piece and any(s in piece for s in self.special):
            return None
        return self.split(piece.lower() if self.lower else piece)

    def whole_piece(self, piece: str) -> list[int]:
        return self.lib.encode(piece, add_special_tokens=False).ids


class LibraryIds:
    """Whole texts to packed ids (little-endian unsigned 32-bit) as the tokenizers library gives them, without special tokens added.

    A file with a normaliser that drops white space is encoded stretch by stretch: lower-cased and split at once, each
    word from a memo, so that merges run once for a word however it is written and whatever it touches. A stretch of
    which only the library can tell is cut shorter, and then encoded run by run between spaces, from a second memo. A
    file whose merges can't be told by ranks is left to the library.
    """

    def __init__(self, path: str):
        try:
            self.by = LibraryWords(path)
        except ValueError:
            self.by, self.lib = None, library(path)
            return
        if not all("<" in s for s in self.by.special):
            raise ValueError("special strings without < are not known here")
        self.words = Memo(self.by.merges.of_word)
        self.pieces = Memo(self._piece, most=MEMO_ENTRIES // 2)

    def _piece(self, piece: str) -> bytes:
        split = self.by.pre_tokens(piece)
        if split is None:
            return np.array(self.by.whole_piece(piece), "<u4").tobytes()
        return b"".join(self.words.values_of(split))

    def _stretch(self, text: str, short: bool = False) -> bytes:
        split = self.by.pre_tokens(text)
        if split is not None:
            return b"".join(self.words.values_of(split))
        if not short:
            return b"".join([self._stretch(s, True) for s in stretches(text, SHORT)])
        return b"".join(self.pieces.values_of(text.split(" ")))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by is None:
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.by.lower:
            return b"".join([self._stretch(s) for s in stretches(text)])
        if any(s in text for s in self.by.special):
            return np.array(self.by.whole_piece(text), "<u4").tobytes()
        return self.by.merges.of_text(text)


@cached
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)
