"""Pre-tokens of the public tokenizers, split in Python where that provably agrees with the library.

Texts whose characters all lie in :data:`SAFE` are split by a pattern of explicit classes; any
other text is split by the library's own normalizer and pre-tokenizer, then treated alike.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
from tokenizers import Tokenizer

#: Characters whose class and lower case were compared with the library's, one by one (tests).
SAFE = [(0x0000, 0x017F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
#: White space among them.
SPACE = "\t\n\x0b\x0c\r \x85\xa0 "
UNSAFE = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SAFE) + "]")


def _chars(kind: str, *more: str) -> str:
    """Safe characters of a general category as a class body of ranges."""
    points = sorted({p for a, b in SAFE for p in range(a, b + 1) if unicodedata.category(chr(p))[0] == kind} | set(map(ord, more)))
    out, start = [], None
    for p, after in zip(points, [*points[1:], None]):
        start = p if start is None else start
        if after != p + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(p))}")
            start = None
    return "".join(out)


_L, _N, _S = _chars("L"), _chars("N"), re.escape(SPACE)
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_END = re.compile(f"{_ENDS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
BYTE_LEVEL = re.compile(f"{_ENDS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


@cache
def byte_chars() -> tuple[list[str], dict[int, int]]:
    """The printable character of each byte in a byte-level vocabulary, and the way back for ``str.translate``."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    return [chars[b] for b in range(256)], {ord(c): b for b, c in chars.items()}


def to_mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_to_char())


def from_mapped(text: str) -> bytes:
    return text.translate(byte_chars()[1]).encode("latin-1")


@cache
def _to_char() -> dict[int, str]:
    return dict(enumerate(byte_chars()[0]))


class Splitter:
    """Pre-tokens of whole texts as plain strings."""

    def __init__(self, path: str, pattern: re.Pattern, lower: bool):
        self.library = Tokenizer.from_file(path)
        self.pattern, self.lower = pattern, lower
        self.findall = pattern.findall

    def split(self, text: str) -> list[str]:
        if text.isascii() or not UNSAFE.search(text):
            return self.findall(text.lower() if self.lower else text)
        lib = self.library
        normal = lib.normalizer.normalize_str(text) if lib.normalizer else text
        return [from_mapped(piece).decode("utf-8") for piece, _ in lib.pre_tokenizer.pre_tokenize_str(normal)]


def pieces(tok: Tokenizer, items: list[str], chunk: int = 4096):
    """(ids, starts) of blank-free ``items`` in chunks; item i of a chunk has ids[starts[i]:starts[i + 1]]."""
    for k in range(0, len(items), chunk):
        part = items[k : k + chunk]
        got = tok.encode(" ".join(part), add_special_tokens=False)
        counts = np.bincount(np.asarray(got.word_ids, dtype=np.int64), minlength=len(part)) if got.ids else np.zeros(len(part), np.int64)
        yield part, got.ids, np.concatenate([[0], np.cumsum(counts)])
