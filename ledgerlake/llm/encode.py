"""Token ids of columns of whole texts with a byte-level BPE, through a bounded table of pieces already seen.

At some places a byte-level BPE pattern always starts a new match, whatever comes before or after: at a space that
another character follows, behind a letter that none follows, around other white space. There texts are cut into
segments. A column's segments are made a dictionary by Arrow; each distinct one that the table of pieces doesn't hold is
cut by the pattern and goes to the tokenizer. Ids of a text are gathered from its segments by position.

Strings of added tokens are cut out first and have their own id, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from . import textops as T

#: Pieces kept by one Python worker, about 65 MB.
KEPT = 300_000
#: Bytes of text that are encoded at once; a longer text is encoded alone.
BLOCK = 2 << 20

# Kinds of bytes: ASCII letter, space, other white space, other printable ASCII, first of a character that is no white space, any other.
_LETTER, _SPACE, _BREAK, _SIGN, _WIDE, _ANY = range(6)
_KIND = np.full(256, _ANY, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0x20] = _SPACE
_KIND[9:14] = _BREAK
_KIND[0xC3:0xF5] = _WIDE
_KIND[[0xE1, 0xE2, 0xE3]] = _ANY
# Whether a match starts at the first (1) or the second (2) of two neighbours, or at either (3): white space before a word
# leaves its last character to a match of its own.
_START = np.zeros((6, 8), np.uint8)
for _k in (_LETTER, _SIGN, _WIDE):
    _START[_SPACE, _k], _START[_BREAK, _k] = 1, 3
for _k in (_SPACE, _BREAK):
    _START[_LETTER, _k] = _START[_SIGN, _k] = 2
_START[_LETTER, _SIGN] = 2
_START = _START.reshape(-1)
#: Text on which all engines agree what the pattern's classes hold: ASCII, letters and marks that every Unicode version has.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u0513\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+").fullmatch


class Pieces:
    """encode(data, offsets) over UTF-8 rows; `piece` encodes one match of `split`, `odd` a segment of other characters."""

    def __init__(self, split: Callable[[str], list[str]], piece: Callable[[str], list[int]], odd: Callable[[str], list[int]], added: dict[str, int] | None = None, kept: int = KEPT):
        self.split, self.piece, self.odd, self.kept = split, piece, odd, kept
        self.added = added or {}
        self.find = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.added, key=len, reverse=True))).finditer if self.added else None
        self.seen: dict[str, bytes] = {}

    def _kept(self, text: str, ids: list[int]) -> bytes:
        out = array("I", ids).tobytes()
        if len(self.seen) < self.kept and len(text) <= 64:
            self.seen[text] = out
        return out

    def _segment(self, text: str) -> bytes:
        if text in self.added:
            return array("I", [self.added[text]]).tobytes()
        if not _PLAIN(text):
            return self._kept(text, self.odd(text))
        if text.isalpha() or (text[0] == " " and text[1:].isalpha()):
            return self._kept(text, self.piece(text))
        get = self.seen.get
        return b"".join([get(p) or self._kept(p, self.piece(p)) for p in self.split(text)])

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """First and end byte of each string of an added token that lies in one row."""
        whole = data.tobytes() if self.added else b""
        if not any(x.encode() in whole for x in self.added):
            return []
        spans = [m.span() for m in self.find(whole)]
        if any(np.searchsorted(offsets, a, "right") != np.searchsorted(offsets, b) for a, b in spans):  # ends in another row
            rows = [(int(a), whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            spans = [(a + m.start(), a + m.end()) for a, row in rows for m in self.find(row)]
        return spans

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and each row's offsets into them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _KIND[data]
        start = _START[(kind[:-1] << 3) | kind[1:]]
        last = offsets[1:][(offsets[1:] > 0) & (offsets[1:] < n)] - 1
        start[last] = 0  # neighbours of different rows
        mark = np.zeros(n, bool)
        for a, b in self._added(data, offsets):
            start[max(a - 1, 0) : b - 1] = 0
            mark[a : b + 1 : b - a] = True
        mark[1:] |= start > 1
        mark[:-1] |= (start & 1).view(bool)
        mark[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(mark)
        of_row = np.searchsorted(starts, offsets)
        bounds = np.append(starts, n)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.seen.get, names))
        for k, x in enumerate(known):
            if x is None:
                known[k] = self._segment(names[k])
        pool = np.frombuffer(b"".join(known), np.uint32)
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        first = np.cumsum(size) - size
        codes = found.indices.to_numpy()
        ends = np.cumsum(size[codes])
        total = int(ends[-1])
        at = np.arange(total, dtype=np.int64)
        at += np.repeat(first[codes] - ends + size[codes], size[codes])
        return pool[at], np.append(0, ends)[of_row]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of runs of rows; null is empty."""
        data, offsets = T.buffers(texts)
        for a, b, d, o in T.chunks(data, offsets, BLOCK):
            yield a, b, *self.encode(d, o)


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE files: printable bytes stand for themselves."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The tokenizers library behind a table of pieces; one for each worker and file."""
    if path in _open:
        return _open[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        setup = json.load(f)
    step = setup["pre_tokenizer"] or {}
    added = setup["added_tokens"]
    if setup["normalizer"] or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added):
        raise ValueError("expected a byte-level tokenizer without normalizer, prefix space or tokens that take their neighbours")
    t = Tokenizer.from_file(path)
    cut, tokenize, stand = t.pre_tokenizer.pre_tokenize_str, t.model.tokenize, _byte_chars()

    def piece(text: str) -> list[int]:
        return [x.id for x in tokenize((text if text.isascii() else text.encode().decode("latin1")).translate(stand))]

    def odd(text: str) -> list[int]:
        return [x.id for p, _ in cut(text) for x in tokenize(p)]

    _open[path] = Pieces(regex.compile(public_tokenizers.PATTERN).findall, piece, odd, {x["content"]: x["id"] for x in added})
    return _open[path]
