"""Operator 6, byte-level BPE by a tree of joins.

A piece is cut in halves down to short leaves; neighbours are joined by re-encoding a window around the seam that
grows until the tokens next to it are stable. A token sequence is the BPE encoding of its bytes exactly if each pair of
neighbours encodes to itself, so a window whose outer seams pass that test settles the rest. Decoding concatenates up
the same kind of tree.

A null or empty text has no ids. Texts of any length are cut into pattern matches first; a match of any length is a tree
of depth log2. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import prepare
from .encode import Pieces

LEAF = 6
#: Leaves and seams kept by one worker.
KEPT = 400_000


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes = {v: k for k, v in ranks.items()}
        self.leaves: dict[bytes, list[int]] = {}
        self.seams: dict[tuple[int, int], bool] = {}
        self.table = Pieces(self.split, self.encode_piece, self.encode_text, kept=KEPT)

    def _merge(self, b: bytes) -> list[int]:
        """Plain BPE: the pair of least rank merges first, the leftmost of equals."""
        known = self.leaves.get(b)
        if known is not None:
            return known
        get = self.ranks.get
        parts = [b[k : k + 1] for k in range(len(b))]
        pairs = [get(b[k : k + 2], 1 << 40) for k in range(len(b) - 1)]
        while pairs and (least := min(pairs)) < 1 << 40:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], 1 << 40)
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], 1 << 40)
        out = [self.ranks[p] for p in parts]
        if len(self.leaves) < KEPT and len(b) <= 32:
            self.leaves[b] = out
        return out

    def _stable(self, a: int, b: int) -> bool:
        known = self.seams.get((a, b))
        if known is None:
            known = self._merge(self.bytes[a] + self.bytes[b]) == [a, b]
            if len(self.seams) < KEPT:
                self.seams[a, b] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        i = j = 0
        mid: list[int] = []
        ok_left = ok_right = self._stable(left[-1], right[0])
        while not (ok_left and ok_right):
            if not ok_left:
                i = min(len(left), max(1, 2 * i))
            if not ok_right:
                j = min(len(right), max(1, 2 * j))
            mid = self._merge(b"".join(self.bytes[t] for t in left[len(left) - i :] + right[:j]))
            ok_left = i == len(left) or self._stable(left[-i - 1], mid[0])
            ok_right = j == len(right) or self._stable(mid[-1], right[j])
        return left[: len(left) - i] + mid + right[j:]

    def _tree(self, b: bytes) -> list[int]:
        if len(b) <= LEAF:
            return self._merge(b)
        half = len(b) // 2
        return self.join(self._tree(b[:half]), self._tree(b[half:]))

    def encode_piece(self, piece: str) -> list[int]:
        b = piece.encode()
        whole = self.ranks.get(b)
        return [whole] if whole is not None else self._tree(b)

    def encode_text(self, text: str) -> list[int]:
        return [t for piece in self.split(text) for t in self.encode_piece(piece)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return next((ids for _, _, ids, _ in self.table.column(pa.array([text]))), np.zeros(0, np.uint32))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_open: dict[str, TreeBpe] = {}


def coder(path: str, pattern: str) -> TreeBpe:
    if path not in _open:
        with open(path, "rb") as f:
            _open[path] = TreeBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
    return _open[path]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs(doc_id, text)."""
    prepare(docs.sparkSession)

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            n, one, two = [], [], []
            for a, b, all_ids, at in c.table.column(T.rows_with(batch, "text")):
                for k in range(b - a):
                    ids = all_ids[at[k] : at[k + 1]]
                    n.append(len(ids))
                    one.append(hashlib.sha256(ids).hexdigest())
                    two.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([T.rows_with(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
