"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A text is cut into pieces by the byte-level pre-tokenisation pattern, and a piece
is cut wherever two neighbouring bytes occur side by side in no token of the
vocabulary: no merge can cross such a cut, so each fragment is merged by itself and
the ids are concatenated. Special tokens of the file are matched first, as the
library does unless told otherwise.

The result equals the library's ids for every text. Null is the empty text, which
has no ids. Repeated pieces are encoded once for a task. Further columns are kept
out of the way: only the id and the text are read.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_blocks, text_slices

#: Fixed value: the pattern that byte-level tokenizers of this family cut texts by, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces and longest piece that a task remembers.
REMEMBERED, LONGEST = 500_000, 40


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Codec:
    """The vocabulary of one file: merges, forced cuts, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(map(names.__getitem__, token)) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.single = {b: vocab[c] for c, b in names.items()}
        #: rank of each mergeable pair of ids, packed, and the id that each rank makes
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(vocab[a] << 20 | vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        self.joined = bytearray(65536)  # 1 for two bytes that stand side by side in some token
        for token in self.bytes_of.values():
            for x, y in zip(token, token[1:]):
                self.joined[x << 8 | y] = 1
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def fragments(self, piece: bytes) -> Iterator[bytes]:
        """Cut at the certain boundaries."""
        joined, start = self.joined, 0
        for k, (x, y) in enumerate(zip(piece, piece[1:]), 1):
            if not joined[x << 8 | y]:
                yield piece[start:k]
                start = k
        yield piece[start:]

    def merge(self, fragment: bytes) -> list[int]:
        """Apply the merges of a fragment, the lowest rank first, the leftmost of equal ones."""
        ids = [self.single[b] for b in fragment]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, made, never = self.rank.get, self.made, 1 << 60
        ranks = [get(a << 20 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == never:
                break
            k = ranks.index(low)
            new = made[low]
            ids[k : k + 2] = [new]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | new, never)
            if k < len(ranks):
                ranks[k] = get(new << 20 | ids[k + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n."""
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[r], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (r := get(ids[left] << 20 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        out = array("i", [i for f in self.fragments(piece.encode()) for i in self.merge(f)]).tobytes()
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        known = self.known
        for part in self.specials.split(text) if self.specials and self.specials.search(text) else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32).tobytes())
            else:
                for block in text_blocks(part):  # cut where white space follows other characters, which is a boundary of pieces
                    out += [known.get(p) or self._piece(p) for p in self.pieces.findall(block)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) for each row of `docs`, and with `decoded` the text that the ids give back. `path` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            for part in text_slices(batch):
                ids = [use.encode(t.as_py() or "") for t in part.column("text")]
                offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                columns = {"id": part.column("id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))}
                if decoded:
                    columns["text"] = pa.array([use.decode(i.tolist()) for i in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from rows of token ids; null ids are the empty text, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            texts = [use.decode(i.as_py() or []) for i in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")
