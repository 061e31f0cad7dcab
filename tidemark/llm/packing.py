"""Packing of tokenised documents into sequences of a fixed length, by best-two-fit.

Documents are tokenised in the tasks, an end token is added, and what is longer than a
sequence is cut into whole sequences and a rest. Only the lengths of the pieces matter for
packing, and there are at most `capacity` of them, so the whole corpus is packed by one
count for each length, however many pieces there are: a sequence is filled greedily (the
longest piece left, then the longest that fits, and so on); then, as long as two pieces
left would fill the room of its smallest piece and the gap more tightly, they replace it. The
next sequences of the same plan follow from the counts, so a plan is made once with the
number of times it can be repeated. A plan ends with one of its lengths used up to less
than the plan needs, so there are at most capacity * (2 + 1/2 + ... + 1/capacity) plans
(41,000 for 4,096) of at most 90 different lengths: that is what the driver works out and
what the tasks get, whatever the size of the corpus.

A piece finds its place by its number among the pieces of its length: each task numbers
its own ones, and what the tasks before it have is a running sum over tasks. No key is
gathered in one task and no document in the driver.

Words (between white space) are tokenised one by one with the library and remembered: none
of the steps of the vocabulary file looks beyond white space, which a test holds against
whole texts. Null and empty texts are the end token only. Repeated and null ids are rows
like any other. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_names
from tidemark.llm.common import materialize, text_blocks, text_slices

CAPACITY, END = 4096, 1
#: Letters, digits and signs that are their own composed form and have a lower case of their own: Latin, Cyrillic, kana, common ideographs.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]+").fullmatch
#: Fixed value: the pattern that the vocabulary file cuts pre-tokens by.
_PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
#: Words and longest word that a task remembers; a longer run without white space is cut beside digits, which are tokens of their own.
REMEMBERED, LONGEST, RUN = 600_000, 40, 1 << 16
#: White space as Unicode defines it; Python's own splitting takes four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_DIGIT = re.compile(r"(?<=[0-9])(?=[!-~])")


class Pieces(dict):
    """The ids of pre-tokens, as bytes of 32-bit numbers, by the model of a tokenizer."""

    def __init__(self, model):
        self.model, self.names = model, {b: c for c, b in byte_names().items()}

    def __missing__(self, piece: str) -> bytes:
        named = piece if piece.isascii() else "".join(map(self.names.__getitem__, piece.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Words(dict):
    """The ids of words, as bytes of 32-bit numbers, from a tokenizer file's content.

    Words of plain letters, which no normal form changes, are lower-cased and cut into
    pre-tokens here and merged by the library's model; any other word, and any that may hold
    a special token, goes through the whole library.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = Pieces(self.tokenizer.model)

    def __missing__(self, word: str) -> bytes:
        if _PLAIN(word) and "<|" not in word:
            ids = b"".join(map(self.pieces.__getitem__, _PRE_TOKENS(word.lower())))
        else:
            parts = [word] if len(word) <= RUN else _DIGIT.split(word)
            ids = b"".join(array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in parts)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, block by block."""
        for block in text_blocks(text):
            words = [w for w in _SPACE.split(block) if w] if _CONTROL.search(block) else block.split()
            yield b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def words_of(spec: str) -> Words:
    return Words(spec)


def pieces_of(blocks: Iterator[bytes], capacity: int, end: int) -> Iterator[bytes]:
    """The ids of a document and its end token in runs of `capacity`; the last may be shorter."""
    held, size = b"", 4 * capacity
    for block in blocks:
        held += block
        whole = (len(held) - 1) // size if held else 0  # what is left over is never empty: the end token may still follow
        for k in range(whole):
            yield held[k * size : (k + 1) * size]
        held = held[whole * size :]
    held += np.array([end], "<u4").tobytes()
    for k in range(0, len(held), size):
        yield held[k : k + size]


_PIECE = "task long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, spec: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each piece of each document, numbered in its task among those of its length. `spec` is the content of the tokenizer file; `with_ids` adds the ids."""

    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count, task = words_of(shared.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in text_slices(batch):
                rows: list[tuple] = []
                for doc, text in zip(part.column("id").to_pylist(), part.column("text")):
                    for k, ids in enumerate(pieces_of(words.encode(text.as_py()), capacity, end)):
                        n = len(ids) // 4
                        rows.append((task, int(count[n]), doc, k, k * capacity, n, zlib.crc32(ids), *([np.frombuffer(ids, "<u4").tolist()] if with_ids else [])))
                        count[n] += 1
                names = [*(c.split()[0] for c in _PIECE.split(", ")), *["ids"] * with_ids]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in zip(range(len(names)), kinds)], names)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, _PIECE + ", ids array<long>" * with_ids)


class Left:
    """Counts of what is left by length, and the longest one left that is not over a limit."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        self.lengths = np.flatnonzero(self.counts)  # ascending

    def longest(self, limit: int) -> int:
        k = int(np.searchsorted(self.lengths, limit, "right"))
        return int(self.lengths[k - 1]) if k else 0

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.lengths = np.delete(self.lengths, np.searchsorted(self.lengths, length))

    def put_back(self, length: int) -> None:
        if not self.counts[length]:
            self.lengths = np.insert(self.lengths, np.searchsorted(self.lengths, length), length)
        self.counts[length] += 1

    def tightest_two(self, least: int, most: int) -> tuple[int, int] | None:
        """Two lengths left whose sum is the largest in (least, most]; of such sums the pair with the longest piece."""
        first = self.lengths[self.lengths < most]
        if not len(first):
            return None
        k = np.searchsorted(self.lengths, np.minimum(most - first, first), "right") - 1  # the second is not longer than the first
        second = np.where(k >= 0, self.lengths[k], 0)
        alone = (second == first) & (self.counts[first] < 2)  # one piece can't be both
        second = np.where(alone, np.where(k >= 1, self.lengths[np.maximum(k - 1, 0)], 0), second)
        total = np.where(second > 0, first + second, 0)
        at = len(total) - 1 - int(np.argmax(total[::-1]))
        return (int(first[at]), int(second[at])) if total[at] > least else None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, pieces of each length) for each kind of sequence; `counts[n]` pieces have the length n."""
    left, plans = Left(counts), []
    while len(left.lengths):
        held: dict[int, int] = defaultdict(int)
        gap = capacity
        while gap and (length := left.longest(gap)):
            n = min(int(left.counts[length]), gap // length)
            left.take(length, n)
            held[length] += n
            gap -= n * length
        while gap:
            smallest = min(held)
            two = left.tightest_two(smallest, gap + smallest)
            if two is None:
                break
            for length in two:
                left.take(length)
                held[length] += 1
            gap -= sum(two) - smallest
            left.put_back(smallest)
            held[smallest] -= 1
            if not held[smallest]:
                del held[smallest]
        more = min(int(left.counts[length]) // n for length, n in held.items())
        for length, n in held.items():
            if more:
                left.take(length, more * n)
        plans.append((1 + more, dict(held)))
    return plans


def runs(plans: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where pieces go: those of one length, from number `start` on, `per` to a sequence, from sequence `first` on, the first at `offset`. Sorted by (length, start)."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for times, held in plans:
        offset = 0
        for length in sorted(held, reverse=True):
            n = held[length]
            out.append((length, used[length], n, first, offset))
            used[length] += times * n
            offset += length * n
        first += times
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "per", "first", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (a written table of `cut`) with their sequence and their place in it."""
    spark = pieces.sparkSession
    counted = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row for each length: at most `capacity`
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in totals:
        counts[length] = n
    places = spark.sparkContext.broadcast(runs(plan(counts, capacity)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(counted.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = places.value
        starts = use["length"] << 44 | use["start"]
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            at = np.searchsorted(starts, length << 44 | nth, "right") - 1
            within = nth - use["start"][at]
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("task", "nth")}
            columns["sequence_id"] = pa.array(use["first"][at] + within // use["per"][at])
            columns["offset"] = pa.array(use["offset"][at] + within % use["per"][at] * length)
            yield pa.RecordBatch.from_pydict(columns)

    kept = [f for f in numbered.schema.fields if f.name not in ("task", "nth")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return numbered.select("task", "nth", *(f.name for f in kept)).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack `docs`. The driver reads the tokenizer file at `path` and sends its content."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return pack(materialize(cut(docs, spec, capacity, end, with_ids=with_ids)), capacity)
