"""Packing documents into training sequences of equal cost.

A piece of n ids costs `linear * n + n * n`: what a model spends on each token, and on each pair of tokens that attend to each other. In
a window of documents, the ids after a document's last whole sequence (whole ones are sequences of their own) are its remainder. The
remainders go, by falling cost, each to the sequence of least cost that has room for it. As many sequences are open as the window's ids fill; where
none has room for all of a remainder, the sequence of least cost is filled and the rest goes on. So every sequence is full. What is left over a
multiple of `length` waits for the next window, and after a task's last one it goes into sequences whose sizes are the powers of two that add up to it: nothing is padded.

A task packs the documents that it reads, window by window, so ids never go through a shuffle, and the work of a task is bounded by `window` ids beside its current
document. Sequence ids hold the task's number and a counter, so a task that is run again gives the same rows, as long as its input is a table
(rows that come from a shuffle may come in another order; store them first).

A null or empty text has the end id alone. Rows without doc_id, and rows that repeat one, are packed like any other. Very long texts are encoded
whole. Equal costs go by order of reading, then by the older sequence. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .token_records import encode_texts

LENGTH = 1024
END_ID = 0
WIDTH = 1024  # of the model whose cost is estimated
LINEAR = 6 * WIDTH
WINDOW = 1 << 21
NEVER = np.iinfo(np.int64).max


@dataclass
class Piece:
    doc_id: int | None
    ids: np.ndarray
    start: int
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids[:n], self.start, self.doc_tokens), Piece(self.doc_id, self.ids[n:], self.start + n, self.doc_tokens)


@dataclass
class Sequence:
    number: int
    room: int
    cost: int = 0
    pieces: list[Piece] = field(default_factory=list)


def cost(n: int, linear: int = LINEAR) -> int:
    return linear * n + n * n


class Balance:
    """Open sequences by their room: a heap by cost for each room, and the least cost of each heap."""

    def __init__(self, sequences: list[Sequence], linear: int):
        self.linear = linear
        most = max((s.room for s in sequences), default=0)
        self.heaps: list[list[tuple[int, int, Sequence]]] = [[] for _ in range(most + 1)]
        self.least = np.full(most + 1, NEVER)
        for s in sequences:
            self._open(s)

    def _open(self, s: Sequence) -> None:
        heapq.heappush(self.heaps[s.room], (s.cost, s.number, s))
        self.least[s.room] = self.heaps[s.room][0][0]

    def lightest(self, n: int) -> Sequence | None:
        """Takes out the sequence of least cost, then least number, with room for n ids."""
        if n >= len(self.least) or (low := self.least[n:].min()) == NEVER:
            return None
        room = min((n + int(k) for k in np.flatnonzero(self.least[n:] == low)), key=lambda r: self.heaps[r][0][1])
        _, _, found = heapq.heappop(self.heaps[room])
        self.least[room] = self.heaps[room][0][0] if self.heaps[room] else NEVER
        return found

    def put(self, piece: Piece, s: Sequence) -> None:
        s.pieces.append(piece)
        s.room -= len(piece.ids)
        s.cost += cost(len(piece.ids), self.linear)
        if s.room:
            self._open(s)


def balanced(pieces: list[Piece], rooms: list[int], first: int, linear: int = LINEAR) -> tuple[list[Sequence], list[Piece]]:
    """Sequences numbered from `first`, and the pieces left when all are full. Together the pieces fill the rooms."""
    sequences = [Sequence(first + k, room) for k, room in enumerate(rooms)]
    open_ones, left = Balance(sequences, linear), []
    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        rest: Piece | None = piece
        while rest is not None:
            s = open_ones.lightest(len(rest.ids))
            if s is not None:
                open_ones.put(rest, s)
                rest = None
            elif (s := open_ones.lightest(1)) is not None:
                head, rest = rest.cut(s.room)
                open_ones.put(head, s)
            else:
                left.append(rest)
                rest = None
    return sequences, left


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Packer:
    def __init__(self, length: int, window: int, linear: int):
        self.length, self.window, self.linear = length, window, linear
        self.waiting: list[Piece] = []
        self.held = self.used = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[Sequence]:
        """The sequences that this document completes."""
        n = len(ids)
        whole = n - n % self.length
        for start in range(0, whole, self.length):
            yield Sequence(self.used, 0, cost(self.length, self.linear), [Piece(doc_id, ids[start : start + self.length], start, n)])
            self.used += 1
        if whole < n:
            self.waiting.append(Piece(doc_id, ids[whole:].copy(), whole, n))
            self.held += n - whole
        if self.held >= self.window:
            yield from self.pack([])

    def pack(self, last: list[int]) -> Iterator[Sequence]:
        """Packs what waits into whole sequences, and those of the sizes `last`."""
        done, self.waiting = balanced(self.waiting, [self.length] * (self.held // self.length) + last, self.used, self.linear)
        self.used += len(done)
        self.held = sum(len(p.ids) for p in self.waiting)
        yield from done

    def end(self) -> Iterator[Sequence]:
        yield from self.pack(powers(self.held % self.length))


def _packed(path: str, end_id: int, length: int, window: int, linear: int):
    def rows(sequences: Iterator[Sequence], base: int) -> Iterator[tuple]:
        for s in sequences:
            at = 0
            for p in s.pieces:
                yield p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, base + s.number, at, s.cost
                at += len(p.ids)

    def table(found: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 8, types)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_cost"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        packer = Packer(length, window, linear)
        for batch in batches:
            found: list[tuple] = []
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encode_texts([t or "" for t in batch.column(1).to_pylist()], path, special=True)):
                found += rows(packer.add(doc_id, np.append(np.frombuffer(tokens, "<u4"), np.uint32(end_id))), base)
            yield table(found)
        yield table(list(rows(packer.end(), base)))

    return made


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, window: int = WINDOW, linear: int = LINEAR) -> DataFrame:
    """documents -> doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset, sequence_cost: a row a piece.

    length: a power of two.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    small_batches(docs.sparkSession, 500)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_cost long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packed(tokenizer_path, end_id, length, window, linear), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (all of them, little-endian u32), lengths of its pieces in order, and cost: the rows that a trainer reads."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("p"), F.max("sequence_cost").alias("cost"))
    joined = F.aggregate("p.ids", F.lit(b""), lambda out, ids: F.concat(out, ids))
    return whole.select("sequence_id", joined.alias("ids"), F.col("p.length").alias("lengths"), "cost")
