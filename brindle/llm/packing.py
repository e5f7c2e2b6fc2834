"""Packed token ids for training.

Every text becomes its token ids and one end id.  Overlong ones are split into
pieces of the row length, and pieces are packed best-fit-decreasing: the longest
first, each into the row with the least room that still takes it.  A segment
tree over room sizes finds that row in logarithmic time.

Packing needs no shuffle: a task packs what it reads, a block of at most
`block_tokens` at a time, which bounds its memory whatever the input is.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What splits a text before merges, as published with the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 4_000_000


@functools.lru_cache(maxsize=2)
def encoder(ranks: str):
    """The tiktoken encoding of a rank file, without special tokens, and the first free id."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}), max(merges.values()) + 1


class RoomTree:
    """Rows by the room they have left; `take(n)` gives the one with the least room of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= need, taken out; None if there is none."""
        count, at = self.count, need + self.size
        if not count[at]:
            # up until a right sibling has rows, then down its left side
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, row_length: int) -> list[list[int]]:
    """Indices of the pieces in each row, in the order they were put there."""
    tree, rows = RoomTree(row_length), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if found := tree.take(n):
            room, row = found
            rows[row].append(i)
        else:
            room, row = row_length, len(rows)
            rows.append([i])
        if room > n:
            tree.put(room - n, row)
    return rows


_SCHEMA = (
    "pack_id long, input_ids array<int>, position_ids array<int>, cu_seqlens array<int>, "
    "doc_ids array<long>, pieces array<int>, n_tokens int"
)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, kind))


def _pack(ids: list, numbers: list[int], pieces: list[np.ndarray], length: int, pad: int, first: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(p) for p in pieces])
    rows = best_fit_decreasing(sizes, length)
    for a in range(0, len(rows), 256):
        some = rows[a : a + 256]
        order = [i for row in some for i in row]
        matrix, places = np.full((len(some), length), pad, np.int32), np.zeros((len(some), length), np.int32)
        cumulative = []
        for r, row in enumerate(some):
            at = 0
            cumulative.append(0)
            for i in row:
                n = sizes[i]
                matrix[r, at : at + n] = pieces[i]
                places[r, at : at + n] = np.arange(n)
                at += n
                cumulative.append(at)
        held = np.array([len(row) for row in some])
        full = np.full(len(some), length)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(first + a, first + a + len(some))), _lists(matrix.ravel(), full, pa.int32()), _lists(places.ravel(), full, pa.int32()),
                _lists(np.array(cumulative, np.int32), held + 1, pa.int32()), _lists([ids[i] for i in order], held, pa.int64()),
                _lists([numbers[i] for i in order], held, pa.int32()), pa.array(np.array([sizes[row].sum() for row in some], np.int32)),
            ],
            ["pack_id", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces", "n_tokens"],
        )


def pack_tokens(
    docs: DataFrame, ranks: str, row_length: int = 2048, block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows of exactly `row_length` token ids: (pack_id, input_ids, position_ids, cu_seqlens, doc_ids, pieces, n_tokens).

    cu_seqlens holds where segments begin and the last one ends, doc_ids and
    pieces say whose piece and which a segment is, position_ids begin anew at
    each segment, and the end id also fills what is left of a row.  A document's
    pieces in their order are exactly its tokens and the end id; null and empty
    texts are the end id alone.  Repeated rows are packed as often as they
    occur.  `ranks` is a tiktoken rank file that every worker can read; the
    first id beyond it is the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        ids, numbers, pieces, held = [], [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = np.append(encode.encode_to_numpy(text or "", disallowed_special=()).astype(np.int32), np.int32(end))
                    for k, a in enumerate(range(0, len(tokens), row_length)):
                        ids.append(doc_id)
                        numbers.append(k)
                        pieces.append(tokens[a : a + row_length])
                    held += len(tokens)
                    if held >= block_tokens:
                        for out in _pack(ids, numbers, pieces, row_length, end, first):
                            first += len(out)
                            yield out
                        ids, numbers, pieces, held = [], [], [], 0
        if pieces:
            yield from _pack(ids, numbers, pieces, row_length, end, first)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, _SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes rows as binary: ids and positions as little-endian int32 strings of bytes, in Parquet."""

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            for k in (1, 2, 3):
                flat, offsets = columns[k].flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes(), columns[k].offsets.to_numpy()
                offsets = (offsets - offsets[0]) * 4
                columns[k] = pa.array([flat[a:b] for a, b in zip(offsets, offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    packed.mapInArrow(
        run, "pack_id long, input_ids binary, position_ids binary, cu_seqlens binary, doc_ids array<long>, pieces array<int>, n_tokens int"
    ).write.parquet(path)
