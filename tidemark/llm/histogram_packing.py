"""Shortest-pack-first packing over the histogram of lengths.

A document's ids are cut into full sequences and a rest. Only the histogram of rests, with at most ``capacity`` entries,
comes to the driver: lengths are placed longest first, each into the packs that are shortest (have most room), and a
placement moves as many packs of one fill as there are documents of the length at once. What is kept of a placement is
its length, the range of ranks of the documents in it and where their sequences begin, so the plan's size does not
depend on the number of documents. Documents find their sequence by the rank they have within their length: a number
within the task that encoded them, plus what earlier tasks have.

The packs are as many as the ids fill, so that nothing is padded: a length that does not fit the shortest pack is cut, its
first part fills the packs, and the rest is a shorter length of the histogram. What is over after the last whole
sequence goes to sequences of a power of two each, which need no padding either.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, importable, lookup_join
from tidemark.llm._words import chunks
from tidemark.llm.bit_packing import _tokenizer

CAPACITY = 4096
#: Characters encoded at once
PART_CHARS = 2_000_000
_RANKS = 40  # bits of a rank in a placement's key


class Plan:
    """Placements: ranks ``lo ..`` of ``length`` lie at ``offset`` of the sequences ``first ..``; where only ``fit`` ids of
    each do, the others are ranks ``rest ..`` of the length that is left."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        total = sum(n * k for n, k in histogram.items())
        whole, over = divmod(total, capacity)
        #: packs of one room: (-room, first sequence, how many, filled)
        heap = [(-capacity, 0, whole, 0)] if whole else []
        self.n_sequences = whole
        for bit in reversed(range(over.bit_length())):
            if over >> bit & 1:
                heap.append((-(1 << bit), self.n_sequences, 1, 0))
                self.n_sequences += 1
        heapq.heapify(heap)
        count = np.zeros(capacity, np.int64)
        for n, k in histogram.items():
            count[n] = k
        made, self.n_cuts = [], 0
        for length in range(capacity - 1, 0, -1):
            rank = 0
            while rank < count[length]:
                room, first, packs, filled = heapq.heappop(heap)
                n = int(min(packs, count[length] - rank))
                fit = min(length, -room)
                rest = 0
                if fit < length:
                    rest = int(count[length - fit])
                    count[length - fit] += n
                    self.n_cuts += n
                made.append((length << _RANKS | rank, first, filled, fit, rest))
                if packs > n:
                    heapq.heappush(heap, (room, first + n, packs - n, filled))
                if fit < -room:
                    heapq.heappush(heap, (room + fit, first, n, filled + fit))
                rank += n
        table = np.array(sorted(made), np.int64).reshape(-1, 5)
        self.key, self.first, self.offset, self.fit, self.rest = table.T.copy()

    def places(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``(rows, begin in the rest, length, sequence, offset)`` of the pieces of rests, until none is left."""
        rows = np.flatnonzero(length > 0)
        length, rank, begin = length[rows].astype(np.int64), rank[rows].astype(np.int64), np.zeros(len(rows), np.int64)
        while len(rows):
            at = np.searchsorted(self.key, length << _RANKS | rank, "right") - 1
            within = rank - (self.key[at] & (1 << _RANKS) - 1)
            fit = self.fit[at]
            yield rows, begin, fit, self.first[at] + within, self.offset[at]
            more = fit < length
            rows, begin, length, rank = rows[more], (begin + fit)[more], (length - fit)[more], (self.rest[at] + within)[more]


def encoded(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, capacity: int) -> DataFrame:
    """``part, doc_id, doc_tokens, rest, nth, fulls, ids``: the task that encoded a document, its ids, and which one of
    the task's documents with such a rest it is, and how many full sequences came before it there."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tok = TaskContext.get().partitionId(), _tokenizer(tokenizer, end_id)
        seen, fulls = np.zeros(capacity, np.int64), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts, PART_CHARS):
                made = tok.encode(texts[lo:hi])
                n = np.array([len(x) for x in made], np.int64)
                rest, full = n % capacity, n // capacity
                nth = seen[rest] + pd.Series(rest).groupby(rest).cumcount().to_numpy()
                seen += np.bincount(rest, minlength=capacity)
                before = fulls + np.cumsum(full) - full
                fulls += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, part), pa.int32()), b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(rest, pa.int32()), pa.array(nth), pa.array(before), pa.array([x.astype(kind).tobytes() for x in made], pa.binary())],
                    names=["part", "doc_id", "doc_tokens", "rest", "nth", "fulls", "ids"],
                )

    return docs.mapInArrow(run, "part int, doc_id long, doc_tokens long, rest int, nth long, fulls long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: every id of every document is in one
    piece, and a sequence's pieces lie without gaps from offset 0.

    A null or empty text is the end id alone. Null ids and repeated rows are documents of their own; documents of one
    length are ranked in the order of the tasks that read them, so ties may change places when files do. A text longer
    than a sequence fills sequences of its own and leaves a rest. Other columns are not used; an empty table gives an empty
    result. All sequences are full, but for at most one of each power of two below the capacity.

    Texts are encoded once; their ids are written out (two bytes each for up to 65,536 ids) and read once more when the
    plan is known, without a shuffle unless the counts by task and length are too many to broadcast.
    """
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark, "histogram")
    ids = scratch.save(encoded(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tokenizer, vocabulary, end_id, capacity), "ids")
    parts = scratch.save(ids.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {capacity}")).alias("full")), "counts")
    seen = parts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()  # at most ``capacity`` rows
    n_full = sum(r["full"] for r in seen)
    plan = Plan({r["rest"]: r["n"] for r in seen if r["rest"]}, capacity)
    earlier = lambda by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", "rest", F.coalesce(F.sum("n").over(earlier(["rest"])), F.lit(0)).alias("base"))
    by_part = parts.groupBy("part").agg(F.sum("full").alias("full"))
    by_part = by_part.select("part", F.coalesce(F.sum("full").over(earlier([])), F.lit(0)).alias("base_full"))  # a row per task
    bases = scratch.save(base.join(by_part.hint("merge"), "part"), "bases")
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rest, rank, full = (b.column(k).to_numpy() for k in (1, 2, 3, 4))
            whole = n // capacity
            row = np.repeat(np.arange(len(n)), whole)
            which = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
            found = [(row, which * capacity, np.full(len(row), capacity), full[row] + which, np.zeros(len(row), np.int64))]
            for rows, begin, length, sequence, offset in plan.places(rest, rank):
                found.append((rows, whole[rows] * capacity + begin, length, n_full + sequence, offset))
            row, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            wide = [np.frombuffer(x.as_py(), kind).astype("<u4") for x in b.column(5)]
            crc = [zlib.crc32(wide[r][s : s + k].tobytes()) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), *[pa.array(x, pa.int64()) for x in (start, length, crc, n[row], sequence, offset)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = lookup_join(ids, bases, ["part", "rest"], "inner")
    own = ranked.select("doc_id", "doc_tokens", "rest", (F.col("base") + F.col("nth")).alias("rank"), (F.col("base_full") + F.col("fulls")).alias("full"), "ids")
    return own.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
