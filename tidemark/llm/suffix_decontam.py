"""Benchmark decontamination with suffix arrays over the training texts.

The texts of a task are taken in shards of about a million characters. Each shard gets a suffix array over its
words; every suffix of every benchmark item is searched in it by binary search, one word deeper at a time, which gives
its longest verbatim match and all its places. A window (ten words of an item, or the whole of a shorter item) that
occurs marks its words in the document as hit.

Only words of the benchmark can take part in a match, so a shard's array holds just the runs of such words that are as
long as the shortest window; no window that could match is left out. (A longest match shorter than that is not
reported.) There is no shuffle. The
benchmark goes out in blocks of at most ``BLOCK_CHARS`` characters, one narrow pass over the documents for each; after
``CHAIN`` of them the rows are written and the blocks given up, so no worker holds more. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, append_columns, beside, importable
from tidemark.llm._words import Words

WINDOW = 10
BLOCK_CHARS = 8_000_000
CHAIN = 4
_FIELDS = "n_words long, hit_spans array<struct<lo:int,hi:int>>, items array<string>, longest array<struct<item_id:string,item_pos:int,doc_pos:int,length:int>>"


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


class TestSuffixes:
    """All suffixes of a block of benchmark items, as word numbers of the block's vocabulary (from 1)."""

    __test__ = False

    def __init__(self, block: list[tuple], window: int):
        w = Words([t for _, t in block])
        self.vocab, number = np.unique(w.hash, return_inverse=True)
        self.words = np.append(number.astype(np.int64) + 1, 0)
        counts = w.counts
        self.item = np.repeat(np.arange(len(block)), counts)
        self.ids = [i for i, _ in block]
        self.pos = np.arange(len(w.hash)) - np.repeat(w.first[:-1], counts)
        self.left = np.repeat(counts, counts) - self.pos  # words of the suffix
        self.width = np.where(counts >= window, window, counts)  # of each item's windows
        own = self.width[self.item] if len(self.item) else self.pos
        self.window = np.where(self.left >= own, own, 0)  # 0: no window begins here
        self.depth = int(counts.max(initial=0))
        self.shortest = int(self.width[self.width > 0].min(initial=window))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``words`` in the order of their first ``depth`` words at least, by prefix doubling."""
    rank, k, n = words.astype(np.int64), 1, len(words)
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        _, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
        if int(rank.max(initial=0)) == n - 1:
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def search(words: np.ndarray, order: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """Binary search of all test suffixes: lengths of the longest matches and the range ``[lo, hi)`` of the array
    where they are, and for each suffix at which a window begins the range where it occurs."""
    m, n = len(tests.left), len(order)
    padded = np.concatenate((words, np.full(tests.depth + 1, -1, np.int64)))
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    best = np.zeros(m, np.int64)
    wlo, whi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    alive, d = np.arange(m), 0
    while len(alive):
        want = tests.words[alive + d]
        ends = []
        for right in (False, True):
            a, b = lo[alive].copy(), hi[alive].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, n - 1)] + d]
                go = open_ & ((seen <= want) if right else (seen < want))
                a, b = np.where(go, mid + 1, a), np.where(open_ & ~go, mid, b)
            ends.append(a)
        found = ends[0] < ends[1]
        alive = alive[found]
        lo[alive], hi[alive] = ends[0][found], ends[1][found]
        d += 1
        best[alive] = d
        whole = alive[tests.window[alive] == d]
        wlo[whole], whi[whole] = lo[whole], hi[whole]
        alive = alive[tests.left[alive] > d]
    return best, lo, hi, wlo, whi


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all ranges, and the range each comes from."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size), which


def _scan(texts: list, spans_before: list, items_before: list, longest_before: list, tests: TestSuffixes) -> tuple:
    w = Words(texts)
    counts, total = w.counts, len(w.hash)
    doc = np.repeat(np.arange(w.n_docs), counts)
    number = np.zeros(total, np.int64)
    if total and len(tests.vocab):
        at = np.minimum(np.searchsorted(tests.vocab, w.hash), len(tests.vocab) - 1)
        number = np.where(tests.vocab[at] == w.hash, at + 1, 0)
    spans, items, longest = [list(x or []) for x in spans_before], [list(x or []) for x in items_before], [list(x or []) for x in longest_before]
    known = np.flatnonzero(number)
    if len(known):
        fresh = np.append(True, (np.diff(known) != 1) | (np.diff(doc[known]) != 0))
        run = np.cumsum(fresh) - 1
        known = known[np.bincount(run)[run] >= tests.shortest]
    if len(known):
        fresh = np.append(True, (np.diff(known) != 1) | (np.diff(doc[known]) != 0))
        put = np.arange(len(known)) + np.cumsum(fresh)  # a 0 stands before each run
        words = np.zeros(int(put[-1]) + 2, np.int64)
        words[put] = number[known]
        place = np.zeros(len(words), np.int64)
        place[put] = known
        order = suffix_array(words, tests.depth)
        best, mlo, mhi, wlo, whi = search(words, order, tests)
        hit = np.flatnonzero(whi > wlo)
        if len(hit):
            rank, which = _expand(wlo[hit], whi[hit])
            pair = np.unique(doc[place[order[rank]]] * len(tests.ids) + tests.item[hit][which])
            for p in pair:
                if (name := tests.ids[p % len(tests.ids)]) is not None:
                    items[p // len(tests.ids)].append(name)
            once = np.unique(np.stack((wlo[hit], whi[hit], tests.window[hit])), axis=1)
            rank, which = _expand(once[0], once[1])
            begin = place[order[rank]]
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + once[2][which], -1)
            on = np.cumsum(cover)[:total] > 0
            edge = on & np.append(True, ~on[:-1] | (np.diff(doc) != 0)), on & np.append(~on[1:] | (np.diff(doc) != 0), True)
            for a, b in zip(np.flatnonzero(edge[0]), np.flatnonzero(edge[1]), strict=True):
                spans[doc[a]].append({"lo": int(a - w.first[doc[a]]), "hi": int(b + 1 - w.first[doc[a]])})
            top = hit[np.append(True, tests.item[hit][1:] != tests.item[hit][:-1]) | (best[hit] >= np.append(0, best[hit][:-1]))]
            rank, which = _expand(mlo[top], mhi[top])  # the longest matches, without those that are the tail of one
            for s, at in zip(top[which], place[order[rank]], strict=True):
                longest[doc[at]].append({"item_id": tests.ids[tests.item[s]], "item_pos": int(tests.pos[s]), "doc_pos": int(at - w.first[doc[at]]), "length": int(best[s])})
    return counts, spans, items, longest


def find_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``hit_spans`` (word ranges inside windows, one list per block of items;
    ranges of different blocks may overlap), ``items`` (ids of items with an occurring window, as strings, distinct)
    and ``longest`` (every place of a test suffix's longest match in a shard: item, position in it, position in the
    document, words; ties are all listed).

    Null and empty texts have no words and no hits; so have items without words. An item with a null id marks words but
    is not listed. Repeated rows of documents are each reported; repeated items count once. Columns of ``docs`` that
    have the name of a result column are replaced; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    out = docs
    for c, kind in (("n_words", "long"), ("hit_spans", "array<struct<lo:int,hi:int>>"), ("items", "array<string>"), ("longest", "array<struct<item_id:string,item_pos:int,doc_pos:int,length:int>>")):
        out = out.withColumn(c, F.lit(None).cast(kind))
    spark, held, scratch, written = docs.sparkSession, [], None, None
    for n, block in enumerate(_item_blocks(items, item_id, item_text)):
        if n and n % CHAIN == 0:
            scratch = scratch or Scratch(spark, "decontamination")
            out, before = scratch.save(out, "matches"), written
            written = out
            if before is not None:
                scratch.drop(before)
            while held:
                held.pop().destroy()
        held.append(spark.sparkContext.broadcast(TestSuffixes(block, window)))
        out = _with_block(out, text_col, held[-1])
    if not held:
        out = _with_block(out, text_col, spark.sparkContext.broadcast(TestSuffixes([], window)))
    return out.withColumn("items", F.array_distinct("items"))


def _with_block(rows: DataFrame, text_col: str, sent) -> DataFrame:
    return append_columns(rows, [text_col, "hit_spans", "items", "longest"], _FIELDS, lambda t, s, i, g: _scan(t, s, i, g, sent.value))


def hit_words(spans: str = "hit_spans"):
    """Distinct words inside spans that may overlap: spans are walked in order, each adding what lies beyond the last."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["hi"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(acc["upto"], s["lo"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digest columns of ``find_matches``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = find_matches(docs.select("doc_id", "text"), items)
    listed = F.array_sort("items")
    return m.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their own columns, whatever their names."""
    return beside(docs, ["n_words", "hit_spans", "items", "longest"], lambda d: find_matches(d, items).where(F.size("hit_spans") == 0))
