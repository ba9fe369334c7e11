"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Documents are dealt at random to shards of about ``SHARD_ROWS``, which pack for themselves, longest first. A shard keeps its open bins ordered by residual. A piece looks up the tightest bin that holds it and goes on to
the next wider ones until one has neither its source nor its duplicate cluster, which each bin carries as bitmaps; if
none has room, it opens a bin. A document longer than a sequence is cut: full pieces fill bins of their own and the
rest is packed like any other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, append_columns, importable
from tidemark.llm._words import Words

CAPACITY = 2048
SHARD_ROWS = 4_000
_NULL_ID = -(2**63)


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], int]:
    """Bin of each piece (sizes from 1 to capacity, in the given order), and the number of bins.

    A null source or cluster conflicts with nothing.
    """
    bit_of: dict = {}
    bins: list[int] = []  # residual << 32 | bin, ascending
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << bit_of.setdefault(("s", source), len(bit_of))
        c = 0 if cluster is None else 1 << bit_of.setdefault(("c", cluster), len(bit_of))
        i = bisect_left(bins, size << 32)
        while i < len(bins):
            b = bins[i] & 0xFFFFFFFF
            if not (has_source[b] & s or has_cluster[b] & c):
                break
            i += 1
        if i < len(bins):
            left = (bins.pop(i) >> 32) - size
        else:
            b, left = len(has_source), capacity - size
            has_source.append(0)
            has_cluster.append(0)
        has_source[b] |= s
        has_cluster[b] |= c
        if left:
            insort(bins, left << 32 | b)
        out.append(b)
    return out, len(has_source)


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of one shard's documents with their bins."""
    docs = pdf.sort_values(["n_tokens", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
    rows = []
    for d, n, source, cluster in zip(docs["doc_id"].tolist(), docs["n_tokens"].tolist(), docs["source"].tolist(), docs["cluster"].tolist(), strict=True):
        for k in range(0, n, capacity):
            rows.append((d, k // capacity, k, min(capacity, n - k), source, cluster))
    rest = [r for r in rows if r[3] < capacity]
    full = [r for r in rows if r[3] == capacity]
    rest.sort(key=lambda r: -r[3])
    # clusters of one document conflict with nothing; leaving their bits out keeps the bitmaps short
    seen: dict = {}
    for r in rest:
        seen[r[5]] = seen.get(r[5], 0) + 1
    bins, n_bins = best_fit([r[3] for r in rest], [r[4] for r in rest], [r[5] if r[5] is not None and seen[r[5]] > 1 else None for r in rest], capacity)
    whole = list(range(n_bins, n_bins + len(full)))
    out = pd.DataFrame(rest + full, columns=["doc_id", "piece", "start", "n_tokens", "source", "cluster"])
    out["bin"] = bins + whole
    out["bin_offset"] = out.groupby("bin")["n_tokens"].cumsum() - out["n_tokens"]
    return out


def word_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row without its text, with ``n_tokens`` (words, and an end mark) and ``cluster`` (digest of its words; null
    without any)."""

    def run(texts: list) -> tuple:
        w = Words(texts)
        digest = [hashlib.blake2b(w.hash[a:b].tobytes(), digest_size=8).hexdigest() if b > a else None for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        return w.counts + 1, digest

    return append_columns(docs, [text], "n_tokens long, cluster string", run, without=(text,))


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", tokens: str = "n_tokens", source: str = "source", cluster: str = "cluster") -> DataFrame:
    """Rows ``doc_id, piece, start, n_tokens, bin_id, bin_offset``: a document's tokens ``start .. start + n_tokens``
    are at ``bin_offset`` of sequence ``bin_id``. No bin has two pieces of one source or of one cluster, other than
    null ones, and none exceeds the capacity.

    Documents with null or no tokens have no piece. Null ids are packed like others; rows of one id are separate
    documents, of one cluster if their texts are. Other columns are not used; an empty table gives an empty result.

    What is packed, ids and numbers but no texts, is written out first with the shard of each row drawn at random: so
    repeated rows spread over the shards, and a task that runs again finds the same rows in its shard.
    """
    spark = docs.sparkSession
    importable(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(tokens).cast("long").alias("n_tokens"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster")).where("n_tokens > 0")
    rows = Scratch(spark, "packing").save(own.withColumn("spread", F.rand(5)), "lengths")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.least(F.floor(F.col("spread") * shards), F.lit(shards - 1)).cast("long")).drop("spread")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].isna()
        pdf = pdf.assign(doc_id=pdf["doc_id"].fillna(_NULL_ID).astype("int64"), null_id=ids, source=pdf["source"].astype(object).where(pdf["source"].notna(), None), cluster=pdf["cluster"].astype(object).where(pdf["cluster"].notna(), None))
        none = pdf[pdf["null_id"]]
        out = pack_shard(pdf, capacity)
        out["bin_id"] = key[0] * (1 << 32) + out["bin"]
        ids_out = out["doc_id"].astype("Int64")
        if len(none):
            ids_out = ids_out.mask(out["doc_id"] == _NULL_ID)
        out["doc_id"] = ids_out
        return out[["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset"]]

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset long")


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """``pack`` with words as tokens and exact copies as clusters. A null or empty text is its end mark alone."""
    return pack(word_lengths(docs.select("doc_id", F.col(text).alias("text"), "source"), "text"), capacity)
