"""Near-duplicate classes with Order MinHash.

The sketch of a text is made from its runs of five words, each labelled with its occurrence number. For each of
``COMPONENTS`` hash functions the ``SAMPLED`` smallest labelled runs are taken and kept in text order; the hash of that
sequence is a component. Two texts agree in a component only if they share the sampled runs and their order, which
makes it sensitive to edit similarity rather than to set overlap alone.

1. one pass over the texts gives each a digest of its words and its sketch; equal digests are one class (an
   aggregation with map-side combine, so that copies by the thousand cost a row each), and only its smallest id goes on;
2. representatives that agree in a component share a bucket. Each is first compared with the best connected member of
   its buckets (the original of a family of near copies agrees with more of them than they do with each other), and
   linked if a banded alignment finds a similarity of ``THRESHOLD``;
3. what is linked becomes one class (distributed connected components). In buckets that still hold several classes,
   members outside the commonest class are paired with every member of another class. A pair is compared unless it
   can't reach the threshold: each text carries the parities of its labelled runs in ``64 * PARITIES`` hash cells, and
   as many runs at least are in one text only as there are cells in which two texts differ. That is an exact bound,
   so no link is lost, while the unlike pairs of a large family never leave the join;
4. buckets with many such pairs, as of pages made from one template, are not paired at all. Two texts of similarity t
   share one of the ``(1 - t) n + 1`` rarest labelled runs of either (n its runs), in any order of all runs; members of
   those buckets meet on these rare runs only, which what they have in common with all the others is not among.

The similarity is that of aligned runs of five words: ``aligned / (a + b - aligned)`` where ``aligned`` is the longest
common subsequence of the two run sequences within a band. Two texts that reach the threshold cannot leave that band.
Without moved passages it equals the Jaccard similarity of the labelled runs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import BROADCAST_ROWS, Scratch, components, free_name, importable, lookup_join
from tidemark.llm._words import Words, chunks, mix

WORDS = 5
THRESHOLD = 0.8
COMPONENTS = 16
SAMPLED = 4
PARITIES = 16
#: Pairs of equal runs for a run, beyond which two texts are aligned by bits
REPEATS = 8
#: Buckets with more pairs than this, about a second of a task to tell apart by parities, go by rare runs instead;
#: cells in which those are counted
BUCKET_PAIRS = 1 << 24
CELLS = 1 << 22
_SEEDS = np.random.default_rng(5).integers(1, 2**63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(6).integers(1, 2**63, SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Runs mixed with their occurrence number, so that the second occurrence differs from the first."""
    order = np.argsort(runs, kind="stable")
    s = runs[order]
    fresh = np.append(True, s[1:] != s[:-1])
    if fresh.all():
        return runs
    begin = np.flatnonzero(fresh)
    nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    out = runs.copy()
    again = nth > 0
    out[order[again]] = mix(s[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketch(runs: np.ndarray) -> np.ndarray:
    """The Order MinHash components of a sequence of runs (not empty)."""
    x = labelled(runs)
    k = min(SAMPLED, len(x))
    out = np.empty(COMPONENTS, np.uint64)
    step = max(1, 400_000 // len(x))
    for a in range(0, COMPONENTS, step):
        h = (x[None, :] ^ (x[None, :] >> np.uint64(33)) ^ _SEEDS[a : a + step, None]) * _SEEDS[a : a + step, None]
        low = np.argpartition(h, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (len(h), 1))
        kept = x[np.sort(low, axis=1)]  # in text order
        out[a : a + step] = mix((kept * _PLACE[:k]).sum(axis=1, dtype=np.uint64) + np.arange(a, a + len(h), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def parities(runs: np.ndarray) -> np.ndarray:
    """Parity of the number of labelled runs in each hash cell, as PARITIES words of 64 bits."""
    cells = np.bincount((mix(labelled(runs)) >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many runs two sequences share at their begin, and at their end beyond that."""
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    head = int(diff[0]) if len(diff) else n
    n -= head
    diff = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    return head, int(diff[0]) if len(diff) else n


def aligned_runs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose pairs (i, j) have |i - j| <= band.

    Equal ends are stripped. Runs of five words seldom repeat, so there are about as many pairs of equal runs as runs:
    the longest ascending chain of them is found by bisection, in n log n. Texts that repeat themselves go through a bit
    vector as wide as the band instead.
    """
    head, tail = _ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    order = np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b[order], a, side=side) for side in ("left", "right"))
    count = hi - lo
    if int(count.sum()) > REPEATS * (len(a) + len(b)):
        return head + tail + _banded_bits(a, b, band)
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    ends: list[int] = []  # the least last place of a chain of each length
    for place in j[np.lexsort((-j, i))].tolist():
        if not ends or place > ends[-1]:
            ends.append(place)
        else:
            ends[bisect_left(ends, place)] = place
    return head + tail + len(ends)


def _banded_bits(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same by bit-parallel rows over b. Only the places of a inside the band are held: what falls out below is
    final, as a match changes no bit beneath it."""
    places: dict[int, int] = {}
    for i, v in enumerate(a.tolist()):
        places[v] = places.get(v, 0) | (1 << i)
    n, done, base, top = len(a), 0, 0, min(len(a), band)
    v = (1 << top) - 1
    for j, w in enumerate(b.tolist()):
        if top < n and top <= j + band:
            v |= 1 << (top - base)
            top += 1
        if base < j - band:
            if base >= top:
                break
            done += not v & 1
            v >>= 1
            base += 1
        if m := (places.get(w, 0) >> base) & ((1 << (top - base)) - 1):
            u = v & m
            v = ((v + u) | (v - u)) & ((1 << (top - base)) - 1)
    return done + (top - base) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned similarity of two run sequences, or 0 if it can't reach the threshold."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    need = threshold * (n + m) / (1 + threshold)  # aligned runs at the threshold
    common = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    if common < need - 1e-9:
        return 0.0
    got = aligned_runs(a, b, int(n + m - 2 * need) + 1)
    return got / (n + m - got)


def _choice(text: str):
    """By which of the texts of one id is chosen, the least: those with a word first, then by their hash."""
    return F.struct((~F.coalesce(F.col(text).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))).alias("wordless"), F.xxhash64(text).alias("hash"))


def _chosen(rows: DataFrame, *others) -> DataFrame:
    """``id, t``, one row per id of ``rows(id, t)``, and the given aggregates."""
    return rows.groupBy("id").agg(F.min_by("t", _choice("t")).alias("t"), *others)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, pick (see _choice), digest (of the word sequence), sketch, runs (their number), bits (parities)`` for each row with an id;
    the digest is null and the rest empty for a text without words."""
    importable(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, ids = pdf["t"].tolist(), pdf["id"].to_numpy()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                runs, limits = w.grams(WORDS)
                digests, made, bits = [], [], []
                for d in range(hi - lo):
                    own = runs[limits[d] : limits[d + 1]]
                    digests.append(hashlib.blake2b(w.hash[w.first[d] : w.first[d + 1]].tobytes(), digest_size=16).digest() if len(own) else None)
                    bits.append(parities(own) if len(own) else [])
                    made.append(sketch(own).view(np.int64) if len(own) else [])
                yield pd.DataFrame({"id": ids[lo:hi], "wordless": pdf["wordless"].to_numpy()[lo:hi], "hash": pdf["hash"].to_numpy()[lo:hi], "digest": digests, "sketch": made, "runs": np.diff(limits), "bits": bits})

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull())
    return rows.select("id", "t", _choice("t").alias("c")).select("id", "t", "c.*").mapInPandas(run, "id long, wordless boolean, hash long, digest binary, sketch array<long>, runs long, bits array<long>")


def verified(scratch: Scratch, pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """Those of the written ``pairs(a, b)`` whose texts reach the threshold. Only texts that occur in a pair are
    shuffled; they are written out, so that a text with very many partners is split by a plain skewed join."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    one = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    texts = scratch.save(lookup_join(one, ids, ["id"], "left_semi", size=2 * pairs.count()).transform(_chosen), "texts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            left, right = pdf["ta"].tolist(), pdf["tb"].tolist()
            for lo, hi in chunks([x + y for x, y in zip(left, right, strict=True)]):
                runs, limits = Words(left[lo:hi] + right[lo:hi]).grams(WORDS)
                n = hi - lo
                ok = [similarity(runs[limits[i] : limits[i + 1]], runs[limits[n + i] : limits[n + i + 1]], threshold) >= threshold - 1e-12 for i in range(n)]
                yield pdf.iloc[lo:hi].loc[ok, ["a", "b"]]

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")).hint("merge"), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")
    links = scratch.save(both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long"), "links")
    scratch.drop(texts)
    return links


def rare_runs(scratch: Scratch, members: DataFrame, docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """``(run, rank, id, class, runs)``: the rarest labelled runs of each of the ``members(id, class, runs)`` that a text
    of similarity ``threshold`` must have one of, with their place among all its runs, the rarest first. Rare is what falls in a seldom-hit one of ``CELLS`` hash cells, counted over the members; any
    order of the runs would be exact, this one keeps the runs of a template out. Runs of cells that only one member hits
    are in no other text and are left out."""
    one = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    kinds = scratch.save(members.select("id", "class", "runs").distinct(), "members")
    texts = scratch.save(lookup_join(one, kinds, ["id"], "inner").transform(_chosen, F.first("class").alias("class"), F.first("runs").alias("runs")), "texts")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in frames:
            got, own = pdf["t"].tolist(), list(zip(pdf["id"].tolist(), pdf["class"].tolist(), strict=True))
            for lo, hi in chunks(got):
                runs, limits = Words(got[lo:hi]).grams(WORDS)
                yield from ((own[lo + d], labelled(runs[limits[d] : limits[d + 1]])) for d in range(hi - lo))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(CELLS, np.int64)
        for _, runs in each(frames):
            seen[np.unique((runs >> np.uint64(20)).astype(np.int64) % CELLS)] += 1
        cells = np.flatnonzero(seen)
        for a in range(0, len(cells), 100_000):
            yield pd.DataFrame({"c": cells[a : a + 100_000], "n": seen[cells[a : a + 100_000]]})

    table = texts.mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    hits = np.zeros(CELLS, np.int64)
    hits[table.column("c").to_numpy()] = table.column("n").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(hits.astype(np.float32))

    def rarest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, runs in each(frames):
            n = len(runs) - int(np.ceil(threshold * len(runs) - 1e-9)) + 1
            seen = sent.value[(runs >> np.uint64(20)).astype(np.int64) % CELLS]
            first = np.lexsort((runs, seen))[:n]
            rank = np.flatnonzero(seen[first] > 1)
            yield pd.DataFrame({"run": runs[first[rank]].view(np.int64), "rank": rank, "id": own[0], "class": own[1], "runs": len(runs)})

    return texts.mapInPandas(rarest, "run long, rank long, id long, class long, runs long")


def _apart(groups: DataFrame, key: str, fits) -> DataFrame:
    """Pairs ``(a, b)`` of members of one group of ``groups(key, id, class, main, ...)`` that are in different classes.
    Members outside the group's commonest class are paired with all others; that reaches every pair of classes."""
    x, y = groups.where("class <> main").alias("x"), groups.alias("y")
    on = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.class") != F.col("y.class")) & fits
    return x.join(y.hint("merge"), on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _divided(members: DataFrame, key: str) -> DataFrame:
    """The groups of ``members(key, id, class)`` that hold several classes: ``key``, ``main`` (the commonest class) and
    ``pairs``, an upper bound of the pairs that ``_apart`` has to look at."""
    per_class = members.groupBy(key, "class").agg(F.count("*").alias("n"))
    main = per_class.groupBy(key).agg(F.count("*").alias("classes"), F.sum("n").alias("all"), F.max(F.struct("n", F.negative("class").alias("c"))).alias("m")).where("classes > 1")
    return main.select(key, F.negative("m.c").alias("main"), ((F.col("all") - F.col("m.n")) * F.col("all")).alias("pairs"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per id: ``doc_id``, ``class_id`` (smallest id of its class), ``n_verified`` (links of its
    text that were verified on the way; copies and pairs already in one class are not compared), ``n_copies`` (ids with the
    same words, itself included).

    Rows without an id take no part. A text that is null, empty or without a word is a class of its own, with 0
    copies. Rows that share an id are one document, with the text of the least hash among those that have a word. Texts of fewer than
    five words have one run, all their words. An empty table gives an empty result; other columns are not used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "order-minhash")
    rows = sketches(docs, doc_id, text).groupBy("id").agg(F.min(F.struct("wordless", "hash", "digest", "sketch", "runs", "bits")).alias("s")).select("id", "s.digest", "s.sketch", "s.runs", "s.bits")
    base = scratch.save(rows, "sketches")
    reps = scratch.save(base.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch"), F.first("runs").alias("runs"), F.first("bits").alias("bits")), "representatives")
    members = reps.select(F.col("rep").alias("id"), F.explode("sketch").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = members.join(sizes.hint("merge"), "bucket").groupBy("id").agg(F.sum("n").alias("degree"), F.collect_list("bucket").alias("buckets"))  # COMPONENTS buckets at most
    buckets = scratch.save(shared.select("id", "degree", F.explode("buckets").alias("bucket")), "buckets")
    best = buckets.groupBy("bucket").agg(F.max(F.struct("degree", F.negative("id").alias("id"))).alias("lead"))
    first = buckets.join(best.hint("merge"), "bucket").groupBy("id").agg(F.negative(F.max("lead").getField("id")).alias("lead")).where("lead <> id")
    pairs = scratch.save(first.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")), "pairs")
    links = verified(scratch, pairs, docs, doc_id, text, threshold)
    classes = components(scratch, links)

    marked = lookup_join(buckets.select("bucket", "id"), classes, ["id"]).select("bucket", "id", F.coalesce("class_id", "id").alias("class"))
    marked = scratch.save(marked, "marked")
    divided = scratch.save(_divided(marked, "bucket"), "divided")
    still = lookup_join(marked, divided, ["bucket"], "inner")
    sized = reps.select(F.col("rep").alias("id"), "runs", "bits")
    few = scratch.save(still.where(F.col("pairs") <= BUCKET_PAIRS).join(sized.hint("merge"), "id"), "unresolved")
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(PARITIES)), F.lit(0))
    longer, shorter = F.greatest("x.runs", "y.runs"), F.least("x.runs", "y.runs")
    like = shorter >= longer * threshold - 1e-9
    # at the threshold, aligned runs are threshold / (1 + threshold) of both texts' runs; the others are in one text only
    most = (F.col("x.runs") + F.col("y.runs")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    rest = _apart(few, "bucket", like & (differ <= most))
    many = still.where(F.col("pairs") > BUCKET_PAIRS)
    if not divided.where(F.col("pairs") > BUCKET_PAIRS).isEmpty():
        members = many.select("id", "class").distinct().join(sized.select("id", "runs").hint("merge"), "id")
        rare = scratch.save(rare_runs(scratch, members, docs, doc_id, text, threshold), "rare")
        mixed = scratch.save(_divided(rare, "run"), "rare-divided")
        # what two texts have in common from their first common run on
        ahead = F.least(F.col("x.runs") - F.col("x.rank"), F.col("y.runs") - F.col("y.rank"))
        enough = ahead >= (F.col("x.runs") + F.col("y.runs")) * (threshold / (1 + threshold)) - 1e-6
        rest = rest.union(_apart(lookup_join(rare, mixed, ["run"], "inner"), "run", like & enough))
    rest = rest.distinct()
    more = verified(scratch, scratch.save(rest, "pairs"), docs, doc_id, text, threshold)
    everything = links.union(more)
    if not more.isEmpty():
        classes = components(scratch, everything)
    n_verified = everything.distinct().select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_verified"))
    info = reps.select("digest", "rep", "n_copies").join(classes.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").join(n_verified.hint("merge"), "rep", "left")
    info = scratch.save(info.select("digest", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"), "n_copies"), "classes")
    out = lookup_join(base.select("id", "digest"), info, ["digest"])
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are their class's smallest id, with their own columns. Rows without an id stay; of
    rows that share an id all stay or go together."""
    classes = near_duplicates(docs, doc_id, text, threshold)
    key = free_name(docs, "_gone")
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(key))
    n = gone.count()
    small = F.broadcast(gone) if n <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    return docs.join(small, F.col(doc_id).cast("long") == F.col(key), "left_anti")
