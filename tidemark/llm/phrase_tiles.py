"""Phrase collocations: frequent runs of words, counted in tiles of pairs of ids that are numbered by frequency.

Texts are cut into batches of one language, each row a sequence of word numbers with -1 where a piece ends. One step then
does the work of every length: units of a batch (words first, later frequent phrases) get ids by falling frequency, pairs
of neighbouring ids are counted, and the frequent pairs are the next step's units. A phrase of m + 1 words is the pair of
its first and its last m words, and both must be frequent if it is, so nothing frequent is lost and only sequences of
frequent units are kept.

Pairs are counted by tiles of ``TILE`` x ``TILE`` ids. As ids are ranks, the pairs that occur most lie in few tiles: tiles
with many occurrences in a buffer are dense arrays for one ``bincount``, all others sorted coordinates. A task sends one
row for a pair and buffer, and Spark adds them up by pair, so a hot tile or pair is never gathered in one task.

Ids return to the batches from a table in each worker while the frequent units are few by count; beyond that by a join
on the distinct units of each batch, so nothing held in one place grows with the corpus. Either way gives the same ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _base
from tidemark.llm._base import Scratch, importable, lookup_join
from tidemark.operators.ranks import running_sums

#: Characters of a batch, and pairs of a buffer
BATCH_CHARS = 1_000_000
BUFFER_PAIRS = 500_000
#: Ids of a tile's side, tiles of a side that may be dense, and occurrences in a buffer that make a tile dense
TILE_BITS = 7
SIDE = 1024
DENSE = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _ENDS.copy()
_GAPS[list(b" \t")] = True


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers of texts with -1 between pieces, the distinct words and how often each occurs."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~_GAPS[data]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    limits = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(hi - lo, out=limits[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(limits), pa.py_buffer(data[inside].tobytes())])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32)
    piece = np.cumsum(_ENDS[data])[lo]
    new = np.flatnonzero(np.diff(piece)) + 1
    return np.insert(codes, new, -1), coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary))


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """``first << 32 | second`` of neighbouring ids, -1 where either is none."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), a << 32 | b, -1)


def closed(ids: np.ndarray) -> np.ndarray:
    """Ids with every run of -1 made one."""
    keep = ids >= 0
    keep[1:] |= ids[:-1] >= 0
    return ids[keep]


def count_pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their counts: dense tiles by one ``bincount``, the rest by sorting."""
    a, b = codes >> 32, codes & 0xFFFFFFFF
    ranked = (a < SIDE << TILE_BITS) & (b < SIDE << TILE_BITS)
    tile = np.where(ranked, (a >> TILE_BITS) * SIDE + (b >> TILE_BITS), SIDE * SIDE)
    dense = np.flatnonzero(np.bincount(tile, minlength=SIDE * SIDE + 1)[:-1] >= DENSE)
    slot = np.full(SIDE * SIDE + 1, -1, np.int64)
    slot[dense] = np.arange(len(dense))
    slot = slot[tile]
    rest, found = np.unique(codes[slot < 0], return_counts=True)
    if not len(dense):
        return rest, found
    inner, cells = (1 << TILE_BITS) - 1, 2 * TILE_BITS
    own = slot >= 0
    flat = np.bincount(slot[own] << cells | (a[own] & inner) << TILE_BITS | b[own] & inner)
    at = np.flatnonzero(flat)
    first = dense[at >> cells]
    i = (first // SIDE) << TILE_BITS | at >> TILE_BITS & inner
    j = (first % SIDE) << TILE_BITS | at & inner
    return np.append(i << 32 | j, rest), np.append(flat[at], found)


def _batches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``batch, lang, ids, words, counts``: texts of one language and task, about ``BATCH_CHARS`` at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            ids, words, counts = cut_words(held.pop(lang))
            del size[lang]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([lang]), pa.array([ids.tobytes()], pa.binary()),
                 pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                names=["batch", "lang", "ids", "words", "counts"],
            )

        for b in parts:
            texts = b.column(0)
            binary = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
            for t, lang in zip(texts.cast(binary).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(t)
                size[lang] = size.get(lang, 0) + len(t) + 1
                if size[lang] >= BATCH_CHARS:
                    yield flush(lang)
            while sum(size.values()) > 8 * BATCH_CHARS:
                yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return scratch.save(texts.mapInArrow(run, "batch long, lang string, ids binary, words array<string>, counts array<long>"), "batches")


def _counted(seq: DataFrame) -> DataFrame:
    """``lang, unit, f`` of all pairs of neighbouring ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, codes in held.items():
                unit, f = count_pairs(np.concatenate(codes))
                for at in range(0, len(unit), 1 << 18):
                    u, n = unit[at : at + (1 << 18)], f[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u, pa.int64()), pa.array(n, pa.int64())], names=["lang", "unit", "f"])
            held.clear()

        many = 0
        for b in parts:
            for lang, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = pairs_of(np.frombuffer(ids, np.int32))
                held.setdefault(lang, []).append(codes[codes >= 0])
                many += len(held[lang][-1])
                if many >= BUFFER_PAIRS:
                    yield from flush()
                    many = 0
        yield from flush()

    return seq.select("lang", "ids").mapInArrow(run, "lang string, unit long, f long").groupBy("lang", "unit").agg(F.sum("f").alias("f"))


def _units(seq: DataFrame) -> DataFrame:
    """``batch, lang, key, unit``: the distinct pairs of each batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for batch, lang, ids in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                u = np.unique(pairs_of(np.frombuffer(ids, np.int32)))
                u = u[u >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), batch)), pa.array([lang] * len(u), pa.string()), pa.array(u, pa.int64())], names=["batch", "lang", "unit"])

    return seq.select("batch", "lang", "ids").mapInArrow(run, "batch long, lang string, unit long").withColumn("key", F.col("unit"))


def _ids_row(batch, lang, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch, lang, pa.array([closed(ids.astype(np.int32)).tobytes()], pa.binary())], names=["batch", "lang", "ids"])


def _from_table(seq: DataFrame, frequent: DataFrame, pairs: bool) -> DataFrame:
    """``batch, lang, ids`` with the ids of frequent units, a few, which go to every worker."""
    known = {}
    table = frequent.select("lang", "unit", "id").toArrow()
    for lang in table.column("lang").unique().to_pylist():
        own = table.filter(pc.equal(table.column("lang"), lang)).sort_by("unit" if pairs else "id")
        known[lang] = (own.column("unit").combine_chunks(), own.column("id").to_numpy())
    sent = seq.sparkSession.sparkContext.broadcast(known)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for k in range(b.num_rows):
                batch, lang = b.column(0).slice(k, 1), b.column(1).slice(k, 1)
                if lang[0].as_py() not in sent.value:
                    continue
                unit, new = sent.value[lang[0].as_py()]
                own = np.frombuffer(b.column(2)[k].as_py(), np.int32)
                if pairs:
                    key, own = unit.to_numpy(), pairs_of(own)
                    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                    yield _ids_row(batch, lang, np.where(key[at] == own, new[at], -1))
                else:
                    at = pc.index_in(b.column(3)[k].values, value_set=unit).fill_null(-1).to_numpy()
                    ids = np.append(np.where(at >= 0, new[at], -1), -1)  # the last is that of a piece's end
                    yield _ids_row(batch, lang, ids[own])

    columns = ["batch", "lang", "ids"] if pairs else ["batch", "lang", "ids", "words"]
    return seq.select(*columns).mapInArrow(run, "batch long, lang string, ids binary")


def _renumbered(seq: DataFrame, units: DataFrame, frequent: DataFrame, pairs: bool) -> DataFrame:
    if _base.fits_broadcast(frequent.select("lang", "unit", "id")):
        return _from_table(seq, frequent, pairs)
    return _from_join(seq, units, frequent, pairs)


def _from_join(seq: DataFrame, units: DataFrame, frequent: DataFrame, pairs: bool) -> DataFrame:
    """``batch, lang, ids`` with the ids of frequent units, which ``units(batch, lang, key, unit)`` name by their key in a
    batch. Batches without any are left out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            batch, lang, ids, known = (b.column(k) for k in range(4))
            for k in range(b.num_rows):
                own = np.frombuffer(ids[k].as_py(), np.int32)
                own = pairs_of(own) if pairs else own.astype(np.int64)
                table = known[k].values
                key, new = table.field(0).to_numpy(), table.field(1).to_numpy()
                order = np.argsort(key)
                key, new = key[order], new[order]
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                yield _ids_row(batch.slice(k, 1), lang.slice(k, 1), np.where(key[at] == own, new[at], -1))

    known = lookup_join(units, frequent.select("lang", "unit", "id"), ["lang", "unit"], "inner")
    known = known.groupBy("batch").agg(F.collect_list(F.struct("key", "id")).alias("known"))
    both = seq.select("batch", "lang", "ids").join(known.hint("merge"), "batch").select("batch", "lang", "ids", "known")
    return both.mapInArrow(run, "batch long, lang string, ids binary")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, scratch: Scratch | None = None) -> tuple[list[DataFrame], DataFrame]:
    """For each number of words from 1 to ``longest`` the phrases with at least ``least`` occurrences, and ``lang, n``.

    Rows ``lang, id, f, phrase, last, heads, tails, first_id, last_id``: ``heads[k]`` and ``tails[k]`` are the occurrences
    of the first and last k + 1 words; ``first_id`` and ``last_id`` name the phrases of all words but the last and
    but the first, in the table before.
    """
    importable(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "phrases")

    def ranked(counts: DataFrame) -> DataFrame:
        found = counts.where(F.col("f") >= least).withColumn("_less", -F.col("f"))
        out = running_sums(found, ["lang"], ["_less", "unit"], {"id": F.lit(1).cast("long")})
        return out.select("lang", "unit", "f", F.expr("if(id < 2147483647, id, raise_error('too many frequent phrases'))").cast("int").alias("id"))

    batches = _batches(docs, scratch)
    each = batches.select("batch", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("key", "w")).select("batch", "lang", F.col("key").cast("long").alias("key"), F.col("w.words").alias("unit"), F.col("w.counts").alias("f"))
    totals = scratch.save(batches.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n")), "totals")
    frequent = scratch.save(ranked(each.groupBy("lang", "unit").agg(F.sum("f").alias("f"))), "words")
    one = frequent.select("lang", "id", "f", F.col("unit").alias("phrase"), F.col("unit").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels = [scratch.save(one.withColumns({"first_id": F.lit(None).cast("int"), "last_id": F.lit(None).cast("int")}), "phrases1")]
    seq = scratch.save(_renumbered(batches, each.drop("f"), frequent, pairs=False), "ids1")
    scratch.drop(batches)
    for m in range(2, longest + 1):
        frequent = scratch.save(ranked(_counted(seq)), f"pairs{m}")
        before = levels[-1]
        halves = frequent.withColumns({"first_id": F.shiftright("unit", 32).cast("int"), "last_id": F.expr("unit & 4294967295").cast("int")})
        left = before.select("lang", F.col("id").alias("first_id"), F.col("phrase").alias("_p"), F.col("heads").alias("_h"))
        right = before.select("lang", F.col("id").alias("last_id"), F.col("last").alias("last"), F.col("tails").alias("_t"))
        joined = lookup_join(lookup_join(halves, left, ["lang", "first_id"], "inner"), right, ["lang", "last_id"], "inner")
        made = joined.select("lang", "id", "f", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", F.concat("_h", F.array("f")).alias("heads"), F.concat("_t", F.array("f")).alias("tails"), "first_id", "last_id")
        levels.append(scratch.save(made, f"phrases{m}"))
        if m < longest:
            new = scratch.save(_renumbered(seq, _units(seq), frequent, pairs=True), f"ids{m}")
            scratch.drop(seq)
            seq = new
    return levels, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words by their least score over all cuts in two.

    Rows ``lang, rank, phrase, a, l, r, n, score`` with exact integers: ``score = floor(1000 a n / (l r))`` of the cut with
    the lowest one (ties: the shorter first part), products in decimals of 38 digits. A phrase that lies in a longer
    frequent one of no fewer occurrences is left out; it then lies in one that is a word longer, as occurrences never
    grow with the length, so its neighbours in the next table decide.

    Null texts are empty, null languages ``und``; words are case-folded for A-Z alone; repeated rows and rows of any id
    count, other columns of ``docs`` are not used. Ties of score and ``a`` are in order of the phrase's bytes. A text of any
    length is one row of a batch. An empty table gives an empty result.
    """
    levels, totals = frequent_phrases(docs, least, longest)
    kept = []
    for m in range(2, longest + 1):
        now = levels[m - 1]
        if m < longest:
            longer = levels[m].select("lang", F.explode(F.array("first_id", "last_id")).alias("id"), F.col("f").alias("_f"))
            best = longer.groupBy("lang", "id").agg(F.max("_f").alias("_f"))
            now = now.join(best.hint("merge"), ["lang", "id"], "left").where("_f is null or _f < f")
        kept.append(now.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails"))
    found = kept[0]
    for x in kept[1:]:
        found = found.union(x)
    cuts = """array_min(transform(sequence(1, size(heads) - 1), k -> named_struct(
        'score', (cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(heads[k - 1] as decimal(19, 0)) * cast(tails[size(heads) - k - 1] as decimal(19, 0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k - 1])))"""
    scored = lookup_join(found, totals, ["lang"], "inner").withColumn("c", F.expr(cuts))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return scored.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
