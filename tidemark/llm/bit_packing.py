"""Token-id output: fixed-width bit packing with block offsets.

A vocabulary of V ids needs ``bits = max(1, ceil(log2 V))`` bits an id. Documents are dealt in ranges of doc_id to
shards; a shard is a run of segments, each one self-contained byte string:

    magic ``TKB1`` | bits u32 | documents u32 | blocks u32 | ids u64
    document limits: documents + 1 x u64, numbers of ids
    block offsets:   blocks + 1 x u64, bytes from the begin of the payload
    payload: blocks of ``BLOCK_IDS`` ids; id j of a block is in the bits ``j * bits .. (j + 1) * bits`` of its bytes,
    lowest bit first; each block begins on a byte

so that ids ``a..b`` are read by unpacking only the blocks that hold them. Segments are written by Spark, as rows
``(shard, segment, first_id, n_ids, doc_ids, bytes)`` of Parquet files: that reaches every store that Spark reaches, and
a lost executor's shard is written again whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._base import BROADCAST_ROWS, importable, shuffle_width
from tidemark.llm._words import chunks, mix

BLOCK_IDS = 4096
SEGMENT_CHARS = 4_000_000
_HEAD = struct.Struct("<4sIIIQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit-pack ids, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of bit-packed bytes."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(data, "<u4", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_segment(docs: list[np.ndarray], bits: int) -> bytes:
    limits = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype("<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    return b"".join((_HEAD.pack(b"TKB1", bits, len(docs), len(blocks), len(ids)), limits.tobytes(), offsets.tobytes(), *blocks))


class Segment:
    """Reader of one segment."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n_docs, self.n_blocks, self.n_ids = _HEAD.unpack_from(data)
        if magic != b"TKB1":
            raise ValueError("not a segment")
        at = _HEAD.size
        self.limits = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(data, "<u8", self.n_blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (self.n_blocks + 1) :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of the segment; only their blocks are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        parts = [unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(BLOCK_IDS, self.n_ids - b * BLOCK_IDS), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]

    def doc(self, d: int) -> np.ndarray:
        return self.ids(int(self.limits[d]), int(self.limits[d + 1]))


class PartCache:
    """Ids of parts, as bytes by part, in two generations of at most ``LIMIT`` bytes each.

    A part found in the old generation moves to the young one; when that is full it becomes the old one. So parts in
    use stay, whatever the number of parts seen, and none is ever encoded again just because others filled the cache.
    """

    LIMIT = 48_000_000
    ENTRY = 160  # bytes of an entry besides its characters and ids

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = self.asked = self.made = 0

    def put(self, part: str, ids: bytes) -> None:
        if self.size > self.LIMIT:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[part] = ids
        self.size += self.ENTRY + len(part) + len(ids)

    def get(self, parts: list[str], make) -> list[bytes]:
        """Ids of distinct parts; ``make(parts)`` gives those of unknown ones."""
        found = list(map(self.young.get, parts))
        fresh = []
        for i, x in enumerate(found):
            if x is None:
                if (x := self.old.get(parts[i])) is None:
                    fresh.append(i)
                else:
                    found[i] = x
                    self.put(parts[i], x)
        self.asked, self.made = self.asked + len(parts), self.made + len(fresh)
        for i, x in zip(fresh, make([parts[i] for i in fresh]) if fresh else (), strict=True):
            found[i] = x
            self.put(parts[i], x)
        return found


class PieceTokenizer:
    """A tokenizers-library file applied to whole texts, each distinct part of a chunk of them looked up once.

    Files that split a text by the pattern ``contractions | letters | one digit | other`` and encode every part for
    itself give the same ids if each distinct part is encoded once. Texts of characters below U+0250, whose classes
    and lower case are the same in Python and in the library, are cut into parts with numpy; all others, and files of
    another kind, go through the library whole.
    """

    CHUNK = 1_000_000  # characters cut into parts at once
    JOINED = 500  # unknown parts encoded as one text, a blank between them

    def __init__(self, path: str, end_id: int):
        import json
        import os
        import re
        import unicodedata

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [str(p.get("pattern", {}).get("Regex")) for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_part = kinds == ["NFC", "Replace", "Lowercase"] and splits[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
        # superscripts and fractions, the dotted capital I and the capitals whose small letters lie elsewhere go whole
        self.odd = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]|<\|")
        kind = {"L": 1, "N": 2}
        self.kind = np.array([0 if chr(c).isspace() else kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x300)], np.uint8)
        self.end, self.kept = np.uint32(end_id), PartCache()
        self.power = np.full(self.CHUNK, 0x9E3779B97F4A7C15, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.back = np.full(self.CHUNK, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts. Blanks between parts are dropped by the split, and each part is a word of the joined text."""
        out: list[bytes] = []
        groups = [parts[i : i + self.JOINED] for i in range(0, len(parts), self.JOINED)]
        for group, e in zip(groups, self.lib.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            word, ids = np.array(e.word_ids, np.int64), np.array(e.ids, "<u4")
            if not len(word) or int(word[-1]) + 1 != len(group) or (np.diff(word) < 0).any():
                out += [x.astype("<u4").tobytes() for x in self._whole(group)]
                continue
            raw, at = ids.tobytes(), (4 * np.searchsorted(word, np.arange(len(group) + 1))).tolist()
            out += [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def _cut(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the parts of lower-cased characters."""
        kind = np.append(self.kind[code], np.uint8(0))
        before = np.append(np.uint8(0), kind[:-1])
        begin = (kind != 0) & ((kind != before) | (kind == 2))
        mark = np.flatnonzero(begin[:-1] & (code == 39))
        if len(mark):  # contractions
            far = np.append(code, [0, 0])
            one, two = far[mark + 1], far[mark + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            begin[mark[short | long] + 1] = False
            after = np.append(mark[short] + 2, mark[long] + 3)
            begin[after] = kind[after] != 0
        edge = np.flatnonzero(begin | (kind == 0) & (before != 0))
        first = begin[edge]
        return edge[first], np.append(edge[1:], len(code))[first]

    def _chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a lower-cased text without surrogates, the begin of each part, and how many ids each has."""
        code = np.frombuffer(text.encode("utf-16-le"), "<u2")
        lo, hi = self._cut(code)
        if not len(lo):
            return np.zeros(0, np.uint32), lo, lo
        if len(code) > self.CHUNK:  # a text without blanks that long: no table of powers for it
            which, first = np.arange(len(lo)), np.arange(len(lo))
        else:
            total = np.append(np.uint64(0), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.power[: len(code)]))
            digest = mix((total[hi] - total[lo]) * self.back[lo]) + (hi - lo).astype(np.uint64)
            which, seen = pd.factorize(digest)
            first = np.zeros(len(seen), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            # parts of one digest must be equal, character by character
            size = hi - lo
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            if not np.array_equal(size, size[first[which]]) or not np.array_equal(code[np.repeat(lo, size) + place], code[np.repeat(lo[first[which]], size) + place]):
                which, first = np.arange(len(lo)), np.arange(len(lo))
        made = self.kept.get([text[a:b] for a, b in zip(lo[first].tolist(), hi[first].tolist(), strict=True)], self._parts)
        pool, count = np.frombuffer(b"".join(made), "<u4"), np.array([len(x) // 4 for x in made])
        begin = (np.cumsum(count) - count)[which]
        per = count[which]
        ids = pool[np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]
        return ids, lo, per

    def _by_parts(self, texts: list[str]) -> list[np.ndarray]:
        low = "\n".join(texts).lower()
        limits = np.cumsum([len(t) + 1 for t in texts])  # lower case has as many characters here
        ids, counts = [], []
        at = 0
        while at < len(low):
            end = at + self.CHUNK
            if end < len(low):  # a part never holds white space, so a chunk may end at any
                back = max(low.rfind(" ", at, end), low.rfind("\n", at, end))
                if back <= at:
                    ahead = [x for x in (low.find(" ", end), low.find("\n", end)) if x >= 0]
                    back = min(ahead, default=len(low))
                end = back + 1
            got, lo, per = self._chunk(low[at:end])
            ids.append(got)
            counts.append((lo + at, per))
            at = end
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        lo, per = (np.concatenate([c[k] for c in counts]) if counts else np.zeros(0, np.int64) for k in (0, 1))
        upto = np.append(0, np.cumsum(per))[np.searchsorted(lo, limits)]
        return np.split(flat, upto[:-1]) if len(texts) else []

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text (null: empty), with the end id."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        plain, whole = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self.by_part and not self.odd.search(t) else whole).append(i)
        for at, made in ((whole, self._whole([texts[i] for i in whole])), (plain, self._by_parts([texts[i] for i in plain]))):
            for i, ids in zip(at, made, strict=True):
                out[i] = ids
        return [np.append(x, self.end) for x in out]


_TOKENIZERS: dict = {}


def _tokenizer(path: str, end_id: int) -> PieceTokenizer:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = PieceTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


def write_ids(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Encode every text and write the ids, documents in ascending doc_id order over the shards.

    A null or empty text has the end id alone. Null doc_ids come first; rows of one doc_id are ordered by their text's
    hash, repeated rows are all written. Other columns of ``docs`` are not used. An empty table writes no segment.
    """
    spark = docs.sparkSession
    importable(spark)
    bits, n = bits_for(vocabulary), shards or shuffle_width(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        tok, first, segment = _tokenizer(tokenizer, end_id), 0, 0
        for pdf in frames:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for lo, hi in chunks(texts, SEGMENT_CHARS):
                made = tok.encode(texts[lo:hi])
                n_ids = int(sum(map(len, made)))
                yield pd.DataFrame({"shard": [shard], "segment": [segment], "first_id": [first], "n_ids": [n_ids], "doc_ids": [[None if pd.isna(x) else int(x) for x in ids[lo:hi]]], "bytes": [encode_segment(made, bits)]})
                first, segment = first + n_ids, segment + 1

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = base.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    order.mapInPandas(run, "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, bytes binary").write.parquet(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, segment.

    Shard totals are one row for each task that wrote; they are summed up in one small window.
    """
    from pyspark.sql import Window

    importable(spark)
    files = spark.read.schema("shard int, segment int, first_id long, n_ids long, doc_ids array<long>, bytes binary").parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    starts = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("shard_start"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                seg = Segment(r.bytes)
                raw = seg.ids().astype("<u4").tobytes()
                view, lim = memoryview(raw), seg.limits
                yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "start": r.shard_start + r.first_id + lim[:-1], "n_tokens": np.diff(lim), "ids_crc32": [zlib.crc32(view[4 * lim[d] : 4 * lim[d + 1]]) for d in range(seg.n_docs)], "shard": r.shard, "segment": r.segment})

    n_shards = totals.count()  # as many as tasks that wrote
    joined = files.join(F.broadcast(starts) if n_shards <= BROADCAST_ROWS else starts.hint("shuffle_hash"), "shard")
    return joined.select("shard", "segment", "first_id", "doc_ids", "bytes", "shard_start").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int")
