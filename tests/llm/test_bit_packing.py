"""Packed ids: part-wise encoding against the library, small caches and chunks, segments, repeated and null ids."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bit_packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def random_texts(n, most):
    r = random.Random(1)
    pieces = [*"abstmdrevl'' \n\t'.,_-!?019AZÀéßñ¿ŐłǅȺƁɏƛ¡«·ªº²İ日", "'re", "'ll", "don't", "can't've", " the ", "''s", "'s's"]
    return ["".join(r.choice(pieces) for _ in range(r.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("chunk, limit", [(1_000_000, 48_000_000), (61, 48_000_000), (400, 3_000)])
def test_parts_equal_the_library(lib, monkeypatch, chunk, limit):
    monkeypatch.setattr(bit_packing.PieceTokenizer, "CHUNK", chunk)
    monkeypatch.setattr(bit_packing.PartCache, "LIMIT", limit)  # at the least limit far fewer parts than the texts hold
    tok = bit_packing.PieceTokenizer(PATH, 1)
    assert tok.by_part
    texts = [*random_texts(3000, 60), None, "", "x" * 700, "word " * 500]
    for lo in range(0, len(texts), 250):
        for t, ids in zip(texts[lo : lo + 250], tok.encode(texts[lo : lo + 250]), strict=True):
            assert ids.tolist() == [*lib.encode(t or "", add_special_tokens=False).ids, 1], t
    assert tok.kept.made < tok.kept.asked
    if limit < 10_000:
        assert len(tok.kept.young) < 40 and len(tok.kept.old) < 40


def test_cache_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(bit_packing.PartCache, "LIMIT", 2_000)
    c, made = bit_packing.PartCache(), []

    def make(parts):
        made.extend(parts)
        return [p.encode() for p in parts]

    for i in range(300):
        assert c.get(["hot", f"rare{i}"], make) == [b"hot", f"rare{i}".encode()]
    assert made.count("hot") == 1 and len(made) == 301


def test_equal_digests_of_different_parts_are_told_apart(lib, monkeypatch):
    monkeypatch.setattr(bit_packing, "mix", lambda x: np.zeros_like(x))  # every part collides with those of its length
    t = "one two six ten it's the end of the day"
    assert bit_packing.PieceTokenizer(PATH, 1).encode([t])[0].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1]


def test_segments_repeated_null_and_missing_ids(spark, lib, tmp_path, monkeypatch):
    monkeypatch.setattr(bit_packing, "SEGMENT_CHARS", 200)
    rows = [(i // 2, t) for i, t in enumerate(random_texts(300, 40))] + [(None, "one two"), (None, "one two"), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, DOC).withColumn("start", F.lit("clash")).withColumn("shard", F.lit(1.5))
    bit_packing.write_ids(df, f"file://{tmp_path}/ids", PATH, 49_408, shards=3)
    files = spark.read.parquet(f"file://{tmp_path}/ids")
    assert files.agg(F.max("segment")).first()[0] > 3
    got = sorted((x["start"], x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in bit_packing.read_ids(spark, f"file://{tmp_path}/ids").collect() if x["doc_id"] is not None)
    nulls = sorted((x["n_tokens"], x["ids_crc32"]) for x in bit_packing.read_ids(spark, f"file://{tmp_path}/ids").where("doc_id is null").collect())
    crc = lambda t: ((ids := [*lib.encode(t or "", add_special_tokens=False).ids, 1]) and len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((d, *crc(t)) for d, t in rows if d is not None) == sorted(x[1:] for x in got)
    assert nulls == sorted(crc(t) for d, t in rows if d is None)
    assert [x[1] for x in got] == sorted(x[1] for x in got)
    at = sum(n for n, _ in nulls)  # null ids come first
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_empty_table(spark, tmp_path):
    bit_packing.write_ids(spark.createDataFrame([], DOC), f"file://{tmp_path}/ids", PATH, 49_408)
    assert bit_packing.read_ids(spark, f"file://{tmp_path}/ids").collect() == []
