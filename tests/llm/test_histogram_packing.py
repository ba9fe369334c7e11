"""Plans over histograms, and whole documents against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.histogram_packing import Plan, pack_documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_gapless_and_full(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 64): rng.randrange(1, 400) for _ in range(rng.randrange(1, 40))}
    plan = Plan(histogram, 64)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(k) for k in histogram.values()])
    packs, whole = {}, np.zeros(len(length), np.int64)
    for rows, begin, size, sequence, offset in plan.places(length, rank):
        assert (begin == whole[rows]).all()
        whole[rows] += size
        for s, o, n in zip(sequence.tolist(), offset.tolist(), size.tolist(), strict=True):
            packs.setdefault(s, []).append((o, n))
    assert (whole == length).all()
    fills = []
    for pieces in packs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        fills.append(at)
    total = int(length.sum())
    assert sorted(packs) == list(range(plan.n_sequences)) and fills.count(64) == total // 64
    short = [f for f in fills if f < 64]
    assert sum(short) == total % 64 and all(f & (f - 1) == 0 for f in short) and len(set(short)) == len(short)


def test_the_plan_does_not_grow_with_the_documents():
    rng = random.Random(1)
    histogram = {n: rng.randrange(1, 50) for n in range(1, 4096)}
    small, large = Plan(histogram, 4096), Plan({n: 10_000 * k for n, k in histogram.items()}, 4096)
    assert len(large.key) < 2 * len(small.key) + 100 and large.n_sequences > 9_000 * small.n_sequences


def packed(df):
    return [r.asDict() for r in pack_documents(df, TOKENIZER, 49_408).collect()]


def test_documents_equal_the_library(spark):
    rng = random.Random(2)
    words = ["of", "The", "strange", "New", "tide,", "mark.", "42", "été", "Straße"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 300, 2000, 9000]))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (None, "no id", "x"), (7, texts[7], "x")]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(5))
    lib = Tokenizer.from_file(TOKENIZER)
    ids = {d: np.array([*(lib.encode(t, add_special_tokens=False).ids if t else []), 2], "<u4") for d, t, _ in rows}
    covered, packs = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and 0 < r["length"] <= 4096
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {d: len(x) * (2 if d == 7 else 1) for d, x in ids.items()}
    total = sum(covered.values())
    fills = []
    for pieces in packs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        fills.append(at)
    assert fills.count(4096) == total // 4096 and all(f & (f - 1) == 0 for f in fills) and len(packs) == max(packs) + 1


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string")) == []
