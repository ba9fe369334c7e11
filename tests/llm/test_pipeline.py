"""The pipeline's stages on small tables, against brute force."""

import random

import pytest
from tests.llm.test_order_minhash import brute_runs, brute_similarity, brute_words, classes
from tidemark.llm import queries


def corpus(tmp_path, spark):
    r = random.Random(11)
    rows = []
    for i in range(240):
        w = [f"w{r.randrange(500)}" for _ in range(r.choice([30, 80, 200]))]
        text = "site menu here\n" + " ".join(w)
        if i % 12 == 0:
            text = "\n".join(" ".join(x.upper() + "!!" for x in line.split()) for line in text.split("\n"))
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    for i in range(240, 270):
        rows.append((i, rows[i - 239][1] + (" extra" if i % 2 else ""), "en", "src1", 1))
    bench = [(k, " ".join(f"b{k}x{j}" for j in range(14))) for k in range(5)]
    for i in range(270, 276):
        rows.append((i, "site menu here\nalpha beta " + bench[i % 5][1] + " gamma", "en", "src2", 1))
    rows += [(276, None, "en", "src0", None), (277, "", None, None, 0), (278, "short", "en", "src0", 5), (278, "short", "en", "src0", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 12 != 0), 0) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return f"{tmp_path}"


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    out = {}
    for k, (name, stage) in enumerate(p.STAGES):
        df = stage(spark, docs, sf)
        assert k == len(p.STAGES) - 1 or df.columns == columns
        df.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        out[name] = docs.collect()
    ids = lambda n: {r["doc_id"] for r in out[n]}
    assert not any(i % 12 == 0 for i in ids("quality") if i < 240) and len([i for i in ids("quality") if 0 < i < 240]) == 220
    assert all("site menu here" not in (r["text"] or "") for r in out["line_dedup"]) and len(out["line_dedup"]) == len(out["quality"])
    before = {r["doc_id"]: r["text"] for r in out["line_dedup"]}
    runs = {i: brute_runs(t) for i, t in before.items()}
    near = [(a, b) for a in before for b in before if a < b and runs[a] and (brute_words(before[a]) == brute_words(before[b]) or (abs(len(runs[a]) - len(runs[b])) < 60 and set(runs[a]) & set(runs[b]) and brute_similarity(runs[a], runs[b]) >= 0.8))]
    assert ids("near_dedup") == set(classes(near, before).values())
    assert ids("near_dedup") - ids("decontaminate") == {i for i in ids("near_dedup") if 270 <= i < 276}
    assert ids("packing") == ids("decontaminate")
    assert p.run(spark, sf).count() == len(out["packing"])


def test_tables_of_others_stay(spark):
    import threading

    from tidemark.llm._base import Scratch, own_tables

    outside, late, done = Scratch(spark, "t").save(spark.range(3), "a"), threading.Event(), threading.Event()
    other = {}

    def beside():
        late.wait(60)
        other["t"] = Scratch(spark, "t").save(spark.range(4), "b")
        done.set()

    thread = threading.Thread(target=beside)
    thread.start()
    with own_tables(spark):
        mine = Scratch(spark, "t").save(spark.range(5), "c")
        late.set()
        done.wait(60)
        with own_tables(spark):
            inner = Scratch(spark, "t").save(spark.range(6), "d")
        assert mine.count() == 5
    thread.join()
    assert outside.count() == 3 and other["t"].count() == 4
    for gone in (mine, inner):
        with pytest.raises(Exception, match="(?i)not.*exist|not found"):
            spark.read.parquet(gone._scratch_path).count()


def test_names():
    assert [f"op{n}" for n in range(1, 14)] == sorted({k.split("_")[0] for k in queries.QUERIES}, key=lambda k: int(k[2:]))


def test_columns_of_any_name_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    sf = corpus(tmp_path, spark)
    own = {"predicted": "mine", "P_good": "mine", "n_lines": "mine", "n_dropped": "mine", "_h": "mine", "_lines": "mine", "_site": "mine", "_gone": "mine", "items": "mine", "hit_spans": "mine", "bin_id": "mine"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60 or doc_id >= 240").withColumns({k: F.lit(v) for k, v in own.items()})
    for k, (name, stage) in enumerate(p.STAGES):
        assert stage(spark, docs.limit(0), sf).collect() == [], name
        out = stage(spark, docs, sf)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
            assert all(r[c] == "mine" for r in out.collect() for c in own), name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert out.count()
