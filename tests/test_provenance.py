"""Line numbers over splits, strict reading, numbers in JSON, and chains of artifacts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.lineage import ends_of_chains
from tidemark.sources import strict as X
from tidemark.sources import text as T


def test_numbers_of_lines_over_many_splits(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    files = {"a.txt": [f"line {i} " + "x" * (i % 50) for i in range(5000)], "deep/b.txt": ["only"], "deep/c.txt": [f"é {i}" for i in range(900)], "d.txt": ["", "second", ""]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        rows = T.numbered_lines(spark, str(tmp_path))
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, lines in files.items():
        own = sorted((r["line_no"], r["line"]) for r in got if r["file"].endswith("/" + name))
        assert own == list(enumerate(lines, 1))
    assert len(got) == sum(map(len, files.values()))


def test_strict_names_the_row_in_one_scan(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(40)] + [(99, 7), (100, None)], "id long, v int")
    rules = {"v known": F.col("v").isNotNull(), "v in range": F.col("v") < 5}
    with pytest.raises(Exception, match="v in range: id = 99"):
        X.required(df.where("id <> 100"), rules, "id").collect()
    with pytest.raises(Exception, match="v known: id = 100"):
        X.required(df.where("id <> 99"), rules, "id").collect()
    good = X.required(df.where("id < 50"), rules, "id")
    assert good.count() == 40 and good.schema == df.schema
    assert {(r["id"], r["reason"]) for r in X.parted(df, rules).collect() if r["reason"]} == {(99, "v in range"), (100, "v known")}


def test_a_floor_is_judged_while_writing(spark):
    left, right = spark.range(100).withColumn("a", F.col("id") * 2), spark.range(90).withColumn("b", F.col("id") + 1)
    rows = X.joined_above(left, right, "id", 0.9)
    assert rows.count() == 90 and set(rows.columns) == {"id", "a", "b"}
    with pytest.raises(X.Refused, match="90 of 100 rows matched on id, under 0.95; without a match: 90"):
        X.joined_above(left, right, "id", 0.95)
    assert X.joined_above(left.limit(0), right, "id", 0.95).count() == 0


def plain_leaves(v, path="$"):
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in plain_leaves(w, f"{path}.{k}")]
    if isinstance(v, list):
        return [x for i, w in enumerate(v) for x in plain_leaves(w, f"{path}[{i}]")]
    return [(path, float(v))] if isinstance(v, (int, float)) and not isinstance(v, bool) else []


def test_numbers_at_any_depth(spark):
    texts = [{"a": 1, "b": [1.5, "2", None, True, {"c": [[-3e-7], []]}]}, [], {}, 7, "x", None, [[[[[[8]]]]]], {"big": 12345678901234, "x y": {"z": 0.1}}]
    rows = [(i, json.dumps(t)) for i, t in enumerate(texts)] + [(50, "{broken"), (51, None)]
    got = T.numeric_leaves(spark.createDataFrame(rows, "key long, doc string"), "key", "doc").collect()
    want = [(i, p, v) for i, t in enumerate(texts) for p, v in plain_leaves(t)]
    assert sorted((r["key"], r["path"], r["num"]) for r in got) == sorted(want)
    with pytest.raises(ValueError, match="deeper"):
        T.numeric_leaves(spark.createDataFrame([(1, "[" * 6 + "]" * 6)], "id long, doc string"), "id", "doc", deepest=3)


def test_chains_cycles_and_dangling_names(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("c37", None)]
    loop = [("x", "y"), ("y", "z"), ("z", "x"), ("to_loop", "x"), ("self", "self")]
    lost = [("p", "q"), ("q", "nobody")]
    got = {r["name"]: (r["last"], r["hops"], r["fault"]) for r in ends_of_chains(spark.createDataFrame(chain + loop + lost + [("alone", None)], "name string, superseded_by string")).collect()}
    assert all(got[f"c{i}"] == ("c37", 37 - i, None) for i in range(38)) and got["alone"] == ("alone", 0, None)
    assert all(got[n] == (None, None, "cycle") for n in ("x", "y", "z", "to_loop", "self"))
    assert got["p"] == ("nobody", 2, "dangling") and got["q"] == ("nobody", 1, "dangling")
    assert ends_of_chains(spark.createDataFrame([], "name string, superseded_by string")).collect() == []


def test_levels_of_json_are_taken_apart_in_one_pass(spark, monkeypatch):
    deep = 5
    for i in range(20):
        deep = [deep, [], {}] if i % 2 else {"a": deep, "e": [], "o": {}, "n": None}
    texts = [{"order": {"total": 1.5, "items": [{"n": 1, "flags": ["R", 2.5, [0.1, True, None]]}]}}, deep, [[[[[[[[]]]]]]]], [[[[[[[[7]]]]]]]]]
    count, plain = [], T.written
    monkeypatch.setattr(T, "written", lambda df: count.append(1) or plain(df))
    for i, t in enumerate(texts):
        count.clear()
        got = T.numeric_leaves(spark.createDataFrame([(i, json.dumps(t))], "key long, doc string"), "key", "doc")
        assert sorted((r["path"], r["num"]) for r in got.collect()) == sorted(plain_leaves(t))
        assert len(count) == (3 if i == 1 else 1)
    one = lambda text, deepest: T.numeric_leaves(spark.createDataFrame([(1, text)], "id long, doc string"), "id", "doc", deepest)
    assert one("[[1], 2]", 3).count() == 2 and one("4", 1).count() == 1
    for text, deepest in (("[[[1]]]", 3), ("[[[]]]", 3), ("[]", 1)):
        with pytest.raises(ValueError, match="deeper"):
            one(text, deepest)
