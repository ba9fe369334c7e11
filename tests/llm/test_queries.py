"""All queries of the subpackage on the smallest tables, and both SQLs, also over repeated and null rows."""

import os
import zlib

import duckdb
import pytest

from tidemark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def same(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        if not os.path.exists(f"{sf}/{t}.parquet"):
            continue
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf}/{t}.parquet') else ''}')")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert same(spark, name, SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    out = queries.QUERIES[name](spark, SF)
    rows = out.collect()
    assert rows
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.split("_")[0] in ("op1", "op6", "op7", "op8", "op10"):
        assert len(rows) == docs
    if "held_out" in out.columns:
        by, left = (3, 1) if name.startswith("op8") else (5, 0)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % by == left) for r in rows)


def test_line_dedup_over_repeated_and_null_rows(spark, tmp_path):
    rows = [(1, "menu\nbody\n\nfoot", "en", "a", 1)] * 7 + [(i, f"menu\nbody {i}", "en", "a", 1) for i in range(10, 16)] + [(None, "menu\nx", "en", None, 1)] * 6 + [(20, None, "en", "a", 0), (21, "", None, None, 0), (22, "y" * 200_000 + "\nmenu", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "menu body foot")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = same(spark, "op5_site_line_dedup", str(tmp_path))
    assert sum(r[0] == 1 and r[3] == 3 for r in got) == 7  # each row is a page: menu, body and foot go from all


def test_conversations_with_nulls_ties_and_copies(spark, tmp_path):
    said = ["Hi.", "Well", "", None, " \t", "Yes!  ", "a.b"]
    rows = [(c if c % 7 else None, t % 5 if (c + t) % 9 else None, ["system", "user", "assistant", "User", None, ""][(c * t + t) % 6], said[(c + 3 * t) % 7]) for c in range(40) for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert len(same(spark, "op11_conversation_audit", str(tmp_path))) == 35


def test_collocations_with_nulls_and_copies(spark, tmp_path):
    rows = [(i, ["New York City, new york", "New York", "in New\tYork!", None, "", "x"][i % 6], ["en", None, "und"][i % 3], None, 1) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, "op13_tiled_collocations", str(tmp_path))


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (3,)], "doc_id long")
    assert all(r[0] is not None for r in df.select(queries._held_out(3, 1)).collect())
    assert df.where("doc_id is null").select(queries._held_out(3, 1)).first()[0] is False
