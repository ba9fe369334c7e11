"""Operators on small hand-made tables: planted effects, causality, edges."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import inference as N
from tidemark.operators import joins as J
from tidemark.operators import series as S
from tidemark.plans import windows_queries as W
from tidemark.sources import ingest as I


def table(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, i long, v double")


def column(df, name="y"):
    return [r[name] for r in df.orderBy("i").collect()]


def test_lenient_line_with_inner_quotes(spark):
    line = '"345140","5"ok, hey"",plain,,"b,c","last"'
    got = spark.createDataFrame([(line,)], "line string").select(I.split_lenient(F.col("line")).alias("f")).first()["f"]
    assert got == ["345140", '5"ok, hey"', "plain", "", "b,c", "last"]


def test_ledger_counts_every_reject(spark):
    rows = spark.createDataFrame([(1, '"1","x"'), (2, '"1"'), (3, '"a","x"'), (4, '"2",""')], "line_no long, line string")
    out = I.read_lenient(rows, ["n", "s"], {"n": "bigint"}, ["s"])
    assert {r["line_no"]: r["reason"] for r in out.collect()} == {1: None, 2: "malformed_width", 3: "cast_n", 4: "empty_s"}
    assert sum(r["n"] for r in I.ledger(out).collect()) == 3


def test_xml_tiers_inherit_participant(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<COLLECTION><SEGMENT-TIER PARTICIPANT="'ann'"><UTTERANCE ID="u1" START_FRAME="36" END_FRAME="221"><NON-MANUAL LABEL="brows" VALUE="'raised'" START="40" END="60"/><NON-MANUAL LABEL="head" VALUE="shake" START="41" END="99"/></UTTERANCE></SEGMENT-TIER></COLLECTION>""")
    rows = I.read_xml_tiers(spark, str(tmp_path)).orderBy("label").collect()
    assert [(r["participant"], r["utterance"], r["label"], r["value"], r["lo"]) for r in rows] == [("ann", "u1", "brows", "raised", 40), ("ann", "u1", "head", "shake", 41)]


def test_run_folder_is_not_overwritten(spark, tmp_path):
    df = spark.range(5)
    first = I.write_run(df, str(tmp_path))
    assert I.write_run(df, str(tmp_path)) == first
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 5
    second = I.write_run(spark.range(6), str(tmp_path))
    assert second != first and spark.read.parquet(f"{tmp_path}/_latest").first()["run_id"] == second


def test_inventory_and_verify(spark, tmp_path):
    for n, b in (("a.bin", b"one"), ("b.bin", b""), ("c.bin", b"three")):
        (tmp_path / n).write_bytes(b)
    found = I.inventory(spark, str(tmp_path), "*.bin")
    assert found.count() == 2  # Spark skips empty files
    m = spark.createDataFrame([("a.bin", 3, "0"), ("b.bin", 0, "0"), ("c.bin", 9, "0"), ("d.bin", 1, "0")], "name string, length long, sha256 string")
    assert {r["name"]: r["status"] for r in I.verify(m, found).collect()} == {"a.bin": "checksum", "b.bin": "missing_or_empty", "c.bin": "size", "d.bin": "missing_or_empty"}


def test_files_longer_than_a_value_are_hashed_in_pieces(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(b"first")
    with open(tmp_path / "long.bin", "wb") as f:  # a hole, which takes no room
        f.truncate(2**31 + 5)
        f.seek(2**31)
        f.write(b"end")
    want = {}
    for n in ("a b.bin", "long.bin"):
        with open(tmp_path / n, "rb") as f:
            want[n] = hashlib.file_digest(f, "sha256").hexdigest()
    for whole in (I.WHOLE, 3):
        got = {r["name"]: (r["length"], r["sha256"]) for r in I.inventory(spark, str(tmp_path), "*.bin", whole).collect()}
        assert got == {"a b.bin": (5, want["a b.bin"]), "long.bin": (2**31 + 5, want["long.bin"])}


def test_gap_fill_stays_inside_and_below_the_limit(spark):
    v = [None, 1.0, None, 3.0, None, None, None, None, 8.0, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i long, v double")
    assert column(S.interpolate(df, "v", 3), "filled") == [None, 1.0, 2.0, 3.0, None, None, None, None, 8.0, None]


def test_causal_filters_never_look_ahead(spark):
    r = random.Random(4)
    v = [r.gauss(0, 10) for _ in range(60)]
    for f in (W.causal_band_rms, W.one_euro, lambda d: W.reversals(d).withColumnRenamed("level", "y")):
        full, part = column(f(table(spark, v))), column(f(table(spark, v[:40])))
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(full, part))


def test_moving_average_holds_the_ends(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0]
    pad = [v[0]] * 2 + v + [v[-1]] * 2
    got = column(table(spark, v).withColumn("y", S.moving_average("v", 5)))
    assert all(math.isclose(a, sum(pad[i : i + 5]) / 5) for i, a in enumerate(got))


def test_interval_rows_cross_bucket_edges(spark):
    rows = spark.range(200).selectExpr("'a' k", "id i")
    spans = spark.createDataFrame([("a", 60, 70), ("a", 63, 63), ("b", 0, 5)], "k string, lo long, hi long")
    assert J.interval_rows(rows, spans, 64).count() == 12


def test_nearest_match_equals_all_pairs(spark):
    r = random.Random(5)
    rows = [(g, i, r.random() * 3, r.random() * 3, r.random() < 0.4) for g in "xy" for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double, case boolean")
    got = {(x["g"], x["case"]): x["control"] for x in J.nearest_match(df.where("case"), df.where("not case"), "g", ["a", "b"], 0.5, "i").collect()}
    sd = [math.sqrt(sum((x[j] - sum(y[j] for y in rows) / len(rows)) ** 2 for x in rows) / len(rows)) for j in (2, 3)]
    want = {}
    for g, i, a, b, c in rows:
        if c:
            near = sorted((math.hypot((a - x[2]) / sd[0], (b - x[3]) / sd[1]), x[1]) for x in rows if x[0] == g and not x[4])
            if near and near[0][0] <= 0.5:
                want[g, i] = near[0][1]
    assert got == want


def test_bootstrap_finds_a_planted_effect_and_not_a_null(spark):
    r = random.Random(6)
    for shift in (0.2, 0.0):
        noise = [r.gauss(0, 0.1) for _ in range(160)]
        rows = [(j // 4, shift + x - sum(noise) / 160) for j, x in enumerate(noise)]
        b = N.cluster_bootstrap(spark.createDataFrame(rows, "c long, d double"), "c", "d", 200).first()
        assert (b["lo"] > 0) == (shift > 0) and b["lo"] <= b["shift"] <= b["hi"]
    few = N.cluster_bootstrap(spark.createDataFrame([(c, 1.0) for c in range(5)], "c long, d double"), "c", "d", 50).first()
    assert few["lo"] is None and few["p"] is None


def test_auc_ties_and_missing_class(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "s double, y boolean")
    assert N.auc(df, "s", F.col("y")).first()["auc"] == 0.875
    assert N.auc(df.where("y"), "s", F.col("y")).first()["auc"] is None


def test_edit_distance_anchors(spark):
    df = spark.createDataFrame([(list("abc"), list("abc"), 0), (list("abc"), [], 3), ([], list("ab"), 2), (list("kitten"), list("sitting"), 3), (None, list("a"), None)], "a array<string>, b array<string>, d int")
    assert all(r["d"] == r["e"] for r in df.withColumn("e", N.word_edits(F.col("a"), F.col("b"))).collect())


def test_unknown_coefficient_is_an_error(spark):
    try:
        C.subset_mean(F.lit(None), {"a": 0}, ["b"])
    except KeyError:
        return
    raise AssertionError


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_word_error_rate_reads_whole_texts(spark, tmp_path):
    from tidemark.plans.catalog import QUERIES

    r = random.Random(3)
    start = "the same beginning of every text that is longer than sixty letters "
    texts = [start + " ".join(r.choice(["cat", "cow", "dog", "été", "day\nnight"]) for _ in range(r.choice([0, 1, 40, 90]))) for _ in range(30)] + ["", "  ", "one", start]
    spark.createDataFrame([(i // 8, i % 8, "user", x) for i, x in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    tokens = [x.lower().split() for x in texts]
    want = {(i // 8, i % 8): brute(tokens[i], tokens[i + 1]) for i in range(len(texts) - 1) if i % 8 < 7}
    assert {(x["conv_id"], x["turn"]): x["edits"] for x in QUERIES["s13_word_error_rate_whole"](spark, str(tmp_path)).collect()} == want


def test_json_and_audit_leave_no_keys_out(spark, tmp_path):
    from tidemark.plans.catalog import QUERIES

    spark.range(20).selectExpr("id o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id div 2 l_orderkey", "cast(id % 2 as int) l_linenumber", "id l_partkey", "if(id % 3 = 0, 'N', 'R') l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(30).selectExpr("id doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(5, 33).selectExpr("id doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in QUERIES["a05_nested_json_flatten_whole"](spark, str(tmp_path)).collect())
    assert got == [(i // 2, i % 2, i, "?" if i % 3 == 0 else "R") for i in range(40)]
    r = QUERIES["c01_audited_join_whole"](spark, str(tmp_path)).first()
    assert (r["matched"], r["left_only"], r["right_only"]) == (25, 5, 3)


def test_whole_bootstrap_has_the_replicates_of_the_reference():
    from tidemark.plans.catalog import SQL

    assert "range(0, 4000)" in SQL["s01_matched_pair_bootstrap_whole"] and "range(0, 200)" in SQL["s01_matched_pair_bootstrap"]
