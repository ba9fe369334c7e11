"""The other operators of the subpackage against brute force, round trips and held-out accuracy, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import best_fit_packing, bit_packing, cross_parsing, ftrl_toxicity, hilbert_ann, line_frequency, site_quality, suffix_decontam, url_markov

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOC + extra)


EDGE = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "***", "en", None, 3), (None, "one two", "en", "s", 7), (5, "one two", None, "s", 7), (5, "one two", None, "s", 7), (6, "x " * 30_000, "en", "s", 60_000)]


# --- decontamination


def brute_decontam(rows, items):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(10, len(iw))
            windows = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add(item)
        ids = ",".join(sorted(str(x) for x in found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(1)
    vocab = [f"v{i}" for i in range(30)] + ["É", "日本"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 10, 11, 25])))) for i in range(15)] + [(99, None), (3, "v1 v2 v3 v4")]
    rows = []
    for i in range(60):
        w = [r.choice(vocab[:8] if i % 3 else vocab) for _ in range(r.randrange(0, 80))]
        if i % 4 == 0:
            w[5:5] = words(items[r.randrange(15)][1])
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else ", ".join(w)))
    rows += [(e[0], e[1]) for e in EDGE]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix_decontam.report(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(map(tuple, got), key=repr) == brute_decontam(rows, items)
    empty = suffix_decontam.report(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).collect()
    assert not any(x["contaminated"] for x in empty) and len(empty) == len(rows)


def test_decontamination_blocks_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(suffix_decontam, "BLOCK_CHARS", 40)
    items = [(i, f"a{i} b c d e f g h i j k{i}") for i in range(6)]
    monkeypatch.setattr(suffix_decontam, "CHAIN", 2)  # rows are written after every two of the six blocks
    rows = [(i, f"zz a{i} b c d e f g h i j k{i} yy", "own", 1) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int")
    kept = suffix_decontam.remove_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and [tuple(x) for x in kept.collect()] == [rows[6]]
    got = suffix_decontam.report(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_decontam([r[:2] for r in rows], items)


# --- line frequency


def test_site_lines(spark):
    rows = [(i, f"menu\nbody {i}\n\nfoot" if i % 2 else f"body {i}\n menu ", "en", "a", 1) for i in range(40)]
    rows += [(100 + i, f"menu\nonly {i}", "en", None, 1) for i in range(3)] + [(200, None, "en", "a", 0), (201, "", "en", "b", 0)]
    out = {r["doc_id"]: r for r in line_frequency.drop_site_lines(docs(spark, rows), ratio=0.3).collect()}
    assert out[1]["text"] == "body 1\n" and out[1]["n_dropped"] == 2 and out[1]["n_lines"] == 4
    assert out[2]["text"] == "body 2" and out[100]["text"] == "only 0"  # on all pages of a small host, and on most of the others
    assert out[200]["text"] is None and out[200]["n_lines"] == 0 and out[201]["text"] == ""
    assert line_frequency.drop_site_lines(docs(spark, [])).collect() == []


def test_site_lines_beside_own_columns_and_long_lines(spark):
    rows = [(i, "menu\n" + "x" * 100_000 + f"{i}\n" + "same " * 20_000, "en", "a", 1) for i in range(9)]
    df = docs(spark, rows).withColumns({"_h": F.lit(1), "_lines": F.lit("l"), "_host": F.lit("z"), "N_LINES": F.lit("old")})
    out = line_frequency.drop_site_lines(df)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == [c for c in df.columns if c != "N_LINES"]
    got = out.collect()
    assert all((r["_h"], r["_lines"], r["_host"], r["n_dropped"]) == (1, "l", "z", 2) and len(r["text"]) == 100_001 for r in got)


def test_site_lines_by_join(spark, monkeypatch):
    import tidemark.llm._base as base

    rows = [(i, f"menu\nbody {i}", "en", f"h{i % 3}", 1) for i in range(60)]
    a = sorted(map(tuple, line_frequency.drop_site_lines(docs(spark, rows)).collect()))
    monkeypatch.setattr(base, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_frequency.drop_site_lines(docs(spark, rows)).collect())) == a


# --- packed ids


@pytest.mark.parametrize("vocabulary", [2, 5, 1000, 49_408, 65_537, 2**20, 2**31])
def test_bits_round_trip(vocabulary):
    r = np.random.default_rng(vocabulary)
    bits = bit_packing.bits_for(vocabulary)
    ids = [r.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 1, 5000, 4096, 17)]
    seg = bit_packing.Segment(bit_packing.encode_segment(ids, bits))
    assert all((seg.doc(d) == x).all() for d, x in enumerate(ids))
    flat = np.concatenate(ids)
    assert (seg.ids(4000, 9000) == flat[4000:9000]).all() and len(seg.ids(5, 5)) == 0
    assert bits == max(1, (vocabulary - 1).bit_length())


def test_tokens_equal_the_library(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = ["It's we'll I'D 'S \"'ve", "naïve ÀÉÎ ß İ ǅ ŉ", "x²y³ ½ 42 3.14", "日本語 text", "a\x1cb\x85c\xa0d", "Ünḯ é", "<|endoftext|> ok", "__a_b__ !!??", "ΑΣ Σ", "tab\tnew\nline", "a" * 5000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(odd)] + [(50 + i, *e[1:]) for i, e in enumerate(EDGE)]
    bit_packing.write_ids(docs(spark, rows), f"file://{tmp_path}/ids", path, 49_408)
    got = {r["doc_id"]: r for r in bit_packing.read_ids(spark, f"file://{tmp_path}/ids").collect()}
    start = 0
    for i, t, *_ in sorted(rows):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


# --- packing


def test_packing_keeps_all_tokens_and_no_conflicts(spark):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randrange(9)}" for _ in range(r.choice([0, 3, 40, 90, 100, 350]))), "en", r.choice(["hot", "hot", "a", "b", None]), 1) for i in range(300)]
    rows += [(1000 + i, "same words here", "en", f"s{i}", 1) for i in range(30)] + [(None, "one two", "en", "s", 1)]
    out = best_fit_packing.pack_texts(docs(spark, rows), capacity=100).collect()
    source, text = {i: s for i, _, _, s, _ in rows}, {i: t for i, t, *_ in rows}
    tokens, bins = Counter(), defaultdict(list)
    for x in out:
        tokens[x["doc_id"]] += x["n_tokens"]
        bins[x["bin_id"]].append(x)
    assert tokens == {i: len(words(t)) + 1 for i, t in text.items()}
    for b in bins.values():
        assert sum(x["n_tokens"] for x in b) <= 100
        at = sorted((x["bin_offset"], x["n_tokens"]) for x in b)
        assert all(p + n == q for (p, n), (q, _) in zip(at, at[1:]))
        s = [source[x["doc_id"]] for x in b if source[x["doc_id"]] is not None]
        t = [tuple(words(text[x["doc_id"]])) for x in b if words(text[x["doc_id"]])]
        assert len(s) == len(set(s)) and len(t) == len(set(t))


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, n = best_fit_packing.best_fit([60, 50, 40, 45], ["a", "b", "a", "c"], [None] * 4, 100)
    assert bins == [0, 1, 1, 2] and n == 3  # the tightest bin of the third piece has its source
    assert best_fit_packing.best_fit([60, 50, 40], ["a", "b", "c"], [None] * 3, 100)[0] == [0, 1, 0]


# --- nearest neighbours


def brute_neighbours(vec, k):
    ok = {i: [*v, *[0.0] * (8 - len(v))] for i, v in vec if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            near = sorted((-float((np.array(ok[q]) * np.array(v)).sum()), i) for i, v in ok.items() if i != q)[:k]
            out[q] = [(r, i) for r, (_, i) in enumerate(near, 1)]
    return out


def test_neighbours_small_and_edges(spark):
    r = np.random.default_rng(3)
    vec = [(i, [float(x) for x in np.float32(r.standard_normal(8))]) for i in range(150)]
    vec += [(i, [1.0] * 8) for i in range(200, 290)]  # copies
    vec += [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [None] + [1.0] * 7), (380, [1.0, 2.0]), (None, [1.0] * 8), (400, [float("inf")] * 8)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = defaultdict(list)
    for x in hilbert_ann.nearest(df, F.col("id") % 20 == 0).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"]))
    assert {q: sorted(v) for q, v in got.items()} == brute_neighbours(vec, 20)
    assert hilbert_ann.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []
    two = spark.createDataFrame(vec[:2], "vec_id long, embedding array<float>")
    assert [tuple(x)[:3] for x in hilbert_ann.nearest(two, F.col("id") % 20 == 0).collect()] == [(0, 1, 1)]


def test_neighbours_in_parts_and_with_ties(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "BLOCK", 16)
    monkeypatch.setattr(hilbert_ann, "ASKED", 3)  # the queries of a block go to several tasks
    r = np.random.default_rng(9)
    vec = [(i, [float(x) for x in r.integers(-2, 3, 8)]) for i in range(400)]  # many equal products
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in hilbert_ann.nearest(df, F.col("id") % 20 == 0, target=1.0).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    vectors, found = dict(vec), 0
    for q, near in got.items():
        want = sorted((-float((np.array(vectors[q]) * np.array(vectors[i])).sum()), i) for i, _ in vec if i != q and any(vectors[i]))
        own = [(-s, i) for _, i, s in sorted(near)]
        assert own == sorted(own) and all(s == float((np.array(vectors[q]) * np.array(vectors[i])).sum()) for _, i, s in near)
        found += len({i for _, i in own} & {i for _, i in want[:20]})
    assert found >= 0.9 * 20 * len(got)
    assert set(got) == {i for i, v in vec if i % 20 == 0 and any(v)}
    twice = hilbert_ann.nearest(df.union(df.where("vec_id < 7")), F.col("id") % 20 == 0).collect()  # a row of each copy of query 0
    assert len(twice) == 21 * 20 and all(x["vec_id"] != x["query_id"] for x in twice)


def test_hilbert_neighbouring_keys_touch():
    for axes, depth in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << depth)] * axes), -1).reshape(-1, axes)
        order = np.argsort(hilbert_ann.hilbert_key(grid, depth))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_recall_of_partial_windows(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "BLOCK", 64)
    r = np.random.default_rng(4)
    v = r.standard_normal((40, 16)).repeat(50, axis=0) + 0.2 * r.standard_normal((2000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))], "vec_id long, embedding array<float>")
    w = v.astype(np.float32).astype(float)
    hits = sum(x["vec_id"] in set(np.argsort(-(w @ w[x["query_id"]]), kind="stable")[:21]) for x in hilbert_ann.nearest(df, F.col("id") % 20 == 0).collect())
    assert hits / 2000 >= 0.9


# --- urls


def test_urls(spark):
    urls = ["https://A.Example.NET/en/1?x", "http://x.net/de/", "https://m.example.com/de/7#t", "http://example.com/den", "ftp://b.org/fr/a", "http://netx/", "nothing", None, "", "://net/", "http://a.net", "http://h.org/en/\n?q"] + [f"https://good{i}.org/fr/{i}" for i in range(60)] + [f"http://bad{i}.net/x/{i}" for i in range(60)]
    got = {r["page_id"]: r for r in url_markov.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(11)] == [("a.example.net", "/en/1", "example.net/en/"), ("x.net", "/de/", "net/"), ("m.example.com", "/de/7", "example.com/de/"), ("example.com", "/den", None), ("b.org", "/fr/a", "org/fr/"), ("netx", "/", None), ("", "", None), ("", "", None), ("", "", None), ("net", "/", "net/"), ("a.net", "", None)]
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block" and all(r["verdict"] in ("allow", "block") for r in got.values())
    model = url_markov.learn(spark.createDataFrame([(u, "allow" if "good" in u else "block") for u in urls[12:]], "url string, verdict string"))
    good, bad = model.ratio(["https://good99.org/fr/99", "http://bad77.net/x/77"])
    assert good > model.threshold > bad
    assert url_markov.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def brute_ratios(ruled, urls, order=6, prior=2.0):
    """Two models of exact counts in dicts."""
    places = lambda u: [(seq[p : p + order - 1], seq[p + order - 1]) for seq in [("^",) * (order - 1) + tuple(u.encode()) + ("$",)] for p in range(len(seq) - order + 1)]
    tables = []
    for y in ("block", "allow"):
        g, c = Counter(), Counter()
        for u, v in ruled:
            if v == y and zlib.crc32(u.encode()) % 5:
                for before, x in places(u):
                    for k in range(order):
                        ctx = before[order - 1 - k :]
                        g[ctx, x] += 1
                        c[ctx] += 1
        tables.append((g, c))

    def one(u):
        total = 0.0
        for before, x in places(u):
            for sign, (g, c) in zip((-1, 1), tables):
                p = 1 / 258
                for k in range(order):
                    ctx = before[order - 1 - k :]
                    p = (g[ctx, x] + prior * p) / (c[ctx] + prior)
                total += sign * np.log(p)
        return total / len(places(u))

    return {u: one(u) for u in urls}


def test_url_ratios_equal_exact_counts(spark, monkeypatch):
    import tidemark.llm._base as base

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    urls = [f"http://h{i % 7}.{('net', 'org', 'info')[i % 3]}/{'fr' if i % 3 == 1 else 'x'}/{word()}" for i in range(6000)]
    urls += urls[:500]  # repeated urls count as often
    verdict = {"net": "block", "org": "allow"}
    ruled = [(u, verdict[u.split("/")[2].split(".")[1]]) for u in urls if ".info/" not in u]
    some = r.sample(sorted(set(urls)), 300)
    want = brute_ratios(ruled, some)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["url"]: x["llr"] for x in url_markov.judge(df).collect()}
    assert len(got) == 6000 and max(abs(got[u] - want[u]) for u in some) < 1e-9
    monkeypatch.setattr(base, "BROADCAST_ROWS", 0)
    again = {x["url"]: x["llr"] for x in url_markov.judge(df).collect()}
    assert max(abs(got[u] - again[u]) for u in got) < 1e-9


# --- learned filters


def test_toxicity_learns_and_survives_edges(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{r.randrange(200)}" for _ in range(60)]
        if i % 4 == 0:
            w[r.randrange(60)] = r.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(i % 4 == 0)))
    d = docs(spark, rows)
    m = ftrl_toxicity.learn(d.where("doc_id % 5 <> 0"), spark.createDataFrame(labels, "doc_id long, label int"))
    got = ftrl_toxicity.score(d.where("doc_id % 5 = 0"), m).collect()
    right = np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got])
    assert right > 0.9 and len(m.coord) < 5000
    edge = ftrl_toxicity.score(docs(spark, EDGE).withColumn("score", F.lit("old")), m).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    one = ftrl_toxicity.learn(d, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    assert 0.5 < one.score(["x"])[0] < 1
    none = ftrl_toxicity.learn(d, spark.createDataFrame([], "doc_id long, label int"))
    assert none.score([None])[0] == pytest.approx(0.5)


def test_quality_shrinks_sites(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        w = [f"w{r.randrange(300)}" for _ in range(50)]
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), "en", f"s{i % 7}", 1))
        labels.append((i, int(not bad)))
    d = docs(spark, rows)
    m = site_quality.learn(d, spark.createDataFrame(labels, "doc_id long, label int"))
    got = site_quality.classify(d, m).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in got)
    edge = site_quality.classify(docs(spark, EDGE), m).collect()
    assert len(edge) == len(EDGE) and all(0 < r["p_good"] < 1 for r in edge)
    assert site_quality.classify(docs(spark, []), m).collect() == []


def test_language(spark):
    r = random.Random(7)
    parts = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ü", "ten", "ver"], "cc": ["ción", "que", "ñ", "ado"]}
    rows = [(i, " ".join("".join(r.choice(parts[x]) for _ in range(3)) for _ in range(30)), x, "s", 1) for i, x in enumerate(random.Random(8).choices(list(parts), k=240))]
    d = docs(spark, rows)
    m = cross_parsing.learn(d.where("doc_id % 3 <> 1"))
    got = cross_parsing.identify(d.where("doc_id % 3 = 1"), m).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    edge = {r["text"]: r for r in cross_parsing.identify(docs(spark, [*EDGE, (9, "123 !!", "aa", "s", 1)]), m).collect()}
    assert edge[None]["lang_pred"] == edge[""]["lang_pred"] == edge["123 !!"]["lang_pred"] == "und" and edge["one two"]["lang_pred"] in parts
    assert {r["lang_pred"] for r in cross_parsing.identify(d, cross_parsing.learn(d.limit(0))).collect()} == {"und"}
