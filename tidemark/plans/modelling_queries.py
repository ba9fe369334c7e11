"""Leave-one-group-out modelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import folds as K
from tidemark.operators import inference as N
from tidemark.operators import logistic as L
from tidemark.plans.registry import query
from tidemark.plans.reports_queries import _LAB, labelled
from tidemark.plans.windows_queries import EM, em, r6

_KF = "CAST(('0x' || substr(md5('k:' || {k}), 1, 8))::BIGINT % {n} AS INTEGER)"


@query("m01_leave_one_group_out", """
WITH g AS (SELECT source AS g, row_number() OVER (ORDER BY source) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
f AS (SELECT a.g AS fold, b.g AS val FROM g a JOIN g b ON b.p = (a.p + 1) % a.n)
SELECT fold, CASE WHEN source = fold THEN 'test' WHEN source = val THEN 'val' ELSE 'train' END AS role, count(*) AS n
FROM documents, f
GROUP BY 1, 2
""")
def m01(t):
    return K.leave_one_group_out(t("documents"), "doc_id", "source").groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("m01_fold_summary", """
WITH g AS (SELECT source AS g, row_number() OVER (ORDER BY source) - 1 AS p, count(*) OVER () AS n, c FROM
  (SELECT source, count(*) AS c FROM documents GROUP BY 1)),
f AS (SELECT a.g AS fold, b.g AS val, a.c AS test, b.c AS validation, a.n < 3 AS fallback FROM g a JOIN g b ON b.p = (a.p + 1) % a.n),
s AS (SELECT sum(c)::BIGINT AS n FROM g)
SELECT fold, val AS val_group, test::BIGINT AS test, validation::BIGINT AS validation, n - test - validation AS train, fallback, true AS disjoint
FROM f, s
""")
def m01_summary(t):
    return K.fold_summary(t("documents"), "doc_id", "source")


@query("m02_seeded_k_fold", f"SELECT doc_id, {_KF.format(k='doc_id', n=5)} AS fold FROM documents")
def m02(t):
    return t("documents").select("doc_id", K.kfold(F.col("doc_id"), 5).alias("fold"))


@query("m03_train_only_standardisation", f"""
WITH {EM},
d AS (SELECT vec_id, j, x[j] AS e, {_KF.format(k='vec_id', n=3)} AS f FROM m, range(1, 65) r(j)),
st AS (SELECT fold, j, avg(e) AS mu, stddev_pop(e) AS sd FROM d, range(0, 3) q(fold) WHERE f <> fold GROUP BY 1, 2)
SELECT vec_id, CAST(st.fold AS INTEGER) AS fold, f = st.fold AS held, list(round((e - mu) / sd, 6) + 0.0 ORDER BY d.j) AS x
FROM d
JOIN st ON st.j = d.j
GROUP BY ALL
""")
def m03(t):
    """All dimensions, by the means and deviations of each fold's training rows."""
    return K.standardise_vectors(em(t).select("vec_id", "x"), K.kfold(F.col("vec_id"), 3), "x", 3).select("vec_id", "fold", "held", F.transform("x", lambda e: F.round(e, 6)).alias("x"))


#: Measures of a text from built-in functions, as shares of its characters but for the length
MEASURES = {"size": "ln(1 + length(text))", "upper": "[^A-Z]", "digit": "[^0-9]", "bang": "[^!]", "bar": "[^|]", "symbol": "[^#$%&*]", "lines": "[^\\n]", "stops": "[^.,;:?]"}


def measured(t):
    """Labelled documents with their measures ``x``, group ``lang`` and labels ``y`` (quality) and ``toxic``."""
    share = lambda rx: F.length(F.regexp_replace("text", rx + "+", "")) / F.greatest(F.length("text"), F.lit(1))
    x = F.array(F.log1p(F.length("text").cast("double")), *[F.log1p(100 * share(rx)) for n, rx in MEASURES.items() if n != "size"])
    d = t("documents").where("text is not null").select("doc_id", "lang", "source", x.alias("x"))
    return t("labels").join(d.hint("shuffle_hash"), "doc_id").select("doc_id", "lang", "source", "x", F.col("quality").alias("y"), "toxic")


def shuffled(rows, label):
    """Rows with their labels dealt anew by seeded hash: the i-th row by one hash gets the label of the i-th by another."""
    key = lambda s: F.md5(F.concat(F.lit(s + ":"), F.col("doc_id").cast("string")))
    a = N.numbered(rows.drop(label).withColumn("_h", key("x")), ["_h", "doc_id"], "_i").drop("_h")
    b = N.numbered(rows.select("doc_id", label).withColumn("_h", key("y")), ["_h", "doc_id"], "_i").select("_i", label)
    return a.join(b.hint("merge"), "_i").drop("_i")


@query("m04_logistic_leave_group_out")
def m04(t):
    """Quality predicted from a text's measures in each language by a model of the others, which choose its penalty."""
    r = L.leave_group_out(measured(t), "lang", "x", "y")
    return r.select("fold", "penalty", "n", r6(F.col("hits") / F.col("n"), "accuracy"), "distinct", (F.col("distinct") <= 1).alias("constant"))


@query("m07_control_through_the_model")
def m07_model(t):
    """The same folds, penalties and fits on real labels and on labels dealt anew: what the second reaches is chance."""
    rows = N.written(measured(t))  # texts are measured once
    runs = [L.leave_group_out(d, "lang", "x", "y").withColumn("labels", F.lit(k)) for k, d in (("real", rows), ("shuffled", shuffled(rows, "y")))]
    both = runs[0].union(runs[1])
    return both.select("labels", "fold", "penalty", "n", r6(F.col("hits") / F.col("n"), "accuracy"))


@query("m05_cross_fitted_probe")
def m05(t):
    """AUC of probes over held-out folds for several targets, each beside its control on permuted labels; a target
    with fewer than 20 rows, or one class, is not interpretable. The last column is the gate: the positive control, which
    is a function of the measures (``long``: above the mean of the first), is read, and no permuted label is."""
    rows = N.written(folded(t))  # texts are measured once
    mean = rows.agg(F.avg(F.col("x")[0]).alias("m"))
    rows = rows.crossJoin(F.broadcast(mean)).withColumns({"quality": F.col("y"), "english": (F.col("lang") == "en").cast("int"), "parity": (F.col("doc_id") % 2).cast("int"), "constant": F.lit(1), "long": (F.col("x")[0] > F.col("m")).cast("int")})
    p = L.probes(rows, "doc_id", "fold", "x", ["quality", "toxic", "english", "parity", "constant", "long"])
    gate = p.agg((F.max(F.when(F.col("target") == "long", F.col("auc"))) >= 0.9).alias("a"), (F.max(F.abs(F.col("permuted_auc") - 0.5)) <= 0.2).alias("b"))
    return p.crossJoin(F.broadcast(gate)).select("target", "n", "positives", "interpretable", r6("auc", "auc"), r6("permuted_auc", "permuted_auc"), (F.col("a") & F.col("b")).alias("gate"))


def folded(t):
    return measured(t).withColumn("fold", K.kfold(F.col("doc_id"), 4))


def _probed(p):
    return p.select("class", "n", "positives", "skipped", *[r6(c, c) for c in ("auc", "permuted_auc", "worst_auc", "mean_auc")], "usable", "covered")


@query("m05_one_vs_rest_probe")
def m05_classes(t):
    """Whether each language can be told from all others by the measures of its texts, the worst first of all."""
    return _probed(L.class_probes(folded(t), "doc_id", "fold", "x", "lang"))


@query("m05_multilabel_probe")
def m05_labels(t):
    """The same for labels of which a text may have any number."""
    labels = F.filter(F.array(F.when(F.col("y") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("doc_id") % 3 == 0, "third"), F.when(F.col("doc_id") == 0, "first")), lambda x: x.isNotNull())
    return _probed(L.label_probes(folded(t).withColumn("labels", labels), "doc_id", "fold", "x", "labels"))


@query("m08_ablation_grid")
def m08(t):
    """Accuracy over held-out languages with all measures and with one family of them off at a time, in two dealings of
    the documents."""
    return L.ablation(measured(t), "lang", "x", "y", {"size": [0], "case": [1], "digits": [2], "marks": [3, 4, 5], "layout": [6, 7]}, seeds=2, row="doc_id").select("variant", "seed", "n", r6(F.col("hits") / F.col("n"), "accuracy"))


_SIG = """
sg AS (SELECT doc_id, lang, q, unnest(['chars', 'rule', 'id']) AS name, unnest([n_chars::DOUBLE, (CASE WHEN r THEN 0 ELSE 1 END)::DOUBLE,
  (doc_id % 97)::DOUBLE]) AS score FROM lj)
"""


@query("m06_choose_on_training_groups", f"""
WITH {_LAB},
{_SIG},
f AS (SELECT DISTINCT lang AS fold FROM lj),
g AS (SELECT fold, name, lang = fold AS held, score, count(*) FILTER (WHERE q) AS p, count(*) FILTER (WHERE NOT q) AS n FROM sg, f GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY fold, name, held ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
  g),
a AS (SELECT fold, name, held, (sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0))::DOUBLE AS auc FROM w GROUP BY ALL),
c AS (SELECT fold, arg_max(name, (auc, name)) AS name FROM a WHERE NOT held GROUP BY 1)
SELECT c.fold, c.name, round(a.auc, 6) AS held_auc
FROM c
JOIN a ON a.fold = c.fold AND a.name = c.name AND a.held
""")
def m06(t):
    d = labelled(t).select("lang", "q", F.explode(F.create_map(F.lit("chars"), F.col("n_chars").cast("double"), F.lit("rule"), F.when(F.col("r"), 0.0).otherwise(1.0), F.lit("id"), (F.col("doc_id") % 97).cast("double"))).alias("name", "score"))
    folds = d.select(F.col("lang").alias("fold")).distinct()
    x = d.crossJoin(F.broadcast(folds)).withColumn("held", F.col("lang") == F.col("fold"))  # a row per language
    a = N.auc(x, "score", F.col("q"), ["fold", "name", "held"])
    pick = a.where("not held").groupBy("fold").agg(F.max_by("name", F.struct("auc", "name")).alias("name"))
    return pick.join(a.where("held").select("fold", "name", "auc").hint("merge"), ["fold", "name"]).select("fold", "name", r6("auc", "held_auc"))


@query("m07_shuffled_label_control", f"""
WITH {_LAB},
a AS (SELECT n_chars, row_number() OVER (ORDER BY md5('x:' || doc_id)) AS i FROM lj),
b AS (SELECT q, row_number() OVER (ORDER BY md5('y:' || doc_id)) AS i FROM lj),
g AS (SELECT n_chars, count(*) FILTER (WHERE q) AS p, count(*) FILTER (WHERE NOT q) AS n FROM a JOIN b USING (i) GROUP BY 1),
w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round((sum(p * (below + n / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc
FROM w
""")
def m07(t):
    d = labelled(t)
    key = lambda s: F.md5(F.concat(F.lit(s + ":"), F.col("doc_id").cast("string")))
    a = N.numbered(d.select("n_chars", "doc_id", key("x").alias("h")), ["h", "doc_id"], "i").select("n_chars", "i")
    b = N.numbered(d.select("q", "doc_id", key("y").alias("h")), ["h", "doc_id"], "i").select("q", "i")
    return N.auc(a.join(b.hint("merge"), "i"), "n_chars", F.col("q")).select(r6("auc", "auc"))
