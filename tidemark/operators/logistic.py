"""Many regularised multinomial logistic models at once, and what is chosen and controlled with them.

The models differ in the groups they are trained on, in their penalty and in which label they see. Rows stay in Spark:
a Newton step of all models is one pass in which every task sums up gradients and curvature, and an aggregation of
those sums, whose size depends on models, features and classes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import written

STEPS = 12
GRID = (1.0, 0.1, 0.01)


class Fit:
    """One model to be fitted: the groups left out, the penalty, the column of labels and the features (None: all)."""

    def __init__(self, out: frozenset, penalty: float, label: str = "y", features: list[int] | None = None):
        self.out, self.penalty, self.label, self.features = out, penalty, label, features
        self.classes: list = []
        self.mean = self.scale = self.weight = self.w = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Logits of the classes; rows of features as they come."""
        return self.rows(x) @ self.w

    def rows(self, x: np.ndarray) -> np.ndarray:
        """The model's own features, scaled, and a constant."""
        own = x if self.features is None else x[:, self.features]
        return np.column_stack(((own - self.mean) / self.scale, np.ones(len(x))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def newton_sums(fit: Fit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the weighted loss over some training rows, flat; ``y`` numbers the classes."""
    xb = fit.rows(x)
    p, k = _softmax(xb @ fit.w), len(fit.classes)
    weight = fit.weight[y]
    d = p - np.eye(k)[y]
    grad = (xb * weight[:, None]).T @ d
    size = xb.shape[1]
    hess = np.empty((size, k, size, k))
    for a in range(k):
        for b in range(k):
            c = weight * p[:, a] * ((a == b) - p[:, b])
            hess[:, a, :, b] = (xb * c[:, None]).T @ xb
    return np.concatenate((grad.ravel(), hess.ravel()))


def newton_step(fit: Fit, sums: np.ndarray, total: float) -> float:
    """Move a model by one penalised step, and return how far. The mean loss counts, the constant has no penalty."""
    n = fit.w.size
    keep = np.full(fit.w.shape, fit.penalty)
    keep[-1] = 1e-6  # classes' constants are determined only up to a common shift
    grad = sums[:n] / total + (keep * fit.w).ravel()
    move = np.linalg.solve(sums[n:].reshape(n, n) / total + np.diag(keep.ravel()) + 1e-9 * np.eye(n), grad)
    fit.w -= move.reshape(fit.w.shape)
    return float(np.abs(move).max())


def group_sums(rows: DataFrame, group: str, x: str, labels: list[str]) -> dict:
    """Per group and label column: counts of classes; and per group n, sums and squares of the features."""
    flat = rows.select(group, F.posexplode(x).alias("j", "e"))
    moments = flat.groupBy(group, "j").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q")).collect()
    counts = {c: rows.groupBy(group, c).agg(F.count("*").alias("n")).collect() for c in labels}
    size = 1 + max((r["j"] for r in moments), default=-1)
    out: dict = {"moments": {}, "counts": {c: {} for c in labels}}
    for r in moments:
        m = out["moments"].setdefault(r[group], np.zeros((3, size)))
        m[:, r["j"]] = r["n"], r["s"], r["q"]
    for c in labels:
        for r in counts[c]:
            out["counts"][c].setdefault(r[group], {})[r[c]] = r["n"]
    return out


def prepare(fit: Fit, sums: dict) -> bool:
    """Scale and class weights of a model from its training groups; False if those have fewer than two classes."""
    use = [g for g in sums["moments"] if g not in fit.out]
    counts: dict = {}
    for g in use:
        for c, n in sums["counts"][fit.label].get(g, {}).items():
            counts[c] = counts.get(c, 0) + n
    fit.classes = sorted(counts)
    if len(fit.classes) < 2:
        return False
    n, s, q = sum(sums["moments"][g] if fit.features is None else sums["moments"][g][:, fit.features] for g in use)
    fit.mean = s / n
    sd = np.sqrt(np.maximum(q / n - fit.mean**2, 0))
    fit.scale = np.where(sd > 1e-9, sd, 1.0)
    total = sum(counts.values())
    fit.weight = np.array([total / (len(counts) * counts[c]) for c in fit.classes])
    fit.w = np.zeros((len(fit.mean) + 1, len(fit.classes)))
    return True


def fit_all(rows: DataFrame, fits: list[Fit], group: str, x: str, sums: dict) -> None:
    """Fit all models on the written ``rows(group, x, labels...)`` by Newton steps."""
    spark = rows.sparkSession
    total = [sum(n for g, c in sums["counts"][f.label].items() if g not in f.out for n in c.values()) for f in fits]
    going = list(range(len(fits)))
    columns = list(dict.fromkeys([group, x, *[f.label for f in fits]]))
    for _ in range(STEPS):
        sent = spark.sparkContext.broadcast([(k, fits[k]) for k in going])

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for pdf in frames:
                groups, v = pdf[group].to_numpy(), np.stack(pdf[x].to_list()) if len(pdf) else np.zeros((0, 1))
                for k, f in sent.value:
                    use = ~pdf[group].isin(f.out).to_numpy() if f.out else np.ones(len(groups), bool)
                    if use.any():
                        made = newton_sums(f, v[use], np.searchsorted(np.array(f.classes), pdf[f.label].to_numpy()[use]))
                        held[k] = held[k] + made if k in held else made
            for k, made in held.items():
                yield pd.DataFrame({"k": k, "j": np.arange(len(made)), "s": made})

        got = rows.select(*columns).mapInPandas(run, "k int, j int, s double").groupBy("k", "j").agg(F.sum("s").alias("s")).toPandas()
        sent.destroy()
        still = []
        for k, g in got.groupby("k"):
            flat = np.zeros(len(g))
            flat[g["j"].to_numpy()] = g["s"].to_numpy()
            if newton_step(fits[k], flat, total[k]) > 1e-8:
                still.append(int(k))
        going = still
        if not going:
            break


def predicted(rows: DataFrame, fits: dict, group: str, x: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``guess`` and ``margin`` (top logit less the second) by the model of each row's group."""
    sent = rows.sparkSession.sparkContext.broadcast(fits)
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[keep].copy()
            guess, margin = np.full(len(pdf), None, object), np.zeros(len(pdf))
            for g, at in pdf.groupby(group).indices.items():
                if (f := sent.value.get(g)) is None:
                    continue
                z = f.scores(np.stack(pdf[x].iloc[at].to_list()))
                guess[at] = np.array(f.classes, object)[z.argmax(axis=1)]
                top = np.sort(z, axis=1)
                margin[at] = top[:, -1] - top[:, -2]
            yield out.assign(guess=guess, margin=margin)

    y = kinds[next(iter(fits.values())).label] if fits else "int"
    return rows.select(*list(dict.fromkeys([*keep, group, x]))).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", guess {y}, margin double")


def leave_group_out(rows: DataFrame, group: str, x: str, label: str, grid: tuple = GRID) -> DataFrame:
    """Every group predicted by a model that has not seen it: a row per group with ``fold, penalty, n, hits, distinct``.

    The penalty of a fold is the one of ``grid`` (strongest first) with most hits when each training group is held out
    in turn; ties go to the stronger. The fold's own group takes no part in that. With fewer than two training groups
    the first penalty is taken. Classes are weighted to equal sums; features are scaled by the training rows. A fold
    whose training rows have one class has ``penalty`` NULL and guesses nothing.
    """
    rows = written(rows.select(group, x, label).where(F.col(group).isNotNull() & F.col(x).isNotNull() & F.col(label).isNotNull()))
    sums = group_sums(rows, group, x, [label])
    groups = sorted(sums["moments"])
    choose = len(groups) > 2 and len(grid) > 1
    inner = [(g, h, p, Fit(frozenset((g, h)), p, label)) for g in groups for h in groups if h != g and choose for p in grid]
    ready = [t for t in inner if prepare(t[3], sums)]
    fit_all(rows, [t[3] for t in ready], group, x, sums)
    hits = _hits(rows, [((g, p), h, f) for g, h, p, f in ready], group, x, label)
    chosen = {g: max(grid, key=lambda p: (hits.get((g, p), 0), p)) if choose else grid[0] for g in groups}
    outer = {g: Fit(frozenset((g,)), chosen[g], label) for g in groups}
    outer = {g: f for g, f in outer.items() if prepare(f, sums)}
    fit_all(rows, list(outer.values()), group, x, sums)
    guessed = predicted(rows, outer, group, x, [group, label])
    table = rows.sparkSession.createDataFrame([(g, float(chosen[g]) if g in outer else None) for g in groups], f"`{group}` {dict(rows.dtypes)[group]}, penalty double")
    found = guessed.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("guess") == F.col(label)).alias("hits"), F.count_distinct("guess").alias("distinct"))
    return table.join(found.hint("merge"), group).withColumnRenamed(group, "fold")


def _hits(rows: DataFrame, models: list, group: str, x: str, label: str) -> dict:
    """Rows of the held group that each model gets right, summed by the models' key; one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(sent.value), np.int64)
        for pdf in frames:
            by = pdf.groupby(group).indices
            for k, (_, h, f) in enumerate(sent.value):
                if (at := by.get(h)) is not None:
                    z = f.scores(np.stack(pdf[x].iloc[at].to_list()))
                    n[k] += int((np.array(f.classes)[z.argmax(axis=1)] == pdf[label].to_numpy()[at]).sum())
        yield pd.DataFrame({"k": np.arange(len(n)), "n": n})

    out: dict = {}
    for r in rows.select(group, x, label).mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        key = models[r["k"]][0]
        out[key] = out.get(key, 0) + r["n"]
    return out


def probes(rows: DataFrame, row: str, fold: str, x: str, targets: list[str], penalty: float = 0.1, least: int = 20, support: int = 1) -> DataFrame:
    """Can 0/1 ``targets`` be read from ``x``? Each is fitted without a fold and scored on it, over all folds, and once
    more with its labels dealt anew by hash: ``target, n, positives, interpretable, auc, permuted_auc``. A target with
    fewer than ``least`` rows, or fewer than ``support`` of either class, is not interpretable and has no AUC.
    """
    from tidemark.operators.inference import auc, draw
    from tidemark.operators.ranks import numbered

    base = written(rows.select(row, fold, x, *targets).where(F.col(x).isNotNull()))
    mixed = numbered(base.select(row, draw(F.lit("probe"), F.col(row)).alias("_h")), ["_h", row], "_i").select(row, "_i")
    other = numbered(base.select(row, *targets, draw(F.lit("label"), F.col(row)).alias("_h")), ["_h", row], "_i").select("_i", *[F.col(c).alias(f"_p_{c}") for c in targets])
    rows = written(base.join(mixed.hint("merge"), row).join(other.hint("merge"), "_i").drop("_i"))
    stats = {c: rows.agg(F.count(c).alias("n"), F.sum(c).alias("k")).first() for c in targets}
    usable = [c for c in targets if stats[c]["n"] >= least and support <= (stats[c]["k"] or 0) <= stats[c]["n"] - support]
    labels = [n for c in usable for n in (c, f"_p_{c}")]
    table, spark = [], rows.sparkSession
    if labels:
        sums = group_sums(rows, fold, x, labels)
        fits = [Fit(frozenset((g,)), penalty, c) for g in sorted(sums["moments"]) for c in labels]
        fits = [f for f in fits if prepare(f, sums)]
        fit_all(rows, fits, fold, x, sums)
        sent = spark.sparkContext.broadcast(fits)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                by = pdf.groupby(fold).indices
                for f in sent.value:
                    if (at := by.get(next(iter(f.out)))) is not None:
                        z = f.scores(np.stack(pdf[x].iloc[at].to_list()))
                        yield pd.DataFrame({"label": f.label, "y": pdf[f.label].to_numpy()[at] == 1, "score": z[:, 1] - z[:, 0]})

        areas = {r["label"]: r["auc"] for r in auc(rows.mapInPandas(run, "label string, y boolean, score double"), "score", F.col("y"), ["label"]).collect()}
        table = [(c, areas.get(c), areas.get(f"_p_{c}")) for c in usable]
    known = {c: (a, b) for c, a, b in table}
    out = [(c, stats[c]["n"], int(stats[c]["k"] or 0), c in known, *known.get(c, (None, None))) for c in targets]
    return spark.createDataFrame(out, "target string, n long, positives long, interpretable boolean, auc double, permuted_auc double")


def class_probes(rows: DataFrame, row: str, fold: str, x: str, target: str, penalty: float = 0.1, support: int = 12) -> DataFrame:
    """Can each class of ``target`` be told from all others by ``x``? One probe per class, fitted at once; see
    ``_summed_up``. Null targets are left out."""
    labelled = rows.where(F.col(target).isNotNull())
    classes = sorted(r[0] for r in labelled.select(F.col(target).cast("string")).distinct().collect())  # a model for each
    columns = {f"_c{k}": (F.col(target).cast("string") == c).cast("int") for k, c in enumerate(classes)}
    return _summed_up(labelled.select(row, fold, x, *[c.alias(n) for n, c in columns.items()]), row, fold, x, dict(zip(columns, classes, strict=True)), penalty, support)


def label_probes(rows: DataFrame, row: str, fold: str, x: str, labels: str, penalty: float = 0.1, support: int = 20) -> DataFrame:
    """Can each label be read from ``x``, where a row has an array ``labels`` of any number of them? One probe per label,
    fitted at once; see ``_summed_up``. A null array is left out, an empty one has no label."""
    labelled = rows.where(F.col(labels).isNotNull())
    every = sorted(r[0] for r in labelled.select(F.explode(labels).alias("l")).where("l is not null").distinct().collect())  # a model for each
    columns = {f"_c{k}": F.array_contains(labels, c).cast("int") for k, c in enumerate(every)}
    return _summed_up(labelled.select(row, fold, x, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in columns.items()]), row, fold, x, dict(zip(columns, every, strict=True)), penalty, support)


def _summed_up(rows: DataFrame, row: str, fold: str, x: str, names: dict[str, str], penalty: float, support: int) -> DataFrame:
    """``class, n, positives, skipped, auc, permuted_auc`` of each class, and beside them over all classes ``usable``,
    ``worst_auc``, ``mean_auc`` and ``covered``.

    A class with fewer than ``support`` rows on either side is skipped, not scored. The worst class, the one that is read
    best, is the headline: what is claimed to be absent must be absent from every class. ``covered`` tells whether no class was
    skipped, so that a worst over a part of the classes is not taken for one over all.
    """
    names = names or {}
    got = probes(rows, row, fold, x, list(names), penalty, least=20, support=support).collect() if names else []
    areas = [r["auc"] for r in got if r["auc"] is not None]
    worst, mean = (max(areas), sum(areas) / len(areas)) if areas else (None, None)
    out = [(str(names[r["target"]]), r["n"], r["positives"], not r["interpretable"], r["auc"], r["permuted_auc"], len(areas), worst, mean, len(areas) == len(got)) for r in got]
    kinds = "class string, n long, positives long, skipped boolean, auc double, permuted_auc double, usable int, worst_auc double, mean_auc double, covered boolean"
    return rows.sparkSession.createDataFrame(out, kinds)


def ablation(rows: DataFrame, group: str, x: str, label: str, families: dict[str, list[int]], seeds: int, row: str, penalty: float = 0.1) -> DataFrame:
    """Hits over held-out groups with all features (variant ``full``) and with each family of them off:
    ``variant, seed, n, hits``. A seed leaves its own tenth of the rows out. All models are fitted at once.

    A family that names a feature the rows lack is an error before anything is fitted.
    """
    from tidemark.operators.folds import kfold

    part = F.struct(F.col(group).alias("g"), kfold(F.col(row), 10, "ablation").alias("t"))
    rows = written(rows.where(F.col(group).isNotNull() & F.col(x).isNotNull() & F.col(label).isNotNull()).select(F.to_json(part).alias("_part"), F.col(group).cast("string").alias("_g"), part["t"].alias("_t"), x, label))
    sums = group_sums(rows, "_part", x, [label])
    size = next(iter(sums["moments"].values())).shape[1] if sums["moments"] else 0
    if bad := {k: v for k, v in families.items() if size and any(j < 0 or j >= size for j in v)}:
        raise KeyError(f"unknown features: {bad}")
    parts = {r["_part"]: (r["_g"], r["_t"]) for r in rows.select("_part", "_g", "_t").distinct().collect()}  # groups times ten
    groups, models = sorted({g for g, _ in parts.values()}), []
    for name, off in {"full": [], **families}.items():
        for seed in range(seeds):
            for held in groups:
                out = frozenset(k for k, (g, t) in parts.items() if g == held or t == seed)
                fit = Fit(out, penalty, label, [j for j in range(size) if j not in off])
                if prepare(fit, sums):
                    models.append(((name, seed), [k for k, (g, t) in parts.items() if g == held and t != seed], fit))
    fit_all(rows, [m[2] for m in models], "_part", x, sums)
    hits = _hits(rows, [(key, k, f) for key, tested, f in models for k in tested], "_part", x, label)
    n: dict = {}
    for key, tested, _ in models:
        n[key] = n.get(key, 0) + sum(sum(sums["counts"][label].get(k, {}).values()) for k in tested)
    return rows.sparkSession.createDataFrame([(*key, n[key], hits.get(key, 0)) for key in n], "variant string, seed int, n long, hits long")


def dependence(rows: DataFrame, row: str, a: str, b: str, penalty: float = 0.01, holdout: int = 4) -> DataFrame:
    """Do two vectors of a row depend on each other? A model tells real pairs from pairs whose second vector is another
    row's, fitted on some rows and scored on others: ``n, accuracy, jsd`` (nats; log 2 is chance) and ``verdict``.

    Its features are the products of the vectors' components, so that only what is joint can tell. Rows are split
    before they are paired anew, so no vector is on both sides.
    """
    from tidemark.operators.folds import kfold
    from tidemark.operators.inference import draw
    from tidemark.operators.ranks import running_sums

    d = rows.select(row, F.col(a).alias("_a"), F.col(b).alias("_b"), (kfold(F.col(row), holdout, "hold") == 0).cast("int").alias("held"))
    one = F.lit(1).cast("long")
    first = running_sums(d.withColumn("_h", draw(F.lit("one"), F.col(row))), ["held"], ["_h", row], {"_i": one})
    n = first.groupBy("held").agg(F.count("*").alias("_n"))
    other = first.select("held", F.col("_i"), F.col("_b").alias("_o"))
    moved = first.join(F.broadcast(n), "held").withColumn("_i", (F.col("_i") + 1) % F.col("_n"))  # the next row's
    both = moved.join(other.hint("merge"), ["held", "_i"])
    product = lambda u, v: F.flatten(F.transform(u, lambda p: F.transform(v, lambda q: p * q)))
    pairs = both.select("held", F.explode(F.array(F.struct(F.lit(1).alias("y"), product(F.col("_a"), F.col("_b")).alias("x")), F.struct(F.lit(0).alias("y"), product(F.col("_a"), F.col("_o")).alias("x")))).alias("e")).select("held", "e.*")
    pairs = written(pairs)
    sums = group_sums(pairs, "held", "x", ["y"])
    fit = Fit(frozenset((1,)), penalty)
    spark = rows.sparkSession
    if 0 not in sums["moments"] or 1 not in sums["moments"] or not prepare(fit, sums):
        return spark.createDataFrame([(0, 0.5, float(np.log(2)), "at chance")], "n long, accuracy double, jsd double, verdict string")
    fit_all(pairs, [fit], "held", "x", sums)
    sent = spark.sparkContext.broadcast(fit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            z = sent.value.scores(np.stack(pdf["x"].to_list()))
            own = np.clip(np.where(pdf["y"] == 1, 1, -1) * (z[:, 1] - z[:, 0]), -20, 20)
            yield pd.DataFrame({"y": pdf["y"], "right": own > 0, "loss": np.log1p(np.exp(-own))})

    s = pairs.where("held = 1").mapInPandas(run, "y int, right boolean, loss double").groupBy("y").agg(F.avg(F.col("right").cast("double")).alias("r"), F.avg("loss").alias("l"), F.count("*").alias("n"))
    m = s.agg(F.max("n").alias("n"), F.avg("r").alias("accuracy"), F.avg("l").alias("jsd"))
    verdict = F.when(F.col("accuracy") <= 0.56, "at chance").when(F.col("accuracy") >= 0.9, "strongly separable").otherwise("partially separable")
    return m.select("n", "accuracy", "jsd", verdict.alias("verdict"))
