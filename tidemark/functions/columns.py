"""Scalar column functions: keys, text, maps, geometry and rules. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trailing_number(c: Column) -> Column:
    """Trailing digits of a text, NULL without any."""
    return F.nullif(F.regexp_extract(c, r"(\d+)\s*$", 1), F.lit(""))


def first_match(c: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def dominant_key(m: Column, floor: float) -> Column:
    """Key of a map's largest value; NULL if none is above the floor or several share it."""
    above = F.map_filter(m, lambda k, v: v > floor)
    top = F.array_max(F.map_values(above))
    keys = F.map_keys(F.map_filter(above, lambda k, v: v == top))
    return F.when(F.size(keys) == 1, keys[0])


def multi_hot(m: Column, names: list[str], threshold: float) -> Column:
    """Flags of the names in order: value above the threshold."""
    return F.array(*[F.coalesce((F.element_at(m, n) > threshold).cast("int"), F.lit(0)) for n in names])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def subset_mean(v: Column, index: dict[str, int], names: list[str]) -> Column:
    """Mean of named coefficients of a vector; an unknown name is an error when the plan is built."""
    if missing := [n for n in names if n not in index]:
        raise KeyError(f"unknown coefficients: {missing}")
    return sum((v[index[n]] for n in names), F.lit(0.0)) / len(names)


def bounding_box(xs: Column, ys: Column, margin: float) -> Column:
    """Box of a point set grown by a share of its size; NULL if it is empty or flat."""
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    box = F.struct((F.array_min(xs) - w * margin).alias("x0"), (F.array_min(ys) - h * margin).alias("y0"), (F.array_max(xs) + w * margin).alias("x1"), (F.array_max(ys) + h * margin).alias("y1"))
    return F.when((w > 0) & (h > 0), box)


def rotation_angles(r: Column) -> Column:
    """Turn, nod and tilt in degrees from a row-major 3 x 3 matrix."""
    clip = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r[6]))
    return F.struct(F.degrees(F.atan2(r[3], r[0])).alias("turn"), F.degrees(-F.asin(clip)).alias("nod"), F.degrees(F.atan2(r[7], r[8])).alias("tilt"))


def session_to_clip(frame: Column, start: Column, fps: Column, session_fps: float = 30.0) -> Column:
    """Clip frame, from 1, of a frame on the session clock; NULL before the clip's start or without a rate."""
    return F.when((frame >= start) & (fps > 0), (F.floor((frame - start) * fps / F.lit(session_fps) + F.lit(0.5)) + 1).cast("long"))


def plain_text(c: Column) -> Column:
    """Without wrapping quotes, in lower case, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"""^['"]+|['"]+$""", ""), r"\s+", " ")))


def cue_map(c: Column, vocabulary: dict[str, str]) -> Column:
    """Map of the cues whose pattern occurs in a text to group 1 of its first match."""
    pairs = F.array(*[F.struct(F.lit(k), F.regexp_extract(c, f"(?i){p}", 1)) for k, p in vocabulary.items()])
    return F.map_from_entries(F.filter(pairs, lambda s: s["col2"] != ""))


def tokens_without_asides(c: Column, keep: str) -> Column:
    """Upper-case tokens of a text; what stands in brackets is dropped unless it matches ``keep``."""
    kept = F.regexp_replace(c, rf"(?i)[(\[]\s*({keep})\s*[)\]]", "$1")
    return F.filter(F.split(F.upper(F.trim(F.regexp_replace(kept, r"[(\[][^)\]]*[)\]]", " "))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def any_of(tokens: Column, words: list[str], first: int | None = None, most: int = 8) -> Column:
    """Label with evidence: present if a token is one of the words, the first ``most`` of them, and a confidence."""
    look = F.slice(tokens, 1, first) if first else tokens
    ev = F.filter(look, lambda x: x.isin(words))
    return F.struct((F.size(ev) > 0).alias("present"), F.slice(ev, 1, most).alias("evidence"), F.when(F.size(ev) > 0, 0.9).otherwise(0.6).alias("confidence"), F.lit("lexical").alias("provenance"))


def blind_token(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8)


def apply_rules(df: DataFrame, rules: DataFrame, label: str, value: str, out: str = "markers") -> DataFrame:
    """Markers of a (label, value) by a rule table ``(label, value or NULL, marker)``: rules that name the value come
    first, ties are alphabetical, several hits are kept. The rule table is a bounded parameter and is broadcast."""
    r = rules.select(F.col("label").alias("_l"), F.col("value").alias("_v"), "marker")
    pairs = df.select(label, value).distinct().join(F.broadcast(r), (F.col(label) == F.col("_l")) & (F.col("_v").isNull() | (F.col("_v") == F.col(value))), "left")
    hit = pairs.groupBy(label, value).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("marker").isNotNull(), F.struct(F.col("_v").isNull().alias("general"), F.col("marker").alias("m"))))), lambda s: s["m"]).alias(out))
    return df.join(hit.hint("merge"), [label, value], "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
