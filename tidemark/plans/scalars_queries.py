"""Projection, scalar, text, map and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import vocabulary as V
from tidemark.plans.registry import query
from tidemark.plans.windows_queries import EM, em, md5_int, r6

TYPES = ["click", "error", "purchase", "signup", "view"]
_CNT = "c AS (SELECT user_id AS k, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS {x}" for x in TYPES) + " FROM events GROUP BY 1)"


def type_map(t):
    """Per user a map of event type to count, zero counts included."""
    c = t("events").groupBy(F.col("user_id").alias("k")).agg(*[F.count_if(F.col("event_type") == x).alias(x) for x in TYPES])
    return c.select("k", F.create_map(*[y for x in TYPES for y in (F.lit(x), F.col(x))]).alias("m"))


@query("b01_key_extraction", r"""
SELECT c_custkey, regexp_extract(c_name, '(\d+)\s*$', 1) AS num, coalesce(CAST(regexp_extract(c_name, '#0*(\d+)$', 1) AS BIGINT), 0) AS stem
FROM customer
""")
def b01(t):
    return t("customer").select("c_custkey", C.trailing_number(F.col("c_name")).alias("num"), F.regexp_extract("c_name", r"#0*(\d+)$", 1).cast("long").alias("stem"))


@query("b02_normalise_entity", r"""
SELECT host, count(*) AS n, host IN (SELECT unnest(['example.com', 'example.net', 'example.org'])) AS mapped
FROM (SELECT coalesce(nullif(regexp_extract(url, '://(?:www|m|blog)\.[^./]+\.([^/?#]+)', 1), ''), nullif(regexp_extract(url, '://[^./]+\.([^/?#]+)',
  1), '')) AS host FROM pages)
GROUP BY 1
""")
def b02(t):
    host = C.first_match(F.col("url"), r"://(?:www|m|blog)\.[^./]+\.([^/?#]+)", r"://[^./]+\.([^/?#]+)")
    return t("pages").groupBy(host.alias("host")).agg(F.count("*").alias("n")).withColumn("mapped", F.col("host").isin("example.com", "example.net", "example.org"))


_LIST = "[" + ", ".join(TYPES) + "]"
_NAMES = "[" + ", ".join(f"'{x}'" for x in TYPES) + "]"


@query("b03_dominant_key", f"""
WITH {_CNT} SELECT k, CASE WHEN list_max({_LIST}) > 12 AND len(list_filter({_LIST}, lambda x: x = list_max({_LIST}))) = 1 THEN
  ({_NAMES})[list_position({_LIST}, list_max({_LIST}))] END AS top
FROM c
""")
def b03(t):
    return type_map(t).select("k", C.dominant_key(F.col("m"), 12).alias("top"))


@query("b04_active_count_and_valence", f"""
WITH {_CNT} SELECT k, CAST(len(list_filter({_LIST}, lambda x: x > 12)) AS INTEGER) AS active, CASE WHEN purchase > error THEN 'positive' WHEN purchase
  < error THEN 'negative' ELSE 'neutral' END AS cls, round((purchase - error) / 3.0::DOUBLE, 6) AS valence
FROM c
""")
def b04(t):
    m = F.col("m")
    d = m["purchase"] - m["error"]
    return type_map(t).select("k", F.size(F.map_filter(m, lambda k, v: v > 12)).alias("active"), F.when(d > 0, "positive").when(d < 0, "negative").otherwise("neutral").alias("cls"), r6(d / 3.0, "valence"))


@query("b05_selection_views", f"""
WITH {_CNT} SELECT k, k % 3 = 0 AS in_group, len(list_filter({_LIST}, lambda x: x > 15)) = 1 AS single
FROM c
WHERE k % 3 = 0 OR len(list_filter({_LIST}, lambda x: x > 15)) = 1
""")
def b05(t):
    d = type_map(t).select("k", (F.col("k") % 3 == 0).alias("in_group"), (F.size(F.map_filter("m", lambda k, v: v > 15)) == 1).alias("single"))
    return d.where("in_group or single")


@query("b06_multi_hot", f"WITH {_CNT} SELECT k, list_transform({_LIST}, lambda x: CAST(x > 13 AS INTEGER)) AS hot FROM c")
def b06(t):
    return type_map(t).select("k", C.multi_hot(F.col("m"), TYPES, 13).alias("hot"))


@query("b07_project_boxes", """
SELECT p_partkey, x0, x1, x1 - x0 AS w
FROM (SELECT p_partkey, greatest(0.0::DOUBLE, p_size * 768 / 50.0 - 100) AS x0, least(640.0::DOUBLE, p_size * 768 / 50.0 + 60) AS x1 FROM part)
WHERE x1 - x0 >= 40
""")
def b07(t):
    mid = F.col("p_size") * 768 / 50.0
    d = t("part").select("p_partkey", F.greatest(F.lit(0.0), mid - 100).alias("x0"), F.least(F.lit(640.0), mid + 60).alias("x1"))
    return d.withColumn("w", F.col("x1") - F.col("x0")).where("w >= 40")


@query("b08_bounding_box", f"""
WITH {EM} SELECT vec_id, round(list_min(x[1:32]) - 0.1 * (list_max(x[1:32]) - list_min(x[1:32])), 6) AS x0,
  round(list_max(x[33:64]) + 0.1 * (list_max(x[33:64]) - list_min(x[33:64])), 6) AS y1
FROM m
""")
def b08(t):
    box = C.bounding_box(F.slice("x", 1, 32), F.slice("x", 33, 32), 0.1)
    return em(t).select("vec_id", r6(box["x0"], "x0"), r6(box["y1"], "y1"))


@query("b09_rotation_angles", f"""
WITH {EM} SELECT vec_id, round(degrees(atan2(x[4], x[1])), 6) AS turn, round(degrees(-asin(greatest(-1, least(1, x[7])))), 6) AS nod,
  round(degrees(atan2(x[8], x[9])), 6) AS tilt
FROM m
""")
def b09(t):
    a = C.rotation_angles(F.col("x"))
    return em(t).select("vec_id", *[r6(a[n], n) for n in ("turn", "nod", "tilt")])


@query("b10_named_subset_mean", f"WITH {EM} SELECT vec_id, round((x[4] + x[8] + x[16]) / 3, 6) AS mean FROM m")
def b10(t):
    index = {f"c{j}": j for j in range(64)}
    return em(t).select("vec_id", r6(C.subset_mean(F.col("x"), index, ["c3", "c7", "c15"]), "mean"))


@query("b11_height_along_own_axis", f"""
WITH {EM} SELECT vec_id, round(list_inner_product(list_transform(list_zip(x[7:9], x[1:3]), lambda z: z[1] - z[2]),
  list_transform(list_zip(x[4:6], x[1:3]), lambda z: z[1] - z[2])) / list_sum(list_transform(list_zip(x[4:6], x[1:3]), lambda z:
  pow(z[1] - z[2], 2))), 4) AS height
FROM m
""")
def b11(t):
    minus = lambda a, b: F.zip_with(F.slice("x", a, 3), F.slice("x", b, 3), lambda p, q: p - q)
    axis, point = minus(4, 1), minus(7, 1)
    return em(t).select("vec_id", F.round(C.dot(point, axis) / C.dot(axis, axis), 4).alias("height"))


@query("b12_assign_two_slots", f"""
WITH {EM},
d AS (SELECT vec_id, abs(x[1] - x[3]) + abs(x[2] - x[4]) AS straight, abs(x[1] - x[4]) + abs(x[2] - x[3]) AS crossed, x[1] <= x[2] AS ordered FROM m)
SELECT vec_id, CASE WHEN straight < crossed THEN 'straight' WHEN crossed < straight THEN 'crossed' WHEN ordered THEN 'straight' ELSE 'crossed' END AS
  slot
FROM d
""")
def b12(t):
    x = F.col("x")
    straight, crossed = F.abs(x[0] - x[2]) + F.abs(x[1] - x[3]), F.abs(x[0] - x[3]) + F.abs(x[1] - x[2])
    return em(t).select("vec_id", F.when(straight < crossed, "straight").when(crossed < straight, "crossed").when(x[0] <= x[1], "straight").otherwise("crossed").alias("slot"))


_PROB = "p AS (SELECT vec_id, k, list_transform(x[1:8], lambda e: e * e / list_sum(list_transform(x[1:8], lambda f: f * f))) AS p FROM m)"


def probabilities(t):
    sq = F.transform(F.slice("x", 1, 8), lambda e: e * e)
    return em(t).select("vec_id", "k", F.transform(sq, lambda e: e / C.total(sq)).alias("p"))


@query("b13_probability_readouts", f"""
WITH {EM},
{_PROB} SELECT vec_id, round(p[1] + p[3] + p[5], 6) AS mass, CAST(list_position(p, list_max(p)) AS BIGINT) AS top
FROM p
""")
def b13(t):
    p = F.col("p")
    return probabilities(t).select("vec_id", r6(p[0] + p[2] + p[4], "mass"), F.array_position("p", F.array_max("p")).alias("top"))


@query("b14_normalise_text", r"""SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(trim(text), '^[''"]+|[''"]+$', '', 'g'), '\s+', ' ', 'g')))) AS h FROM documents""")
def b14(t):
    return t("documents").select("doc_id", F.md5(C.plain_text(F.col("text"))).alias("h"))


RULES = [("click", None, "touch"), ("view", "high", "gaze"), ("view", None, "look"), ("error", "low", "minor"), ("error", "high", "major"), ("error", None, "fault"), ("error", "high", "alarm")]


@query("b15_rule_mapping", """
SELECT event_id, CASE event_type WHEN 'click' THEN ['touch'] WHEN 'view' THEN CASE WHEN value > 50 THEN ['gaze', 'look'] ELSE ['look'] END WHEN
  'error' THEN CASE WHEN value > 50 THEN ['alarm', 'major', 'fault'] ELSE ['minor', 'fault'] END ELSE CAST([] AS VARCHAR[]) END AS markers
FROM events
""")
def b15(t):
    d = t("events").select("event_id", "event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("bucket"))
    rules = d.sparkSession.createDataFrame(RULES, "label string, value string, marker string")
    return C.apply_rules(d, rules, "event_type", "bucket").select("event_id", "markers")


_A, _Z = r"(?:^|[^\p{L}\p{N}])", r"(?:$|[^\p{L}\p{N}])"
CUES = {"negation": f"{_A}(no|not|ne|nicht){_Z}", "question": f"{_A}(what|que|was){_Z}", "licence": r"(licensed under[^.]*)", "quantity": r"(\d+(?:\.\d+)?)", "insult": f"{_A}(idiot|stupid|moron|trash){_Z}"}


@query("b16_vocabulary_parse", "SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '') AS {k}" for k, p in CUES.items()) + " FROM documents")
def b16(t):
    m = t("documents").select("doc_id", C.cue_map(F.col("text"), CUES).alias("m"))
    return m.select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in CUES])


@query("b17_unpivot_text_columns", """
SELECT conv_id, turn, field, cell
FROM (SELECT conv_id, turn, 'role' AS field, trim(role) AS cell FROM conversations UNION ALL SELECT conv_id, turn, 'text', trim(text) FROM
  conversations)
WHERE cell <> '' AND lower(cell) <> 'nan'
""")
def b17(t):
    d = t("conversations").select("conv_id", "turn", "role", "text")
    u = d.unpivot(["conv_id", "turn"], ["role", "text"], "field", "cell").withColumn("cell", F.trim("cell"))
    return u.where((F.col("cell") != "") & (F.lower("cell") != "nan"))


_CW = {k: CUES[k] for k in ("negation", "question", "quantity")}
_CUE_ROWS = " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS cue, regexp_extract(text, '(?i){p}', 1) AS span FROM conversations" for k, p in _CW.items())


def conversation_cues(t):
    m = t("conversations").select("conv_id", "turn", C.cue_map(F.col("text"), _CW).alias("m"))
    return m.select("conv_id", "turn", F.explode("m").alias("cue", "span"))


@query("b18_first_seen_cues", f"""
WITH q AS ({_CUE_ROWS})
SELECT conv_id, cue, arg_min(span, turn) AS span, min(turn) AS turn
FROM q
WHERE span <> ''
GROUP BY 1, 2
""")
def b18(t):
    return conversation_cues(t).groupBy("conv_id", "cue").agg(F.min_by("span", "turn").alias("span"), F.min("turn").alias("turn"))


@query("b19_vocabulary_coverage", f"""
WITH q AS ({_CUE_ROWS}),
g AS (SELECT conv_id, count(*) FILTER (WHERE span <> '') AS n FROM q GROUP BY 1)
SELECT count(*) AS entities, count(*) FILTER (WHERE n > 0) AS covered, count(*) FILTER (WHERE n = 0) AS unmapped
FROM g
""")
def b19(t):
    n = t("conversations").select("conv_id", F.size(C.cue_map(F.col("text"), _CW)).alias("n")).groupBy("conv_id").agg(F.sum("n").alias("n"))
    return n.agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 0).alias("covered"), F.count_if(F.col("n") == 0).alias("unmapped"))


#: What annotators write of faces and hands; each text of the conversations carries one of these, by its place
NOTES = [
    "eyebrows lifted at the end", "frowning", "shaking the head", "nods twice", "head cocked", "lips pressed", "a broad grin", "widened eyes", "blinks", "glances away", "very small signs", "hurried", "slowly",
    "repeated", "with emphasis", "hand spelling", "hesitates", "upright posture", "seems surprised", "conveys worry", "nothing of note",
]
_NOTED = "noted AS (SELECT conv_id, turn, text || ' ' || [" + ", ".join(f"'{n}'" for n in NOTES) + f"][(conv_id * 5 + turn) % {len(NOTES)} + 1] AS text FROM conversations), "


def noted(t):
    note = F.element_at(F.array(*[F.lit(n) for n in NOTES]), ((F.col("conv_id") * 5 + F.col("turn")) % len(NOTES) + 1).cast("int"))
    return t("conversations").select("conv_id", "turn", F.concat_ws(" ", "text", note).alias("text"))


_MOVED = _NOTED + "mv AS (SELECT conv_id, turn, text, unnest([" + ", ".join(f"{{'cue': '{k}', 'span': {V.span_sql(p)}}}" for k, (p, _) in V.MOVEMENTS.items()) + "], recursive := true) FROM noted)"
_READ = "list_filter([" + ", ".join(V.span_sql([p]) for p in V.READINGS) + "], lambda x: x IS NOT NULL)"


@query("b16_movements_and_readings", f"""
WITH {_MOVED} SELECT conv_id, turn, list_sort(list(cue || '=' || span) FILTER (WHERE span IS NOT NULL)) AS moved, any_value({_READ}) AS read
FROM mv
GROUP BY ALL HAVING count(span) > 0 OR len(any_value({_READ})) > 0
""")
def b16_whole(t):
    """All movements with what names them, and all readings, of every text that has any."""
    d = noted(t).select("conv_id", "turn", F.map_entries(V.movements(F.col("text"))).alias("m"), V.readings(F.col("text")).alias("read"))
    d = d.where((F.size("m") > 0) | (F.size("read") > 0))
    return d.select("conv_id", "turn", F.when(F.size("m") > 0, F.array_sort(F.transform("m", lambda e: F.concat_ws("=", e["key"], e["value"])))).alias("moved"), "read")


def moved(t):
    return noted(t).select("conv_id", "turn", V.movements(F.col("text")).alias("m"))


@query("b19_texts_with_movements", f"""
WITH {_MOVED},
x AS (SELECT conv_id, turn, count(span) AS n FROM mv GROUP BY 1, 2)
SELECT count(*) AS texts, count(*) FILTER (WHERE n > 0) AS with_movement, count(*) FILTER (WHERE n = 0) AS reading_only, round(avg((n > 0)::INT), 4)
  AS coverage
FROM x
""")
def b19_whole(t):
    n = F.size("m")
    return moved(t).agg(F.count("*").alias("texts"), F.count_if(n > 0).alias("with_movement"), F.count_if(n == 0).alias("reading_only"), F.round(F.avg((n > 0).cast("double")), 4).alias("coverage"))


_EXPECT = "xp AS (SELECT unnest([" + ", ".join(f"{{'cue': '{k}', 'expects': {e!r}}}" if e else f"{{'cue': '{k}', 'expects': CAST([] AS VARCHAR[])}}" for k, (_, e) in V.MOVEMENTS.items()) + "], recursive := true))"


@query("b19_expectations", f"""
WITH {_MOVED},
{_EXPECT},
n AS (SELECT cue, count(*) AS n FROM mv WHERE span IS NOT NULL GROUP BY 1)
SELECT xp.cue, array_to_string(expects, ',') AS expects, len(expects) > 0 AS testable, coalesce(n, 0) AS texts
FROM xp
LEFT JOIN n USING (cue)
""")
def b19_expectations(t):
    """Per movement the features it should show in and how many texts name it; one without features is unmapped."""
    n = moved(t).select(F.explode(F.map_keys("m")).alias("cue")).groupBy("cue").agg(F.count("*").alias("n"))
    x = t.spark.createDataFrame([(k, ",".join(e)) for k, (_, e) in V.MOVEMENTS.items()], "cue string, expects string")
    return x.join(n.hint("merge"), "cue", "left").select("cue", "expects", (F.col("expects") != "").alias("testable"), F.coalesce("n", F.lit(0)).alias("texts"))


@query("b20_tokens_without_asides", r"""
SELECT conv_id, turn, list_filter(regexp_split_to_array(upper(trim(regexp_replace(regexp_replace('(que) ' || replace(text, 'ß', 'SS') ||
  ' (aside) end', '(?i)[(\[]\s*(que|what)\s*[)\]]', '\1', 'g'), '[(\[][^)\]]*[)\]]', ' ', 'g'))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tokens
FROM conversations
""")
def b20(t):
    c = F.concat(F.lit("(que) "), "text", F.lit(" (aside) end"))
    return t("conversations").select("conv_id", "turn", C.tokens_without_asides(c, "que|what").alias("tokens"))


_TOK = r"""
k AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(upper(trim(replace(text, 'ß', 'SS'))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tk FROM
  conversations)
"""


@query("b21_lexical_labels", f"""
WITH {_TOK},
e AS (SELECT conv_id, turn, list_filter(tk[1:6], lambda x: x IN ('THE', 'LA', 'DER', 'QUE')) AS ev FROM k)
SELECT conv_id, turn, len(ev) > 0 AS present, ev[1:8] AS evidence, CASE WHEN len(ev) > 0 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
  'lexical' AS provenance
FROM e
""")
def b21(t):
    tk = C.tokens_without_asides(F.regexp_replace("text", r"[()\[\]]", " "), "que")
    return t("conversations").select("conv_id", "turn", C.any_of(tk, ["THE", "LA", "DER", "QUE"], first=6).alias("l")).select("conv_id", "turn", "l.*")


@query("b22_session_clock_mapping", """
SELECT event_id, CASE WHEN f >= 1000 THEN CAST(floor((f - 1000) * 24 / 30.0 + 0.5) + 1 AS BIGINT) END AS frame
FROM (SELECT event_id, CAST(floor(value * 30) AS BIGINT) AS f FROM events)
""")
def b22(t):
    f = F.floor(F.col("value") * 30).cast("long")
    return t("events").select("event_id", C.session_to_clip(f, F.lit(1000), F.lit(24)).alias("frame"))


@query("b23_ordering_rules", f"""
WITH {EM} SELECT vec_id, x[1] <= x[2] AS r1, x[3] <= x[4] AS r2, x[5] <= x[1] AS r3, x[1] <= x[2] AND x[3] <= x[4] AND x[5] <= x[1] AS ok
FROM m
""")
def b23(t):
    x = F.col("x")
    rules = {"r1": x[0] <= x[1], "r2": x[2] <= x[3], "r3": x[4] <= x[0]}
    return em(t).select("vec_id", *[c.alias(n) for n, c in rules.items()], F.forall(F.array(*rules.values()), lambda c: c).alias("ok"))


@query("b25_blinding_token", """
SELECT doc_id, substr(sha256('seed:' || doc_id), 1, 8) AS token, CASE WHEN ('0x' || substr(md5('side:' || doc_id), 1, 8))::BIGINT % 2 = 0 THEN 'A'
  ELSE 'B' END AS side, NOT regexp_matches(text, '(?i)licen[cs]e|rights') AS blind
FROM documents
""")
def b25(t):
    key = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", C.blind_token(F.lit("seed"), key).alias("token"), F.when(md5_int(F.lit("side"), key) % 2 == 0, "A").otherwise("B").alias("side"), (~F.col("text").rlike("(?i)licen[cs]e|rights")).alias("blind"))


@query("b26_numbers_in_text_and_json", r"""
SELECT 'doc' AS origin, doc_id AS id, CAST(unnest(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS DOUBLE) AS num
FROM documents
UNION ALL SELECT 'json', event_id, CAST(props->>'$.k' AS DOUBLE)
FROM events
""")
def b26(t):
    d = t("documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), 0)).alias("num")).withColumn("num", F.col("num").cast("double"))
    j = t("events").select(F.lit("json"), "event_id", F.explode(F.map_values(F.from_json("props", "map<string,double>"))))
    return d.union(j)


@query("b27_class_weights", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, round(sum(n) OVER () / (n * count(*) OVER ())::DOUBLE, 6) AS weight, round(greatest(0.5, least(10, (sum(n) OVER () - n) / n::DOUBLE)),
  6) AS pos_weight
FROM c
""")
def b27(t):
    c = t("embeddings").groupBy("label").agg(F.count("*").alias("n"))
    top = c.agg(F.sum("n").alias("all"), F.count("*").alias("m"))
    j = c.crossJoin(F.broadcast(top))  # one row
    return j.select("label", r6(F.col("all") / (F.col("n") * F.col("m")), "weight"), r6(F.greatest(F.lit(0.5), F.least(F.lit(10.0), (F.col("all") - F.col("n")) / F.col("n"))), "pos_weight"))
