"""One query per operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _held_out(by: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % by == remainder, F.lit(False))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_decontam import report

    return report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM dg d JOIN win i ON d.n = i.n AND d.g = i.g),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op5_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_frequency import drop_site_lines

    out = drop_site_lines(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.col("text").alias("clean_text"))


OP5_SQL = """
WITH pg AS MATERIALIZED (SELECT *, row_number() OVER () AS page FROM documents),
l AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pg WHERE text IS NOT NULL),
tot AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
cnt AS (SELECT source, trim(line) AS k, count(DISTINCT page) AS c FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
everywhere AS (SELECT k, sum(c) AS g, (SELECT count(*) FROM documents) AS pages FROM cnt GROUP BY 1),
bad AS (SELECT cnt.source, k FROM cnt JOIN everywhere USING (k) JOIN tot ON cnt.source IS NOT DISTINCT FROM tot.source
        WHERE c + CASE WHEN n < pages THEN 80e0 * (g - c) / (pages - n) ELSE 0e0 END > 0.05e0 * (n + 80e0)),
m AS (SELECT l.*, bad.k IS NOT NULL AS is_bad FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND trim(l.line) = bad.k),
a AS (SELECT page, count(*) AS n_lines, count(*) FILTER (WHERE is_bad) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT is_bad), '') AS clean_text FROM m GROUP BY 1)
SELECT d.doc_id, d.source, CAST(coalesce(a.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(a.n_dropped, 0) AS BIGINT) AS n_dropped, a.clean_text FROM pg d LEFT JOIN a USING (page)
"""


def op2_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_markov import judge

    return judge(_t(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("llr", 6).alias("llr"))


def op6_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ftrl_toxicity import learn, score

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    held = _held_out(5, 0)
    labels = _t(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("toxic").alias("label"))
    model = learn(docs, labels)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.cross_parsing import identify, learn

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = _held_out(3, 1)
    model = learn(docs.where(~held))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm._base import Scratch
    from tidemark.llm.bit_packing import read_ids, write_ids

    out = Scratch(spark, "op10").path
    write_ids(_t(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408)
    return read_ids(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.order_minhash import near_duplicates

    return near_duplicates(_t(spark, sf_dir, "documents"))


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hilbert_ann import nearest

    return nearest(_t(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.site_quality import classify, learn

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    held = _held_out(5, 0)
    labels = _t(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    model = learn(docs, labels)
    out = classify(docs, model, keep_text=False)
    return out.select("doc_id", held.alias("held_out"), "p_doc", "p_host", "p_path", "p_good", "predicted")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.best_fit_packing import pack_texts

    return pack_texts(_t(spark, sf_dir, "documents"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties it, 2 takes its end marks, 3
    repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"))


def op11_conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.conversation_audit import audits

    return audits(_damaged(_t(spark, sf_dir, "conversations")), dropped="dropped", times="times")


OP11_SQL = r"""
WITH RECURSIVE t256 AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) for i in range(256)] AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, [CAST(unicode(x) AS BIGINT) for x in string_split(key, '')]), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS kind FROM raw, t256),
dam AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM dam),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM num),
moves(s, letter, needs, cost, d) AS (VALUES (0, 'D', '', 4, 0), (1, 'D', '', 4, 1), (2, 'D', '', 4, 2), (3, 'D', '', 4, 3), (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (3, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (0, 'R', 'user', 3, 2), (1, 'R', 'user', 3, 2), (3, 'R', 'user', 3, 2), (2, 'R', 'assistant', 3, 3)),
closing(s, d, tail, text, cost) AS (VALUES (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0), (0, 2, 'I', 'user:' || chr(10), 3), (1, 2, 'I', 'user:' || chr(10), 3), (3, 2, 'I', 'user:' || chr(10), 3), (2, 3, 'I', 'assistant:' || chr(10), 3), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 6), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 6)),
dp(conv_id, i, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), d, {'cost': CAST(closing.cost AS BIGINT), 'audit': tail, 'text': closing.text} FROM (SELECT DISTINCT conv_id FROM dam), closing WHERE closing.s = 0
  UNION ALL
  SELECT p.conv_id, p.i + 1, c.d, min({'cost': p.best.cost + m.cost + c.cost + CASE WHEN f.fault = 'truncated' AND m.letter <> 'D' THEN 3 ELSE 0 END, 'audit': p.best.audit || m.letter || c.tail,
      'text': p.best.text || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE m.needs || ':' || f.text || chr(10) END || c.text})
  FROM dp p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN moves m ON m.s = p.s AND (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.letter = 'R' OR m.needs = f.c)) JOIN closing c ON c.s = m.d
  GROUP BY p.conv_id, p.i + 1, c.d),
ends AS (SELECT conv_id, max(i) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE i > 1 AND b || c NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY 1),
won AS (SELECT dp.conv_id, min(best) AS best FROM dp JOIN ends e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = e.n WHERE s IN (0, 3) GROUP BY 1),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.text[:len(best.text) - 1], '')) AS repaired_sha256
FROM ids LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def op12_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.histogram_packing import pack_documents

    return pack_documents(_t(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)


def op13_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.phrase_tiles import collocations

    return collocations(_t(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pc WHERE p <> ''),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, ph, count(*) AS f FROM (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS ph FROM w, range(1, 6) r(m) WHERE len(w) >= m) GROUP BY 1, 2, 3),
c AS (SELECT lang, m, ph, f, string_split(ph, ' ') AS q FROM g WHERE m >= 2 AND f >= 100),
sup AS (SELECT lang, s AS ph, max(f) AS best FROM (SELECT lang, f, m, unnest(flatten([[array_to_string(q[i:i + k - 1], ' ') for i in range(1, m - k + 2)] for k in range(2, m)])) AS s FROM c WHERE m > 2) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN sup USING (lang, ph) WHERE best IS NULL OR 100 * best < 100 * f),
cut AS (SELECT lang, ph, f, m, k, array_to_string(q[:k], ' ') AS x, array_to_string(q[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
sc AS (SELECT cut.lang, cut.ph, cut.f AS a, k, gx.f AS l, gy.f AS r, n, CAST((CAST(1000 AS HUGEINT) * cut.f * n) // (CAST(gx.f AS HUGEINT) * gy.f) AS BIGINT) AS score
       FROM cut JOIN g gx ON gx.lang = cut.lang AND gx.ph = x AND gx.m = k JOIN g gy ON gy.lang = cut.lang AND gy.ph = y AND gy.m = cut.m - k JOIN tot ON tot.lang = cut.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank FROM low WHERE o = 1)
SELECT lang, rank, ph AS phrase, a, l, r, n, score FROM rk WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_suffix_array_decontamination": op3_suffix_array_decontamination,
    "op5_site_line_dedup": op5_site_line_dedup,
    "op1_order_minhash": op1_order_minhash,
    "op2_url_markov_ratio": op2_url_markov_ratio,
    "op4_hilbert_neighbours": op4_hilbert_neighbours,
    "op7_site_quality": op7_site_quality,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op6_ftrl_toxicity": op6_ftrl_toxicity,
    "op8_cross_parsing_language": op8_cross_parsing_language,
    "op10_bit_packed_ids": op10_bit_packed_ids,
    "op11_conversation_audit": op11_conversation_audit,
    "op12_histogram_packing": op12_histogram_packing,
    "op13_tiled_collocations": op13_tiled_collocations,
}
SQL: dict[str, str] = {"op3_suffix_array_decontamination": OP3_SQL, "op5_site_line_dedup": OP5_SQL, "op11_conversation_audit": OP11_SQL, "op13_tiled_collocations": OP13_SQL}
