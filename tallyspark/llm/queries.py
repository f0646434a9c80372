"""The registered queries of this subpackage, op1 to op13, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, langid, license_scan, mix, near_dedup, pii, quality, repair, resample, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_blocks")


def fold_of(n: int) -> Column:
    """crc32 of the identifier as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(4) == 2, F.lit(False))
    d = docs.select("doc_id", "text", held_out.alias("held_out"))
    out = langid.predict(d, langid.dictionaries(docs, ~held_out))
    return out.select("doc_id", "held_out", "lang_pred", "score", "confident")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(5) == 0, F.lit(False))
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ratings = table(spark, sf_dir, "documents"), quality.graded(table(spark, sf_dir, "labels"))
    return quality.score(docs, quality.train(docs, ratings, "grade"), select_grade=1)


#: Conversation -7 of op11: both its texts look like the template's own markers.
PLANTED = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.report(given.unionByName(spark.createDataFrame(PLANTED, given.schema)))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_license_scan": op2_license_scan,
        "op3_pii": op3_pii,
        "op4_decontaminate": op4_decontaminate,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_mix": op6_mix,
        "op7_language_id": op7_language_id,
        "op8_toxicity": op8_toxicity,
        "op9_near_dedup": op9_near_dedup,
        "op10_quality": op10_quality,
        "op11_chat_format": op11_chat_format,
        "op12_resample": op12_resample,
        "op13_conversation_repair": op13_conversation_repair,
    }


OP5 = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""


#: Words of a text, in SQL.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i2 AS (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i2)),
runs AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT r, item_id, k, p FROM runs JOIN win USING (k, s)),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS pos FROM (SELECT DISTINCT r, p, k FROM occ)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


#: Table and macro of the usual CRC-32 (polynomial 0xEDB88320) over the UTF-8 bytes of a string.
CRC32 = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS steps FROM (SELECT unnest(range(256)) AS i)),
"""


def crc32_of(name: str, source: str, key: str) -> str:
    """CTE `name` of (key, crc) for the strings `key` of `source`."""
    byte = f"CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)"
    step = f"xor(c >> 8, steps[CAST(xor(c, {byte}) & 255 AS INTEGER) + 1])"
    return f"""{name} AS (SELECT {key}, xor(list_reduce(range(CAST(len(h) / 2 AS BIGINT)), lambda c, k: {step}, CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM (SELECT {key}, hex(encode({key})) AS h FROM {source}), crc_table)"""


OP11 = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, regexp_replace(text, '(<|\[)(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]|TEXT\])', '\1\2\\\3', 'g') AS inside FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(inside) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 18 ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars,
  CAST(max(1 + len(list_distinct(regexp_extract_all(text, '(?:<|\[)\\*(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]|TEXT\])', 1)))) AS INTEGER) AS max_rounds
FROM marked GROUP BY conv_id
"""


OP12 = f"""
WITH RECURSIVE {CRC32}
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
dw AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY ALL),
tw AS (SELECT f, count(*) AS n FROM (SELECT unnest({WORDS}) AS f FROM benchmark) GROUP BY ALL),
fs AS (SELECT DISTINCT f FROM (SELECT f FROM dw UNION ALL SELECT f FROM tw)),
{crc32_of("crcs", "fs", "f")},
b AS (SELECT f, crc % 10000 AS bucket FROM crcs),
sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM (SELECT f, n AS s, 0 AS t FROM dw UNION ALL SELECT f, 0, n FROM tw) JOIN b USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM sums, total),
sw AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS g, CAST(sum(n) AS BIGINT) AS n FROM dw JOIN b USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST(floor(CAST(g AS DOUBLE) / n) AS BIGINT) ELSE 0 END AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN sw USING (r)),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM final LEFT JOIN drawn USING (r)
"""


#: Costs to the end of a conversation from each state (s: after the system row, u, a, z: nothing yet), row by row from the last.
OP13 = f"""
WITH RECURSIVE {CRC32}
rows0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
ks AS (SELECT DISTINCT k FROM rows0),
{crc32_of("crcs", "ks", "k")},
lots AS (SELECT rows0.*, crc % 20 AS lot FROM rows0 JOIN crcs USING (k)),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy FROM lots WHERE lot <> 0),
ended AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
nth AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM ended WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || ':' || text), copy)),
faults AS (SELECT conv_id, i, turn, role, text, body = '' AS blank, body <> '' AND seen > 1 AS duplicate, body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
  before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM nth),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (illegal) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
-- k rows from the end: f of each state
back AS (
  SELECT conv_id, n AS i, 0 AS z, 10 AS s, 5 AS u, 0 AS a FROM stats
  UNION ALL
  SELECT conv_id, i - 1, least(gz, 5 + gu, 10 + ga), least(gs, 5 + gu, 10 + ga), least(gu, 5 + ga), least(ga, 5 + gu)
  FROM (SELECT b.conv_id, b.i,
      least(2 + z, CASE WHEN must THEN 1000000 ELSE 1 + cut + u END, CASE WHEN must THEN 1000000 WHEN r = 's' THEN cut + s WHEN r = 'u' THEN cut + u ELSE 1000000 END) AS gz,
      least(2 + s, CASE WHEN must THEN 1000000 ELSE 1 + cut + u END, CASE WHEN NOT must AND r = 'u' THEN cut + u ELSE 1000000 END) AS gs,
      least(2 + u, CASE WHEN must THEN 1000000 ELSE 1 + cut + a END, CASE WHEN NOT must AND r = 'a' THEN cut + a ELSE 1000000 END) AS gu,
      least(2 + a, CASE WHEN must THEN 1000000 ELSE 1 + cut + u END, CASE WHEN NOT must AND r = 'u' THEN cut + u ELSE 1000000 END) AS ga
    FROM back b JOIN (SELECT conv_id, i, role[1] AS r, blank OR duplicate AS must, CASE WHEN truncated THEN 5 ELSE 0 END AS cut FROM faults) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i)
),
f AS (SELECT b.conv_id, b.i + 1 AS i, map {{'z': z, 's': s, 'u': u, 'a': a}} AS f FROM back b),
-- the first of D, I, K, R that keeps to the least cost
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 'z' AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM stats
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
    CASE e WHEN 'D' THEN q WHEN 'K' THEN r ELSE nq END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, nrole || ':' || text) ELSE list_append(lines, nrole || ':') END
  FROM (SELECT w.*, nq, nrole, c.role, c.text, c.role[1] AS r,
      CASE WHEN c.i IS NOT NULL AND g.f[w.q] = 2 + h.f[w.q] THEN 'D' WHEN g.f[w.q] = 5 + g.f[nq] THEN 'I'
        WHEN c.i IS NOT NULL AND NOT (blank OR duplicate) AND (c.role[1] = 's' AND w.q = 'z' OR c.role[1] IN ('u', 'a') AND c.role[1] = nq) AND g.f[w.q] = (CASE WHEN truncated THEN 5 ELSE 0 END) + h.f[c.role[1]] THEN 'K'
        WHEN c.i IS NOT NULL THEN 'R' END AS e
    FROM (SELECT *, CASE WHEN q = 'u' THEN 'a' ELSE 'u' END AS nq, CASE WHEN q = 'u' THEN 'assistant' ELSE 'user' END AS nrole FROM walk) w
    JOIN f g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i
    LEFT JOIN f h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i + 1
    LEFT JOIN faults c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i)
  WHERE e IS NOT NULL
),
done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(f.f['z'], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4, "op5_exact_dedup": OP5, "op11_chat_format": OP11, "op12_resample": OP12, "op13_conversation_repair": OP13}
