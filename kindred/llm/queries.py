"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import chat_trees, decontaminate, domain_mixing, language_id, line_dedup, line_quality, ngram_join, pseudonyms, secret_scan, url_trust


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = secret_scan.train(secret_scan.labelled_findings(spark), docs)
    found = secret_scan.scan_secrets(docs, forest)
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.transform("secrets", lambda s: s.start).alias("starts"))


def op6_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return domain_mixing.mix(docs, table(spark, sf_dir, "labels")).select("doc_id", "n_tokens", "domains", "posteriors", "rate", "copies", "residuals")


PII_KEY = "kindred-pseudonyms-1"


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", F.size("values").cast("long").alias("n_values"), "values", "text")


PROBE = "\\### Assistant: </turn> ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    found = chat_trees.format_paths(chat_trees.chain(rows.unionByName(probe)))
    turns = F.transform(chat_trees.read_turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    read = found.select(F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.array_join(turns, "").alias("turns"), chat_trees.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


RULES = [url_trust.Rule("allow", "org", "/"), url_trust.Rule("block", "example.org", "/es/"), url_trust.Rule("block", "example.org", "/en/1"), url_trust.Rule("allow", "com", "/fr/"), url_trust.Rule("block", "com", "/de/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_trust.judge_pages(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.label_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_domain_mixing": op6_domain_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filters": op10_url_filters,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = "[\\x20\\x09-\\x0D]+"

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '{SPACES}'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s""",
    "op2_chat_formatting": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + 2 * (length(role) - length(translate(role, '#<:\\', ''))) - (length(role) - length(translate(role, '#<:\\', ''))) AS r,
  length(text) + (length(text) - length(translate(text, '#<\\', ''))) AS t FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(r + t + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS l FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM w WHERE len(w) >= 5),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(l) AS x FROM w),
m AS (SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS c,
  len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS nw,
  length(x) - length(translate(x, '#*$%&|<>', '')) AS sy, length(x) - length(translate(x, '|•»›', '')) AS me,
  length(x) - length(translate(x, '.!?,;:…"', '')) AS pu FROM ln),
good AS (SELECT doc_id, sum(c) AS c FROM m WHERE NOT (sy * 10 > c OR (me * 4 >= nw AND me >= 2)
  OR (length(x) <= 200 AND regexp_matches(lower(x), 'cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|sign (up|in)|log ?in|click here|read more|javascript|licensed under|copyright|powered by'))
  OR (nw >= 12 AND pu = 0)) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id))
SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * coalesce(good.c, 0) >= 50 * word_chars AS kept
FROM b LEFT JOIN good USING (doc_id)""",
    "op7_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS x FROM bw WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM win),
dpos AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS x FROM dw, ms WHERE len(w) >= m),
hits AS (SELECT doc_id, m, i, item_id FROM dpos JOIN win USING (m, x)),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    # Pages of the test tables link to no other host, so ranks are 0.15 times a host's share of its side's seeds.
    "op10_url_filters": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN {LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
f AS (SELECT page_id, host, path, host = 'example.org' OR host LIKE '%.example.org' AS ex, host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com FROM u),
r AS (SELECT page_id, host, path, CASE WHEN ex AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN ex AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/' WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule FROM f),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM r),
s AS (SELECT host, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b FROM v WHERE said IS NOT NULL AND host <> '' GROUP BY host),
t AS (SELECT greatest(sum(a), 1)::DOUBLE AS a, greatest(sum(b), 1)::DOUBLE AS b FROM s)
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN s.b / t.b > s.a / t.a THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN s USING (host) LEFT JOIN t ON TRUE""",
    "op9_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
