"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import (
    classifier, decontaminate, divergence, embedding_dedup, line_dedup, packing, passages, pii, prefix_trie, quality_rules, secrets, simhash,
    url_rules,
)
from leadloom.llm.common import parked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their site, which is ``source``."""
    out = line_dedup.drop_site_lines(table(spark, sf_dir, "documents"), "source", "text")
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


OP1_SQL = f"""
WITH pages AS (
  SELECT row_number() OVER () AS page, doc_id, source, text FROM documents
), lines AS (
  SELECT page, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM pages
), keyed AS (
  SELECT page, source, line, pos,
         nullif(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '') AS k
  FROM lines
), totals AS (
  SELECT source, count(*) AS total FROM pages GROUP BY 1
), often AS (
  SELECT source, k, count(DISTINCT page) AS n FROM keyed
  WHERE source IS NOT NULL AND k IS NOT NULL GROUP BY 1, 2
), gone AS (
  SELECT source, k FROM often JOIN totals USING (source)
  WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.MAX_RATIO} * total
), judged AS (
  SELECT keyed.*, gone.k IS NOT NULL AS g
  FROM keyed LEFT JOIN gone ON keyed.source = gone.source AND keyed.k = gone.k
), merged AS (
  SELECT page, count(k) AS n_lines, count(*) FILTER (g) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT g), '') AS text
  FROM judged GROUP BY 1
)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, merged.text
FROM pages LEFT JOIN merged USING (page)
"""


#: A quarter of the documents is held out: their labels are never read.
HELD_OUT = 2
KEEP_SCORE = 0.7


def fold(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4))


def quality_model(spark: SparkSession, sf_dir: str) -> classifier.Model:
    """Fitted on labelled documents outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id") != HELD_OUT)
    return classifier.fit(table(spark, sf_dir, "documents"), labels, "doc_id", "text", "quality")


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, whole texts."""
    model = quality_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", (F.coalesce(fold("doc_id"), F.lit(-1)) == HELD_OUT).alias("held_out"), classifier.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; equal texts are one blob and are scanned once.

    An earlier scan, of the documents with an even hash of their id and with version 0 of the hex rule, has left a ledger. The scan
    of all documents looks at the blobs that are not in it, and at all blobs with the rule that changed.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rules = tuple(replace(r, version=0) if r.kind == "hex" else r for r in secrets.RULES)
    ledger = parked(secrets.scan_unseen(earlier, "text", rules), "earlier-ledger")
    found, _ = secrets.scan(docs, "text", ledger)
    listed = secrets.listed()
    counts = [F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def _places_sql(rule: secrets.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "(?i)(password|passwd|secret|token|api_?key)")
    # Possessive repeats are a matter of speed only.
    pattern = pattern.removesuffix("+") if pattern.endswith("}+") else pattern
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT n, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least,
      unnest(string_split_regex(t, {quoted})[1:len(regexp_extract_all(t, {quoted}))]) AS gap,
      unnest(regexp_extract_all(t, {quoted})) AS hit, unnest(regexp_extract_all(t, {quoted}, {rule.group})) AS part,
      generate_subscripts(regexp_extract_all(t, {quoted}), 1) AS i FROM docs"""


OP3_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents
), hits AS (
  {" UNION ALL ".join(_places_sql(r, i) for i, r in enumerate(secrets.RULES))}
), placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY n, kind ORDER BY i) AS e FROM hits
), listed AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || (e - length(hit))::bigint || ':' || e::bigint, ',' ORDER BY e - length(hit), rank) AS spans
  FROM placed WHERE length(part) >= least GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (n)
"""


def op4_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_weak_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures, votes and verdict of all documents."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", F.round("good_probability", 6).alias("good_probability"))


def op6_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: fixed forms, and words in their contexts."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = [F.size(f"spans_{f.kind}").cast("long").alias(f"n_{f.kind}") for f in pii.FORMS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(context=False), 256).alias("base_sha256"), pii.listed().alias("spans")
    )


#: The rules of the query, as host, path and verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op7_interval_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all URLs."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", rules)


OP7_SQL = f"""
WITH rules (h, p, v) AS (
  VALUES {", ".join(str(r) for r in URL_RULES)}
), rest AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages
), parts AS (
  SELECT n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, '{url_rules.DEFAULT}') AS verdict
FROM parts LEFT JOIN fits USING (n)
"""


def op8_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items, up to a few edits."""
    found = decontaminate.find_items(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text"
    )
    return found.withColumnsRenamed({"doc_key": "doc_id", "item_key": "item_id"})


def op9_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's passages that repeat in others: where, with which one, and the class of passages they belong to."""
    found = passages.passage_classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnsRenamed({"doc": "doc_id", "partner": "partner_id", "class_doc": "class_id"})


def op10_binary_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of power-of-two lengths."""
    out = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op11_count_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source stands from the others of its language, and by which terms."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"), "text", "lang", "source")


OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), words AS (
  SELECT n, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs
), held AS (
  SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT n) >= {divergence.MIN_DOCS}
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, coalesce(c, 0) AS c
  FROM groups JOIN kept USING (lang) LEFT JOIN held USING (lang, source, term)
), shares AS (
  SELECT *, 1 + ({divergence.SCALE}::hugeint * (c + 1)) // (sum(c) OVER g + count(*) OVER g) AS p
  FROM counts WINDOW g AS (PARTITION BY lang, source)
), whole AS (
  SELECT lang, term, 1 + ({divergence.SCALE}::hugeint * (c + 1)) // (sum(c) OVER g + count(*) OVER g) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) WINDOW g AS (PARTITION BY lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::bigint AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::int AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


def op12_splitter_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit, as DuckDB has no such function.
OP12_SQL = """
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, 4294967295::bigint AS crc, 1 AS i, 0 AS bit FROM ids
  UNION ALL
  SELECT c, CASE WHEN bit = 0 THEN xor(crc, ascii(substr(c::varchar, i, 1))) ELSE
           CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END END,
         CASE WHEN bit = 8 THEN i + 1 ELSE i END, (bit + 1) % 9
  FROM crc WHERE i <= length(c::varchar)
), heads AS (
  SELECT c, xor(crc, 4294967295) % 4 AS h FROM crc WHERE i > length(c::varchar)
), told AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, sha256(strlen(role)::varchar || ':' || role || text) AS d,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role)::varchar || ':' || role || text)) AS n
  FROM told
), rebuilt AS (
  SELECT heads.c, d, words, n FROM heads JOIN own ON own.c = heads.c - heads.c % 20 AND n <= h
  UNION ALL SELECT heads.c, d, words, n + 1000000 FROM heads JOIN own ON own.c = heads.c AND n > h
), paths AS (
  SELECT heads.c, coalesce(list(d ORDER BY n) FILTER (d IS NOT NULL), []) AS p,
         coalesce(list(words ORDER BY n) FILTER (d IS NOT NULL), []) AS w
  FROM heads LEFT JOIN rebuilt USING (c) GROUP BY 1
), members AS (
  SELECT c, unnest(range(0, len(p) + 1)) AS depth, p, w FROM paths
), nodes AS (
  SELECT p[1:depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN w[depth] ELSE 0 END) AS words,
         sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (len(p) = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2
), kids AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), shown AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), above AS (
  SELECT path[1:a] AS path, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM shown) GROUP BY 1
)
SELECT x.conv_id, x.depth::bigint AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves,
       saved_tokens::bigint AS saved_tokens, x.ends_sha256
FROM shown x JOIN above USING (path) LEFT JOIN nodes up ON x.depth > 0 AND up.path = x.path[1:x.depth - 1]
"""


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_lines": op1_site_lines,
    "op2_subword_quality": op2_subword_quality,
    "op3_blob_ledger": op3_blob_ledger,
    "op4_gray_index": op4_gray_index,
    "op5_weak_votes": op5_weak_votes,
    "op6_bootstrapped_contexts": op6_bootstrapped_contexts,
    "op7_interval_sweep": op7_interval_sweep,
    "op8_pigeonhole_edits": op8_pigeonhole_edits,
    "op9_collinear_chains": op9_collinear_chains,
    "op10_binary_pieces": op10_binary_pieces,
    "op11_count_bitmaps": op11_count_bitmaps,
    "op12_splitter_skeleton": op12_splitter_skeleton,
    "op13_projection_forest": op13_projection_forest,
}
ORACLES: dict[str, str] = {
    "op1_site_lines": OP1_SQL, "op3_blob_ledger": OP3_SQL, "op7_interval_sweep": OP7_SQL, "op11_count_bitmaps": OP11_SQL,
    "op12_splitter_skeleton": OP12_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
