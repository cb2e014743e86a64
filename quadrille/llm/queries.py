"""Queries of this folder, their SQL, and the parameters they run with."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, license_scan, line_dedup, near_dedup, packing, quality_model, quality_rules, secret_scan, token_rollup, topk_search
from .common import read_table, shared_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for every vector whose id is divisible by 50, against all others."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_BPE)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated and nearly repeated lines taken out."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents, counts=True)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches, one of them sent twice.

    Words are counted and inserted; a provisional count (a quarter of the characters) is
    inserted for the byte-level tokenizer, then revised to the real count; documents
    without any token are deleted again.
    """
    documents = read_table(spark, sf_dir, "documents")
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    text = F.coalesce("text", F.lit(""))
    keys = documents.select("source", "lang", text.alias("text"))
    words = keys.select("*", F.size(quality_rules.words_of(F.col("text"))).cast("long").alias("n_tokens"))
    guess = F.ceil(F.length("text") / 4).cast("long")
    first = words.select("source", "lang", F.lit("words@1").alias("tokenizer"), F.lit("insert").alias("change"), "n_tokens")
    second = keys.select("source", "lang", F.lit("byte_bpe_50k@1").alias("tokenizer"), F.lit("insert").alias("change"), guess.alias("n_tokens"))
    real = bpe.count_tokens(keys.select("source", "lang", guess.alias("old_tokens"), "text"), BYTE_BPE, ["source", "lang", "old_tokens"])
    third = real.select("source", "lang", F.lit("byte_bpe_50k@1").alias("tokenizer"), F.lit("revise").alias("change"), "n_tokens", "old_tokens")
    fourth = words.where("n_tokens = 0").select("source", "lang", F.lit("words@1").alias("tokenizer"), F.lit("delete").alias("change"), "n_tokens")
    for number, changes in enumerate((first, second, third, fourth)):
        rollup.commit(number, changes)
    rollup.commit(2, third)  # sent again: nothing happens
    return rollup.totals()


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    return quality_rules.assess(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_dedup.classes(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_quality_model": op2_quality_model,
        "op3_bpe_roundtrip": op3_bpe_roundtrip,
        "op4_packing": op4_packing,
        "op5_line_dedup": op5_line_dedup,
        "op6_token_rollup": op6_token_rollup,
        "op7_quality_rules": op7_quality_rules,
        "op8_near_dedup": op8_near_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_license_scan": op10_license_scan,
    }


# Stop words, as the rules' table has them, for the SQL.
_STOP = ", ".join(f"'{v}'" for w in quality_rules.STOP_WORDS for v in dict.fromkeys((w, w.capitalize(), w.upper())))

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, list_slice(words, i, i + 4) AS win FROM w, unnest(range(1, greatest(len(words) - 3, 1))) AS t(i)),
m AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM m, unnest(range(0, 5)) AS t(k) GROUP BY r),
b AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop
  FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND n_words >= 10 AND word_chars / n_words BETWEEN 2.0 AND 18.0
   AND n_symbols / n_words <= CAST(0.3 AS DOUBLE) AND (n_words < 50 OR n_stop / n_words >= CAST(0.02 AS DOUBLE))
   AND n_dup_lines / greatest(n_lines, 1) <= CAST(0.5 AS DOUBLE) AND n_repeat_words / n_words <= CAST(0.2 AS DOUBLE)) AS kept
FROM f
"""


def _insensitive(pattern: str) -> str:
    """A pattern whose leading (?i) is spelled out for ASCII letters, as engines differ in folding others."""
    if not pattern.startswith("(?i)"):
        return pattern
    head, tail = pattern[4:].split(")", 1)
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail


def _op9_sql() -> str:
    """Positions come from what lies between the matches, as in the operator."""
    parts, out = [], []
    for nth, rule in enumerate(secret_scan.RULES):
        pattern = _insensitive(rule.regex).replace("'", "''")
        parts.append(
            f"SELECT r, {nth} AS nth, '{rule.kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, "
            f"regexp_extract_all(text, '{pattern}', {rule.group}) AS t, regexp_split_to_array(text, '{pattern}') AS g "
            f"FROM d WHERE regexp_matches(text, '{pattern}')"
        )
    for rule in secret_scan.RULES:
        out.append(f"WHEN '{rule.kind}' THEN {rule.least}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
e AS (SELECT r, nth, kind, unnest(m) AS m, unnest(t) AS t, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM f),
p AS (SELECT r, nth, kind, t, length(m) AS n,
  sum(length(g) + length(m)) OVER (PARTITION BY r, nth ORDER BY i) AS stop FROM e),
s AS (SELECT r, nth, kind, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p
  WHERE length(t) >= CASE kind {" ".join(out)} END),
x AS (SELECT r, count(*) FILTER (WHERE nth = 0) AS a, count(*) FILTER (WHERE nth = 1) AS b, count(*) FILTER (WHERE nth = 2) AS c,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth, stop) FILTER (WHERE nth < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth, stop) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (r)
"""


def _op10_sql() -> str:
    rows = []
    for name, text in license_scan.TEMPLATES:
        pairs = ", ".join(f"'{p}'" for p in license_scan.pairs_of(text))
        rows.append(f"('{name}', [{pairs}])")
    t = license_scan.THRESHOLD
    return f"""
WITH t(license, pairs) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS text FROM documents),
u AS (SELECT r, unnest(string_split(text, chr(10))) AS unit FROM d UNION ALL
  SELECT r, b FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n *\\n[ \\n]*')) AS b FROM d)
  WHERE contains(trim(b, ' ' || chr(10)), chr(10))),
w AS (SELECT r, string_split(regexp_replace(trim(replace(unit, chr(10), ' ')), ' +', ' ', 'g'), ' ') AS words FROM u),
p AS (SELECT r, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs FROM w),
m AS (SELECT r, license, 2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice
  FROM p JOIN t ON len(p.pairs) BETWEEN len(t.pairs) * {t} / (2 - {t}) - 1e-9 AND len(t.pairs) * (2 - {t}) / {t} + 1e-9),
x AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
  max(dice) AS best_dice, arg_min(license, (-dice, license)) AS best_license
  FROM m WHERE dice >= CAST({t} AS DOUBLE) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM d LEFT JOIN x USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": OP1_SQL,
        "op7_quality_rules": OP7_SQL,
        "op9_secret_scan": _op9_sql(),
        "op10_license_scan": _op10_sql(),
    }
