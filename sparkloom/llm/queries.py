"""The queries over the operators of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, html_extraction, mixing, near_dedup, piece_lattice, quality_rules, sanitise, substring_dedup, token_counts, toxicity
from sparkloom.llm.common import load, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(load(spark, sf_dir, "documents"), width=3, percent=85)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.sanitise(load(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(sanitise.KINDS[:4])]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(sanitise.joined(F.col("base")), 256).alias("base_sha256"), sanitise.joined(F.col("spans")).alias("spans"), added, F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_pieces", "fitting_pieces")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_lattice.encode(load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(load(spark, sf_dir, "documents"), width=35)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"), keep="largest")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.by_position(mixing.curriculum(load(spark, sf_dir, "documents")))
    taken = (F.col("size") * F.size("positions")).cast("long")
    return mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "first_position", "positions")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_pii": op2_pii,
    "op3_html": op3_html,
    "op4_token_counts": op4_token_counts,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i:i + 34], ' ')) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g WHERE n > 1),
        k AS (SELECT doc_id, count(r.j) AS gone, string_agg(x, ' ' ORDER BY j) FILTER (WHERE r.j IS NULL) AS kept
              FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w) LEFT JOIN r USING (doc_id, j) GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op8_quality_rules": """
        WITH w AS MATERIALIZED (
            SELECT doc_id, source, row_number() OVER () AS row, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        g AS (
            SELECT row, i, count(*) OVER (PARTITION BY row, ws[i:i + 4]) AS n
            FROM (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        r AS (
            SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY row),
        l AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
        m AS (
            SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
            FROM w JOIN l ON w.row = l.row LEFT JOIN r ON w.row = r.row),
        f AS (
            SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > 3 * n_words AS symbols,
                   word_chars < 2 * n_words OR word_chars > 20 * n_words AS odd FROM m),
        h AS (
            SELECT source, count(*) AS n, count(*) FILTER (short) AS k1, count(*) FILTER (repeats) AS k2, count(*) FILTER (symbols) AS k3, count(*) FILTER (odd) AS k4 FROM f GROUP BY source),
        k AS (SELECT source, n, unnest([k1, k2, k3, k4]) AS bad, unnest([1, 2, 3, 4]) AS rule FROM h),
        p AS (SELECT rule, avg(bad / n) AS mean, var_pop(bad / n) AS v FROM k GROUP BY rule),
        b AS (SELECT rule, mean, CASE WHEN v > 0 THEN greatest(1, least(1000, mean * (1 - mean) / v - 1)) ELSE 1000 END AS weight FROM p),
        d AS (SELECT source, max((bad + mean * weight) / (n + weight)) <= 0.6 AS host_kept FROM k JOIN b USING (rule) GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND host_kept AS kept
        FROM f JOIN d ON f.source IS NOT DISTINCT FROM d.source""",
}
