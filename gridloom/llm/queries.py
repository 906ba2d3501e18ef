"""The operators as queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, language_id, line_quality, packing, piece_sampling, quality_rules, substring_dedup, token_counts, url_filter

URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = line_quality.fit_from(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"), "crc32(cast(doc_id as string)) % 3 <> 1")
    return line_quality.score(docs, model).select(
        "doc_id", F.expr("crc32(cast(doc_id as string)) % 3 = 1").alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit_from(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "crc32(cast(doc_id as string)) % 4 <> 2")
    return language_id.identify(_table(spark, sf_dir, "documents", "doc_id", "text"), model).select(
        "doc_id", F.expr("crc32(cast(doc_id as string)) % 4 = 2").alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.find_contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = piece_sampling.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path, check=True)
    return got.select("doc_id", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "lossless")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
}

SQL: dict[str, str] = {
    "op4_decontamination": r"""
        WITH lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
        d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents, lower),
        i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark, lower),
        iw AS (SELECT DISTINCT item_id, n, ws[p : p + n - 1] AS g FROM (SELECT *, least(len(ws), 10) AS n FROM i WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) AS t(p)),
        n AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT rid, n, p, ws[p : p + n - 1] AS g FROM d, n, unnest(range(1, len(ws) - n + 2)) AS t(p)),
        h AS (SELECT rid, n, p, item_id FROM dw JOIN iw USING (n, g)),
        c AS (SELECT rid, count(DISTINCT p + k) AS n_hit FROM h, unnest(range(0, n)) AS t(k) GROUP BY rid),
        m AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)""",
    "op2_substring_dedup": r"""
        WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        g AS (SELECT rid, p, array_to_string(ws[p : p + 34], ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) AS t(p)),
        r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
        c AS (SELECT DISTINCT rid, p + i AS pos FROM g SEMI JOIN r USING (g), unnest(range(0, 35)) AS t(i)),
        x AS (SELECT rid, list(pos) AS gone FROM c GROUP BY rid),
        k AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
                     array_to_string(list_filter(list_transform(ws, lambda v, i: CASE WHEN gone IS NULL OR NOT list_contains(gone, i) THEN v END), lambda v: v IS NOT NULL), ' ') AS kept
              FROM w LEFT JOIN x USING (rid))
        SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k""",
    "op6_url_filters": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
        r AS (SELECT * FROM (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'),
                                    ('block','net','/es/'), ('block','net','/fr/')) AS t(v, h, p)),
        m AS (SELECT page_id, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(v, length(h) * 1000 + length(p)) AS v
              FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT s.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)""",
    "op9_quality_rules": r"""
        WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                          coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        g AS (SELECT rid, p, [ws[p], ws[p + 1], ws[p + 2]] AS g FROM w, unnest(range(1, len(ws) - 1)) AS t(p)),
        r AS (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1),
        c AS (SELECT rid, count(DISTINCT p + i) AS n FROM g SEMI JOIN r USING (rid, g), unnest(range(0, 3)) AS t(i) GROUP BY rid),
        l AS (SELECT rid, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines, sum((substr(ltrim(line, ' '), 1, 1) IN ('-', '*', '•'))::INT) AS n_bullets,
                     sum((ends_with(rtrim(line, ' '), '...') OR ends_with(rtrim(line, ' '), '…'))::INT) AS n_cut FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
        b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
                     length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits, len(list_filter(ws, lambda x: length(x) > 1000)) AS n_long,
                     coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_bullets, 0) AS n_bullets, coalesce(l.n_cut, 0) AS n_cut
              FROM w LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                                        OR 5 * n_dup_lines > n_words OR 2 * n_digits > word_chars OR n_long > 0
                                        OR (n_lines >= 5 AND 10 * n_bullets > 9 * n_lines) OR (n_lines >= 5 AND 10 * n_cut > 3 * n_lines)) AS kept FROM f""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        s AS (SELECT DISTINCT rid, array_to_string(ws[p : p + n - 1], ' ') AS g FROM (SELECT *, least(len(ws), 5) AS n FROM w WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) AS t(p)),
        k AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
        o AS (SELECT a.rid AS x, b.rid AS y, count(*) AS m FROM s AS a JOIN s AS b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN k AS a ON a.rid = x JOIN k AS b ON b.rid = y WHERE 5 * m >= 4 * (a.n + b.n - m)),
        c(rid, root) AS (SELECT rid, rid FROM w UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.rid),
        r AS (SELECT rid, min(root) AS root FROM c GROUP BY rid),
        n AS (SELECT x AS rid, count(*) AS n FROM l GROUP BY x)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, coalesce(n, 0)::BIGINT AS n_links FROM w JOIN r USING (rid) LEFT JOIN n USING (rid)""",
}
