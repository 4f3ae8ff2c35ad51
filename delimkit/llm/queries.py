"""One query per operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, licenses, media, quality, secret_scan, sentencepiece_codec, set_join, token_counts, toxicity
from .common import crc_bucket


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words that op7's proximity matches may lie from a window's rarest one.
SLOP = 12


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return got.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_pieces(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return got.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=SLOP)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = language_id.identify_language(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_audio(media.store_audio(_table(spark, sf_dir, "documents"), pcm=True))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_sentencepiece, op4_toxicity, op5_secrets, op6_licenses, op7_decontamination, op8_language_id, op9_media, op10_jaccard_join)}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LICENSE_ROWS = ", ".join(f"({i}, {_sql_text(name)}, {_sql_text(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))

ORACLE_SQL = {
    "op6_licenses": f"""
        WITH templates(template, license, text) AS (VALUES {_LICENSE_ROWS}),
        tw AS (SELECT template, license, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM templates),
        t AS (SELECT template, license, len(w) AS n, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bg FROM tw),
        rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        cut AS (SELECT r, text, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS lines FROM rows),
        units AS (SELECT r, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS u FROM cut),
        numbered AS (SELECT row_number() OVER () AS unit, r, list_filter(regexp_split_to_array(lower(u), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM units),
        g AS (SELECT unit, r, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bg FROM numbered WHERE len(w) > 1),
        scored AS (SELECT unit, r, license, len(list_intersect(g.bg, t.bg)) AS s, len(g.bg) + len(t.bg) AS n FROM g JOIN t
                   ON len(g.bg) * {200 - licenses.THRESHOLD} >= len(t.bg) * {licenses.THRESHOLD} AND len(g.bg) * {licenses.THRESHOLD} <= len(t.bg) * {200 - licenses.THRESHOLD}),
        hits AS (SELECT r, unit, license, (20000 * s) // n AS d FROM scored WHERE 200 * s >= {licenses.THRESHOLD} * n),
        best AS (SELECT r, count(DISTINCT unit) AS n_matches, max(d) AS best_dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hits GROUP BY r),
        texts AS (SELECT r, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM rows),
        paired AS (SELECT r, w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM texts WHERE len(w) > 1),
        starts AS (SELECT r, template, license, t.n AS n, t.bg AS bg, g, len(w) AS words, unnest(list_distinct(list_append(range(0, greatest(len(w) - t.n, 0) + 1, greatest(t.n // {licenses.STEP}, 1)), greatest(len(w) - t.n, 0)))) AS k
                   FROM paired JOIN t ON len(list_intersect(list_distinct(g), t.bg)) * {200 - licenses.THRESHOLD} >= len(t.bg) * {licenses.THRESHOLD}),
        cuts AS (SELECT r, template, license, n, words, k, bg, list_distinct(g[k + 1:k + n - 1]) AS c FROM starts),
        rated AS (SELECT r, template, license, n, words, k, len(list_intersect(c, bg)) AS s, len(c) + len(bg) AS z FROM cuts
                  WHERE len(c) * {200 - licenses.THRESHOLD} >= len(bg) * {licenses.THRESHOLD} AND len(c) * {licenses.THRESHOLD} <= len(bg) * {200 - licenses.THRESHOLD}),
        top AS (SELECT r, template, license, n, words, k, (20000 * s) // z AS d, row_number() OVER (PARTITION BY r, template ORDER BY (20000 * s) // z DESC, k) AS place FROM rated WHERE 200 * s >= {licenses.THRESHOLD} * z),
        passages AS (SELECT r, count(*) AS n_passages, string_agg(license || ':' || k || ':' || least(k + n, words) || ':' || d, ',' ORDER BY k, least(k + n, words), license, d) AS passages FROM top WHERE place = 1 GROUP BY r)
        SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(best_dice, 0)::INTEGER AS best_dice, coalesce(licenses, '') AS licenses,
               coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(passages, '') AS passages
        FROM rows LEFT JOIN best USING (r) LEFT JOIN passages USING (r)""",
    "op7_decontamination": rf"""
        WITH rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS win, least(len(w), 8) AS n FROM starts),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM rows, lengths WHERE len(w) >= n),
        grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM places),
        found AS (SELECT r, i, grams.n AS n, item_id FROM grams JOIN windows ON grams.win = windows.win AND grams.n = windows.n),
        hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r),
        tokens AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM rows),
        freq AS (SELECT word, count(*) AS f FROM tokens GROUP BY word),
        forms AS (SELECT win, string_split(win, ' ') AS terms FROM (SELECT DISTINCT win FROM windows)),
        ranked AS (SELECT win, terms, word, row_number() OVER (PARTITION BY win ORDER BY coalesce(f, 0), o) AS place
                   FROM (SELECT win, terms, unnest(terms) AS word, unnest(range(1, len(terms) + 1)) AS o FROM forms) LEFT JOIN freq USING (word)),
        anchored AS (SELECT r, p, win, list_distinct(terms) AS kinds FROM ranked JOIN tokens USING (word) WHERE place = 1),
        close AS (SELECT DISTINCT r, win FROM anchored JOIN rows USING (r) WHERE len(list_intersect(list_distinct(w[greatest(p - {SLOP}, 1):p + {SLOP}]), kinds)) = len(kinds)),
        near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM close JOIN windows USING (win) WHERE item_id IS NOT NULL GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM rows LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)""",
}
