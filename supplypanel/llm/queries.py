"""The registered queries of the operators, over whole tables, and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplypanel.llm import (
    chat, exact_dedup, html_extraction, importance_sampling, ngram_join, packing, quality_rules, secret_scan,
    segment_sampling, sharding, source_divergence, token_counts, token_output,
)
from supplypanel.llm.common import new_folder, read


def op1_segment_sampling(spark: SparkSession, folder: str) -> DataFrame:
    sampled = segment_sampling.segmentations(read(spark, folder, "documents"), ids=False)
    return sampled.select(
        "doc_id", "sample", "n_pieces", *[F.round(c, 6).alias(c) for c in ("log_prob", "perturbed", "log_inclusion")],
        "ids_crc32", "decodes",
    )


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.main_texts(read(spark, folder, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_lengths(read(spark, folder, "documents"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = secret_scan.secret_spans(read(spark, folder, "documents"))
    spans = F.col("secret_spans")
    of = lambda kind: F.filter(spans, lambda x: x.kind == kind)
    base = F.filter(spans, lambda x: x.kind != "random")
    return scanned.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"),
        F.size(of("random")).cast("long").alias("n_random"),
    )


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens before and after its personal data are replaced."""
    trees = token_counts.token_trees(read(spark, folder, "documents").select("doc_id", "text"))
    planned = trees.withColumn("edits", token_counts.redactions(F.col("text"))).withColumns(
        {"n_before": F.col("n_tokens"), "n_edits": F.size("edits").cast("long")})
    return token_counts.apply_edits(planned).select(
        "doc_id", "n_before", "n_edits", "n_encoded", F.col("n_tokens").alias("n_after"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rendered(read(spark, folder, "conversations"))


def op7_token_output(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "tokens")
    token_output.write_tokens(read(spark, folder, "documents"), files)
    return token_output.digests(spark, files)


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    checked = quality_rules.quality_rules(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return checked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score",
    )


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, folder, "documents")).select(
        "doc_id", "class_id", "n_links", "n_copies")


def op11_importance_sampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance_sampling.resampled(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergence(read(spark, folder, "documents"))


#: Shards of the query, all of one weight.
SHARDS = [1.0] * 40


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_plan(read(spark, folder, "documents"), SHARDS).withColumn("law", F.lit("key"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_segment_sampling, op2_html_extraction, op3_packing, op4_secret_scan, op5_token_counts,
        op6_chat_formatting, op7_token_output, op8_exact_dedup, op9_quality_rules, op10_ngram_join,
        op11_importance_sampling, op12_source_divergence, op13_sharding,
    )
}

OP8_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), groups AS (
    SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(texts.body) AS text_sha256
FROM texts JOIN groups ON texts.body = groups.body
"""

OP6_SQL = r"""
WITH placed AS (
    SELECT conv_id, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
        role, text
    FROM conversations
), marked AS (
    SELECT *, coalesce('r' || hex(role), '-') || ' ' || coalesce('t' || hex(text), '-') AS mark FROM placed
), prefixes AS (
    SELECT conv_id, place, string_agg(mark, ',') OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
        count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM marked
), best AS (
    SELECT min(conv_id) AS conv_id, count(*) AS n_snapshots, n_turns FROM prefixes
    WHERE place = n_turns
        AND prefix NOT IN (SELECT prefix FROM prefixes WHERE place < n_turns)
    GROUP BY prefix, n_turns
)
SELECT placed.conv_id, (place - 1) // 64 AS part, n_turns, n_snapshots,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10),
        '' ORDER BY place) AS text
FROM placed JOIN best USING (conv_id) GROUP BY ALL
"""

#: CRC-32 by a table of 256 remainders: ``body`` is what it is taken of.
CRC_TABLE = """
remainders AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS shifted
)
"""


def _crc_sql(body: str) -> str:
    """The unsigned CRC-32 of a text, with the column ``shifted`` at hand."""
    numbers = f"list_transform(regexp_extract_all(hex({body}), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (f"xor(4294967295, list_reduce({numbers}, "
            "lambda c, b: xor(c >> 8, shifted[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))")


SMALL_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH {CRC_TABLE},
words AS (
    SELECT 'd' AS side, doc_id,
        unnest(regexp_extract_all({SMALL_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM documents
    UNION ALL
    SELECT 'b', NULL, unnest(regexp_extract_all({SMALL_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
    FROM benchmark
), buckets AS (
    SELECT word, {_crc_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), remainders
), counts AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
    FROM words JOIN buckets USING (word) GROUP BY bucket
), sums AS (
    SELECT sum(s)::DOUBLE + 10000 AS all_s, sum(t)::DOUBLE + 10000 AS all_t FROM counts
), gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * all_s) / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain
    FROM counts, sums
), weights AS (
    SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
    FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

OP12_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        {SMALL_SQL.format("coalesce(text, '')")} AS body
    FROM documents
), terms AS (
    SELECT row, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n_lang FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL
), filled AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, n_lang
    FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n,
        1 + 1000000000 * (n + 1) // (sum(n) OVER own + count(*) OVER own) AS p,
        1 + 1000000000 * (n_lang + 1) // (sum(n_lang) OVER own + count(*) OVER own) AS q
    FROM filled WINDOW own AS (PARTITION BY lang, source)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY ALL
), found AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
    (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

OP13_SQL = f"""
WITH {CRC_TABLE},
drawn AS (
    SELECT doc_id, coalesce(text, '') AS body, [-1.0 / ln(
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || (s // 4)), (8 * (s % 4) + 1)::INTEGER, 8))::BIGINT + 0.5)
            / 4294967296.0::DOUBLE)
        FOR s IN range(41)] AS draws
    FROM documents
), placed AS (
    SELECT doc_id, (strlen(body) + 16)::BIGINT AS size, {_crc_sql("body")} AS text_crc32,
        list_position(draws[:40], list_max(draws[:40])) - 1 AS shard, list_position(draws, list_max(draws)) - 1 AS grown_shard
    FROM drawn, remainders
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot,
    grown_shard::INTEGER AS grown_shard
FROM placed
"""

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op11_importance_sampling": OP11_SQL,
    "op12_source_divergence": OP12_SQL, "op13_sharding": OP13_SQL,
}
