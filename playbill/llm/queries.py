"""The operators over the whole tables: one query each, with the digest columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chunks, decontam, exact, langid, line_spread, packing, pii, quality, retention, simhash, toxicity

#: The public tokenizer file that packing counts with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null id is in no bucket."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def is_bucket(of: int, place: int) -> Column:
    return F.coalesce(bucket(of) == place, F.lit(False))


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = is_bucket(3, 1)
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.drop_boilerplate(_table(spark, sf_dir, "documents"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    many = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[many("found", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text("found").alias("spans"),
        *[many(base, k).alias(f"base_n_{k}") for k in pii.KINDS],
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "n_tiles")


def op6_chunk_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(_table(spark, sf_dir, "documents"))


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_exact_mph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = is_bucket(5, 0)
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held)
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return toxicity.score(docs, chain).select("doc_id", held.alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"), offsets.alias("spans"))


def op10_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = is_bucket(4, 2)
    model = langid.train(docs, ~held)
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = retention.crc(F.col("click_id"))
    late = F.when(F.pmod(h, F.lit(3)) == 0, F.pmod(h, F.lit(100)))
    return retention.retention(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "clients"), late=late)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_pu,
        op2_line_spread,
        op3_pii_spans,
        op4_best_fit_packing,
        op5_decontaminate,
        op6_chunk_repeats,
        op7_simhash_trie,
        op8_exact_mph,
        op9_toxicity_crf,
        op10_language_ecoc,
        op11_cohort_retention,
        op12_byte_bpe,
        op13_filter_audit,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_line_spread": f"""
        WITH parts AS (
            SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents WHERE text IS NOT NULL),
        spread AS (
            SELECT trim(line, ' ') AS k FROM parts WHERE trim(line, ' ') <> ''
            GROUP BY 1 HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}),
        marked AS (SELECT p.*, s.k IS NOT NULL AS gone FROM parts p LEFT JOIN spread s ON trim(p.line, ' ') = s.k),
        cleaned AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.text
        FROM documents d LEFT JOIN cleaned c USING (doc_id)
    """,
    "op8_exact_mph": """
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM n
    """,
    "op11_cohort_retention": """
        WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
        texts AS (SELECT DISTINCT click_id AS k FROM clicks UNION SELECT DISTINCT client_id FROM clicks),
        crc AS (
            SELECT k, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
            FROM texts, bits WHERE k IS NOT NULL),
        seen AS (SELECT DISTINCT * FROM (SELECT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks) WHERE ts IS NOT NULL AND client_id IS NOT NULL),
        known AS (
            SELECT s.*, arrived_at + to_days(CASE WHEN h % 3 = 0 THEN (h % 100)::INT ELSE 0 END) < TIMESTAMP '2024-02-15 00:00:00' AS early
            FROM seen s LEFT JOIN crc ON click_id = k),
        told AS (SELECT 0 AS state, * FROM known WHERE early UNION ALL SELECT 1, * FROM known),
        begun AS (SELECT state, client_id, min(ts) AS start FROM told WHERE kind = 'signup' GROUP BY ALL),
        cohorts AS (
            SELECT b.*, date_diff('day', DATE '1970-01-01', start::DATE) AS cohort,
                   count(*) OVER w = 2 AND min(start::DATE) OVER w <> max(start::DATE) OVER w AS moved
            FROM begun b WINDOW w AS (PARTITION BY client_id)),
        used AS (
            SELECT state, client_id, cohort, moved, (epoch_us(ts) - epoch_us(start)) // 86400000000 AS period, sum(coalesce(floor(100 * value + 0.5), 0)::BIGINT) AS cents
            FROM told JOIN cohorts USING (state, client_id) WHERE ts >= start GROUP BY ALL)
        SELECT state::INT AS state, coalesce(segment, '') AS segment, cohort::BIGINT AS cohort, period::BIGINT AS period, count(*)::BIGINT AS users, sum(h)::BIGINT AS users_crc32,
               sum(moved::INT)::BIGINT AS moved, sum(cents)::BIGINT AS cents
        FROM used JOIN crc ON client_id = k LEFT JOIN (SELECT client_id, min(segment) AS segment FROM clients GROUP BY 1) USING (client_id)
        GROUP BY 1, 2, 3, 4
    """,
    "op13_filter_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words FROM documents),
        first AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY 1),
        marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
        failed AS (
            SELECT part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                          'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
                          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM texts JOIN first USING (text) LEFT JOIN marks USING (doc_id)),
        masks AS (
            SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails,
                   count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
            FROM failed GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
        counted AS (
            SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS x,
                   sum(n) FILTER (WHERE NOT list_has_any(fails, o[1:step])) AS kept,
                   sum(n) FILTER (WHERE list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS removed,
                   sum(n) FILTER (WHERE list_contains(fails, o[step]) AND list_has_any(fails, o[1:step - 1])) AS redundant,
                   sum(n) FILTER (WHERE fails = [o[step]]) AS unique_fails,
                   sum(good) FILTER (WHERE list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS good_lost,
                   sum(toxic) FILTER (WHERE list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS toxic_lost
            FROM masks, steps GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
        FROM counted
    """,
}
