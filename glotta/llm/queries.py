"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotta.llm import bpe, decontaminate, divergence, exact, langid, neighbours, ngrams, pii, quality, repeats, resample, simhash, urls
from glotta.llm.common import id_crc, table

RANKS = "byte_bpe_50k.tiktoken"
URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]
#: The session setting with the key of the pseudonyms; without one, an application draws its own.
PII_KEY = "spark.glotta.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The configured key. A drawn one links values within an application and nowhere else."""
    context = spark.sparkContext
    found = spark.conf.get(PII_KEY, None) or context.getConf().get(PII_KEY) or getattr(context, "_glotta_pii_key", None)
    context._glotta_pii_key = found or secrets.token_hex(16)
    return context._glotta_pii_key


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(20).alias("contaminated"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks_path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(docs, ranks_path=ranks_path, pattern=public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key=pii_key(spark)).select("doc_id", "text", "n_values")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_by_document(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES, urls.train()).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, where=id_crc("doc_id", 3) != 1)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (id_crc("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), learn=id_crc("doc_id", 7) != 2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out_of=5)
    return quality.score(docs, model).select(
        "doc_id", (id_crc("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontamination, op2_byte_bpe, op3_pii, op4_simhash, op5_exact_dedup, op6_suffix_array, op7_url_filter, op8_language, op9_language_model, op10_quality, op11_source_divergence, op12_neighbours, op13_resample]
    return {f.__name__: f for f in own}


#: A-Z as a-z and no other letter, in DuckDB.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op13_resample": rf"""
            WITH steps AS (
                SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
                FROM range(256) t(i)
            ), texts AS (
                SELECT true AS target, row_number() OVER () AS k, NULL AS doc_id, {_LOWER} AS t FROM benchmark
                UNION ALL SELECT false, row_number() OVER (), doc_id, {_LOWER} FROM documents
            ), worded AS (
                SELECT target, k, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
            ), found AS (
                SELECT target, k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM worded
            ), hexed AS (
                SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM found)
            ), hashed AS (
                SELECT feature, xor(4294967295, list_reduce(
                    list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda j: ('0x' || substr(h, j, 2))::BIGINT)),
                    lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)]))) % 10000 AS bucket
                FROM hexed, steps
            ), counted AS (
                SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM found JOIN hashed USING (feature) GROUP BY bucket
            ), gained AS (
                SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE)))::BIGINT AS gain
                FROM counted
            ), summed AS (
                SELECT k, count(*) AS n, sum(gain) AS gain FROM found JOIN hashed USING (feature) JOIN gained USING (bucket) WHERE NOT target GROUP BY k
            ), weighed AS (
                SELECT k, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
                       ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
                FROM worded LEFT JOIN summed USING (k) WHERE NOT target
            ), scored AS (
                SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
            ), placed AS (
                SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                       count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS most
                FROM scored
            )
            SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM placed
        """,
        "op11_source_divergence": rf"""
            WITH docs AS (
                SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents
            ), groups AS (
                SELECT DISTINCT lang, source FROM docs
            ), found AS (
                SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
            ), kept AS (
                SELECT lang, term, count(*) OVER (PARTITION BY lang) AS terms
                FROM (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT k) >= 10)
            ), counted AS (
                SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term
            ), every AS (
                SELECT lang, source, term, terms, coalesce(n, 0)::HUGEINT AS n
                FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
            ), shares AS (
                SELECT *, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * terms) AS p FROM every
            ), of_lang AS (
                SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * terms) AS q
                FROM (SELECT lang, term, any_value(terms) AS terms, sum(n) AS n FROM every GROUP BY lang, term)
            ), met AS (
                SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
                GROUP BY a.lang, a.source, b.source
            ), pairs AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
                FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
            ), terms AS (
                SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
                FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
                FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
            )
            SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
        """,
        "op5_exact_dedup": """
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
            FROM (
                SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
                       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
                FROM documents
            )
        """
    }
