"""Queries p4 and p8 to p10: seen keys and training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import clean_id, table
from . import leaks, packing, seen, toxicity


def _seen(spark: SparkSession, d: str, r: int) -> seen.SeenBefore:
    records = table(spark, d, "changes").select("delivery_id", clean_id("hash").alias("hash"))
    return seen.SeenBefore(records, table(spark, d, "archive_hashes").select(clean_id("hash").alias("hash")), "delivery_id", "hash", r)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d, seen.REMAINDER_BITS).found()


def p4_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """The filters of p4_found, and others with remainders of 8 bits, where wrong answers are frequent enough to count."""
    return _seen(spark, d, seen.REMAINDER_BITS).errors().unionByName(_seen(spark, d, 8).errors())


def p4_merged_filters(spark: SparkSession, d: str) -> DataFrame:
    old, new = (table(spark, d, t).select(clean_id("hash").alias("hash")) for t in ("archive_hashes", "changes"))
    g = seen.Geometry.for_keys(old.count() + new.count())
    return seen.filter_stats(seen.merge_filters(seen.build_filters(old, "hash", g), seen.build_filters(new, "hash", g)))


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    sizes = packing.count_tokens(documents, "doc_id", "text").withColumnRenamed("id", "doc_id")
    return packing.pack(sizes, "doc_id", "n_tokens", n_items=documents.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    bins = p8_assignments(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return bins.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        F.ceil(F.sum("used") / packing.CAPACITY).alias("least_containers"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("unused_share"),
        F.max("used").alias("fullest"),
    )


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "eval_items")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(*_pair(spark, d))


def p9_locations(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(*_pair(spark, d))


def p9_longest_matches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.longest_matches(*_pair(spark, d))


def p9_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(*_pair(spark, d)).select("doc_id", "n_chars")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, d, "doc_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("toxic").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.source_rates(toxicity.score(documents, toxicity.train(documents, table(spark, d, "doc_labels")), "source"))


QUERIES = {
    f.__name__: f
    for f in (
        p4_found, p4_error_rate, p4_merged_filters, p8_assignments, p8_fill, p9_found, p9_locations, p9_longest_matches, p9_clean_documents,
        p10_found, p10_scores, p10_rates,
    )
}
#: Pairs of document and item that share eight words in a row.
_LEAKS = r"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, src_text FROM eval_items UNION ALL SELECT 'i', item_id, ref_text FROM eval_items),
w AS (SELECT kind, id, regexp_extract_all(replace(lower(strip_accents(regexp_replace(text, '[\p{Cf}\p{M}]+', '', 'g'))), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM t WHERE text IS NOT NULL),
s AS (SELECT DISTINCT kind, id, array_to_string(w[k:k + 7], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 6)) AS k FROM w WHERE len(w) >= 8)),
l AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM s AS d JOIN s AS i ON i.s = d.s WHERE d.kind = 'd' AND i.kind = 'i')"""
_CLEAN = r"nullif(lower(trim(hash, E' \t\r\n' || chr(160))), '')"
ORACLES: dict[str, str] = {
    "p4_found": f"""WITH ch AS (SELECT delivery_id, {_CLEAN} AS hash FROM changes), a AS (SELECT DISTINCT {_CLEAN} AS hash FROM archive_hashes),
m AS (SELECT hash, min(delivery_id) AS first_id FROM ch GROUP BY 1)
SELECT delivery_id FROM ch JOIN m USING (hash) WHERE hash IN (SELECT hash FROM a WHERE hash IS NOT NULL) OR delivery_id > first_id""",
    "p9_found": f"{_LEAKS} SELECT doc_id, item_id FROM l",
    "p9_clean_documents": f"{_LEAKS} SELECT doc_id, n_chars FROM documents WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = documents.doc_id)",
}
