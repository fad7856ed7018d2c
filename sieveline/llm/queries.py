"""One registered query an operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, licenses, ngram_join, packing, quality, sharding, sstable, topk
from .textvec import WORD_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates and its number of links."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, each looked up in the shards by its identifier."""
    docs = table(spark, sf_dir, "documents")
    return sstable.write(docs).lookup(docs)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).filter("keep").drop("keep")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which arrive in ARRIVALS parts, read back from the compacted dataset."""
    dataset = sharding.create(spark)
    for part in sharding.arrivals(table(spark, sf_dir, "documents"), "doc_id", ARRIVALS):
        dataset.append(part)
    dataset.compact(keep=1)
    return dataset.read()


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors, over all, of every vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % ASKED == 0)


#: Parts in which op6's documents arrive, together all of them.
ARRIVALS = 4
#: The queries of op10 are the rows whose id it divides.
ASKED = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_sstable": op2_token_sstable,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sharding": op6_sharding,
    "op7_html_extraction": op7_html_extraction,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_exact_topk": op10_exact_topk,
}

#: The n-grams of all texts, as their words joined by a blank.
GRAMS_SQL = f"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM documents WHERE doc_id IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {ngram_join.N} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gram
  FROM words WHERE len(ws) > 0)"""

PAIRS_SQL = f"""{GRAMS_SQL},
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
meets AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (
  SELECT x AS doc_a, y AS doc_b, k / (p.n + q.n - k)::DOUBLE AS jaccard
  FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE k >= {ngram_join.THRESHOLD} * (p.n + q.n - k) - 1e-9)"""

NEAREST_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {ASKED} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id)::INTEGER AS rank FROM pairs)
SELECT vec_id, rank, neighbor_id, round(d, 6) AS distance FROM ranked WHERE rank <= {topk.K}"""

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE {PAIRS_SQL.lstrip()},
links AS (SELECT doc_a AS x, doc_b AS y FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
counted AS (SELECT x, count(*) AS links FROM links GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(l.y, doc_id)) AS class_id, coalesce(c.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN least l ON l.x = doc_id LEFT JOIN counted c ON c.x = doc_id""",
    "op6_sharding": "SELECT * FROM documents",
    "op9_license_scan": licenses.sql(),
    "op10_exact_topk": NEAREST_SQL,
}
