"""One registered query per corpus operator, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import (
    alignment, bpe, clustering, graph_search, jaccard, licenses, packing, pseudonyms, quality, quotations, repair,
    voronoi, wrappers,
)
from vacantia.llm.oracles import clustering_sql, licenses_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The pseudonym key of the registered queries. In use, pass a secret of your own.
PSEUDONYM_KEY = "registered-query-key"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, quality.grades(table(spark, sf_dir, "labels")))
    scored = quality.score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", "expected_grade", "p_clean", "p_good", (F.col("p_good") >= 0.5).alias("accepted")
    )


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(
        documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    ))


@query("op3_pseudonyms")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(documents, PSEUDONYM_KEY)


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_voronoi_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_products(table(spark, sf_dir, "embeddings"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query("op7_graph_search")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"))


@query("op8_jaccard_join", """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), link AS (
  SELECT x, y, c * 1.0 / (m.size + k.size - c) AS sim FROM both_ JOIN n m ON m.doc_id = x JOIN n k ON k.doc_id = y
  WHERE c >= 0.8 * (m.size + k.size - c) - 1e-9
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
), classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x
), copies AS (SELECT x, min(y) AS y FROM link WHERE sim = 1 GROUP BY x
), counts AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(c.y, d.doc_id)) AS copy_id, k.class_id,
       coalesce(t.n_links, 0) AS n_links
FROM documents d JOIN classes k ON k.x = d.doc_id
LEFT JOIN copies c ON c.x = d.doc_id LEFT JOIN counts t ON t.x = d.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query("op9_wrapper_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


@query("op10_quotation_linking")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotations.conversations(table(spark, sf_dir, "conversations"))
    return found.select(
        "conv_id", "turn", "role", "position", "parent_turn", "thread_turn", "quoted_levels", "own_text", "formatted"
    )


@query("op11_license_scan", licenses_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


@query("op12_centroid_clustering", clustering_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(clustering.cluster(table(spark, sf_dir, "embeddings")))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(conversations), conversations)
