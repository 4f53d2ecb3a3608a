"""The operators as queries over the test tables, and as SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.clusters import CLUSTERS, DIMENSIONS, ROUNDS, cluster_vectors
from tallywright.llm.exact_copies import exact_copies
from tallywright.llm.html_text import extract_text
from tallywright.llm.infill import fill_in_middle, restored
from tallywright.llm.jaccard import similar_groups
from tallywright.llm.licenses import scan_licenses
from tallywright.llm.mixing import mix
from tallywright.llm.packing import pack
from tallywright.llm.rules import quality_rules
from tallywright.llm.secret_scan import find_secrets
from tallywright.llm.toxicity import toxicity
from tallywright.llm.vectors import near_vectors
from tallywright.llm.weak_labels import classify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_domains(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled rows; the domain is the language they are marked with."""
    return documents.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").selectExpr(
        "doc_id", "lang as domain"
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labelled = labelled_domains(documents, table(spark, sf_dir, "labels"))
    return mix(documents, labelled).select("doc_id", "tokens", "posterior", "rate")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.zip_with(
        F.arrays_zip("starts", "ends"),
        "kinds",
        lambda span, kind: F.concat_ws(":", kind, span["starts"].cast("string"), span["ends"].cast("string")),
    )
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base"), 256).alias("base_sha256"),
        F.array_join(spans, ",").alias("spans"),
    )


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).select(
        "doc_id", "weak_quality", "quality_score", "stays"
    )


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    function.__name__: function
    for function in (
        op1_ngram_jaccard_join,
        op2_source_mixing,
        op3_license_scan,
        op4_secret_scan,
        op5_retrieval_packing,
        op6_weak_label_quality,
        op7_html_main_text,
        op8_toxicity,
        op9_quality_rules,
        op10_near_vectors,
        op11_centroid_clusters,
        op12_exact_copies,
        op13_fill_in_middle,
    )
}

SQL: dict[str, str] = {}

SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
    END AS g
    FROM words
), sizes AS (
    SELECT doc_id, len(g)::BIGINT AS n_shingles FROM grams
), classes AS (
    SELECT min(doc_id) AS rep, list_sort(g) AS g FROM grams WHERE len(g) > 0 GROUP BY list_sort(g)
), members AS (
    SELECT doc_id, rep FROM grams JOIN classes ON list_sort(grams.g) = classes.g
), posted AS (
    SELECT rep, unnest(g) AS gram, len(g) AS n FROM classes
), common AS (
    SELECT a.rep AS a, b.rep AS b, a.n AS an, b.n AS bn, count(*) AS k
    FROM posted a JOIN posted b ON a.gram = b.gram AND a.rep < b.rep
    GROUP BY ALL
), links AS (
    SELECT a, b FROM common WHERE 100 * k >= 75 * (an + bn - k)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT rep AS node, rep AS found FROM classes
    UNION
    SELECT b, found FROM reach JOIN both_ways ON reach.node = both_ways.a
), lowest AS (
    SELECT node, min(found) AS component_id FROM reach GROUP BY node
)
SELECT sizes.doc_id, n_shingles, coalesce(component_id, sizes.doc_id) AS component_id
FROM sizes LEFT JOIN members ON members.doc_id = sizes.doc_id LEFT JOIN lowest ON lowest.node = members.rep
"""


def _clustering_sql() -> str:
    """Rounds of k-means one after another, in long form: a row per vector and component."""
    size = DIMENSIONS
    parts = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS place,
           list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {size}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT place AS cluster, v AS c FROM kept WHERE place < {CLUSTERS}
)"""
    ]
    for step in range(ROUNDS + 1):
        parts.append(
            f"""a{step} AS MATERIALIZED (
    SELECT place, arg_min(struct_pack(cluster, d), d * {CLUSTERS} + cluster) AS best
    FROM (
        SELECT place, cluster,
               list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM kept, c{step}
    )
    GROUP BY place
)"""
        )
        if step < ROUNDS:
            parts.append(
                f"""s{step} AS MATERIALIZED (
    SELECT cluster, list(m ORDER BY i) AS c
    FROM (
        SELECT best.cluster AS cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n,
               CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END::BIGINT AS m
        FROM a{step} JOIN kept USING (place), range(1, {size + 1}) AS r(i)
        GROUP BY best.cluster, i
    )
    GROUP BY cluster
), c{step + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(s{step}.c, c{step}.c) AS c FROM c{step} LEFT JOIN s{step} USING (cluster)
)"""
            )
    return (
        "WITH "
        + ", ".join(parts)
        + f"""
SELECT vec_id, best.cluster::INTEGER AS cluster, best.d AS distance,
       (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (place) JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best.cluster
"""
    )


SQL["op11_centroid_clusters"] = _clustering_sql()

SQL["op12_exact_copies"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

SQL["op13_fill_in_middle"] = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || doc_id) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text, u, len(u)::BIGINT AS n,
           list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r
    FROM units
), cut AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR r[3] % 100 >= 90 THEN 'plain'
                WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
           least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
           array_to_string(u[:a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(coalesce(p, '')) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(coalesce(m, '')) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
                        ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
