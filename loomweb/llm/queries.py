"""One query for each operator, over its whole table, with the parameters used in production."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import fold, table
from .embed_dedup import vector_components
from .htmltext import extract
from .licenses import scan, scan_sql
from .media import read_back, store
from .mixing import mixed_sizes
from .ngram_join import ngram_components
from .packing import pack
from .quality import score_quality
from .sharding import shard
from .toxicity import score_toxicity

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


@query("op1_toxicity")
def op1(spark, sf_dir):
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.7)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"), "toxic_weight")


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), capacity=2048, per_source=4)


@query("op3_html_extraction")
def op3(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query("op4_ngram_jaccard_join")
def op4(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), k=4, similarity="0.85")


#: All pairs, by a join on the shingles themselves; components by what links reach.
ORACLE["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(g) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(g)"""


@query("op5_media_columns")
def op5(spark, sf_dir):
    return read_back(store(table(spark, sf_dir, "documents")))


@query("op6_source_mixing")
def op6(spark, sf_dir):
    return mixed_sizes(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3.0)


@query("op7_balanced_sharding")
def op7(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"), shards=40)


@query("op8_license_scan")
def op8(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


ORACLE["op8_license_scan"] = scan_sql()


@query("op9_quality_rules")
def op9(spark, sf_dir):
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("good").alias("predicted"))


@query("op10_embedding_near_dedup")
def op10(spark, sf_dir):
    return vector_components(table(spark, sf_dir, "embeddings"), threshold=0.98)


ORACLE["op10_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id"""
