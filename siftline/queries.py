"""The registered queries of the selection engine, each an operator over the given tables, and their SQL.

Samples are documents, vectors are embeddings, cluster labels are the labels of the embeddings, and feedback is the
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import det, text, vec
from .operators import clusters, compress, diversity, embedding, feedback, sampling
from .sources import readers, sinks
from .streaming import feedback as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster, v): embeddings with their labels; labels above 7 play noise."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), clusters.cluster_of("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).withColumn("cluster", F.when(F.col("cluster") > 7, -1).otherwise(F.col("cluster")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, round, seq, error, value): feedback from events, one row per event; seq orders a sample's feedback."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("round"), "event_id", "ts", "value", F.least(F.lit(1.0), F.col("value") / 503).alias("error"))


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# ---- SQL parts ----

S = "SELECT vec_id AS id, coalesce(label, -1)::INT AS cluster, embedding::DOUBLE[] AS v FROM embeddings"
NOISY = "SELECT vec_id AS id, CASE WHEN label > 7 THEN -1 ELSE coalesce(label, -1) END::INT AS cluster, embedding::DOUBLE[] AS v FROM embeddings"
EV = "SELECT user_id AS id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS round, event_id, ts, value, least(1.0::DOUBLE, value / 503) AS error FROM events"


def mean_sql(source: str, key: str = "") -> str:
    """Mean vectors of ``source`` by ``key``."""
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""
    return f"(SELECT {k}list(x ORDER BY pos) AS centroid FROM (SELECT {k}pos, avg(x) AS x FROM (SELECT {k}unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {source}) GROUP BY {k}pos) {g})"


def u_sql(seed: int, purpose: str, round_no: str, *keys: str) -> str:
    parts = "||':'||".join([f"'{seed}:{purpose}'", round_no if not round_no.isdigit() else f"'{round_no}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x'||substr(md5({parts}),1,13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


DOT = "list_dot_product({0}, {1})"
COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"
SQ = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


# ---- sources, text ----

@query("""
SELECT 'd' || doc_id AS id, coalesce(text, '') AS instruction, lang AS input, source AS output FROM documents
WHERE length(coalesce(text, '')) + length(coalesce(lang, '')) + length(coalesce(source, '')) BETWEEN 10 AND 4096
""")
def load_filter_length(spark, sf_dir):  # S4 S14 P3 F1
    d = table(spark, sf_dir, "documents").withColumn("key", F.concat(F.lit("d"), "doc_id"))
    rows = readers.standard(d, {"instruction": "text", "input": "lang", "output": "source"}, "key")
    return readers.within_length(rows)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder for files that a query writes to read them back: the shared one, where the session names it."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="siftline-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):  # S2 S9 K9, with the texts
    path = _scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return readers.read_jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("SELECT count(*) AS n_lines FROM documents")
def jsonl_count(spark, sf_dir):  # S2b
    path = _scratch(spark, "count")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id"), path)
    return spark.range(1).select(F.lit(readers.count_jsonl(spark, path)).cast("long").alias("n_lines"))


@query("SELECT page_id, url, html FROM pages")
def csv_round_trip(spark, sf_dir):  # S5, with the pages; quotes are escaped as the reader expects
    path = _scratch(spark, "csv")
    table(spark, sf_dir, "pages").select("page_id", "url", "html").write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_csv(spark, path, "page_id long, url string, html string")


@query("SELECT item_id, text FROM benchmark")
def json_container(spark, sf_dir):  # S3
    path = _scratch(spark, "json")
    rows = table(spark, sf_dir, "benchmark").groupBy().agg(F.collect_list(F.struct("item_id", "text")).alias("samples"))  # a small table
    rows.coalesce(1).write.json(path)
    return readers.read_json(spark, path).select("item_id", "text")


@query("""
SELECT 'hf://' || source || CASE WHEN lang = 'en' THEN '' ELSE ':' || lang || ':train' END AS path, source AS name,
       CASE WHEN lang <> 'en' THEN lang END AS subset, CASE WHEN lang <> 'en' THEN 'train' END AS split, count(*) AS n
FROM documents GROUP BY source, lang
""")
def hub_paths(spark, sf_dir):  # S7
    path = F.concat(F.lit("hf://"), "source", F.when(F.col("lang") == "en", F.lit("")).otherwise(F.concat(F.lit(":"), "lang", F.lit(":train"))))
    d = table(spark, sf_dir, "documents").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("path", "n", readers.hub_parts(F.col("path")).alias("p")).select("path", "p.*", "n")


@query("""
SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS instruction, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS output
FROM conversations GROUP BY conv_id
""")
def messages_last(spark, sf_dir):  # P4
    return _messages(spark, sf_dir).select("conv_id", readers.last_message(F.col("messages"), "user").alias("instruction"), readers.last_message(F.col("messages"), "assistant").alias("output"))


def _messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns


@query("""
SELECT conv_id, '### Input:' || chr(10) || coalesce(arg_min(text, turn) FILTER (role = 'user'), '') || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt,
       coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS response
FROM conversations GROUP BY conv_id
""")
def messages_first(spark, sf_dir):  # P13
    m = _messages(spark, sf_dir)
    return m.select("conv_id", F.concat(F.lit("### Input:\n"), readers.first_message(F.col("messages"), "user"), F.lit("\n\n### Response:\n")).alias("prompt"), readers.first_message(F.col("messages"), "assistant").alias("response"))


@query("SELECT doc_id, substr(md5(coalesce(text, '') || coalesce(lang, '') || coalesce(source, '')), 1, 12) AS content_id FROM documents")
def content_hash_id(spark, sf_dir):  # P5
    return table(spark, sf_dir, "documents").select("doc_id", text.content_id(F.col("text"), F.col("lang"), F.col("source")).alias("content_id"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('[' || lang || ']' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || source, '\n+', chr(10), 'g'), '^\s+', ''), '\s+$', '') AS content,
       regexp_replace(regexp_replace(coalesce(text, '') || chr(10) || lang || chr(10) || source, '^\s+', ''), '\s+$', '') AS full_text FROM documents
""")
def template_text(spark, sf_dir):  # P6 P7 P8
    fields = {"instruction": F.col("text"), "input": F.col("lang"), "output": F.col("source")}
    return table(spark, sf_dir, "documents").select("doc_id", text.rendered_content("[{input}]\n\n{instruction}\n{output}", fields).alias("content"), text.rendered_text("{instruction}\n{input}\n{output}", fields).alias("full_text"))


@query("SELECT item_id, CASE WHEN length(text) < 200 THEN 'query: ' ELSE 'passage: ' END || text AS text FROM benchmark")
def e5_prefix(spark, sf_dir):  # P9
    return table(spark, sf_dir, "benchmark").select("item_id", text.e5_prefixed(F.col("text"), "intfloat/multilingual-e5-large").alias("text"))


@query(r"""
WITH b AS (SELECT doc_id, text, lang, source FROM documents), c AS (SELECT *, 'A. ' || lang || chr(10) || 'B. ' || source AS lettered FROM b)
SELECT doc_id, 'Question: ' || text || chr(10) || chr(10) || lettered || chr(10) || chr(10) || 'Answer:' AS mmlu,
       'Task: ' || text || chr(10) || chr(10) || 'Let''s think step by step.' || chr(10) || chr(10) || 'Answer:' AS bbh,
       text || chr(10) || chr(10) || 'Answer:' AS plain FROM c
""")
def training_prompts(spark, sf_dir):  # P10 P11
    d = table(spark, sf_dir, "documents").withColumn("choices", F.to_json(F.array("lang", "source")))
    return d.select("doc_id", text.training_prompt("mmlu", F.col("text"), F.col("choices")).alias("mmlu"), text.training_prompt("bbh", F.col("text"), F.lit("")).alias("bbh"), text.training_prompt("", F.col("text"), F.lit("")).alias("plain"))


@query("""
SELECT doc_id, source AS origin, CASE WHEN source = 'src1' THEN coalesce(lang, '') ELSE '' END AS input, chr(65 + (doc_id % 4)::INT) AS answer FROM documents
""")
def source_projection(spark, sf_dir):  # P11 P12
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("origin"), F.when(F.col("source") == "src1", text.blank(F.col("lang"))).otherwise(F.lit("")).alias("input"), F.char((F.col("doc_id") % 4 + 65).cast("int")).alias("answer"))


@query("SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: round(x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6)) AS unit FROM embeddings")
def l2_normalise(spark, sf_dir):  # P15
    return members(spark, sf_dir).select("id", F.transform(vec.unit(F.col("v")), lambda x: vec.rounded(x)).alias("unit"))


@query("""
SELECT * FROM (VALUES ('text-embedding-3-small', 0.02::DOUBLE), ('text-embedding-3-large', 0.13), ('text-embedding-ada-002', 0.10), ('other', 0.02)) m(model, p)
CROSS JOIN (SELECT round(sum(n_chars) / 4000000.0::DOUBLE, 6) AS millions FROM documents)
""".replace("SELECT * FROM", "SELECT model, round(p * millions, 6) AS dollars FROM", 1))
def embedding_cost(spark, sf_dir):  # P16
    total = table(spark, sf_dir, "documents").agg(F.round(F.sum("n_chars") / F.lit(4_000_000.0), 6).alias("millions"))
    models = spark.createDataFrame([("text-embedding-3-small",), ("text-embedding-3-large",), ("text-embedding-ada-002",), ("other",)], "model string")
    return models.crossJoin(F.broadcast(total)).select("model", r6(text.embedding_cost(F.col("model"), F.col("millions") * 1_000_000), "dollars"))  # four rows and one


@query("""
SELECT * FROM (VALUES ('intfloat/multilingual-e5-large', 1024, 512, true, 'sentence-transformers'), ('text-embedding-3-small', 1536, 8191, true, 'openai'), ('own', NULL, 512, false, 'unknown')) t(model, dim, max_length, multilingual, kind)
""")
def model_info(spark, sf_dir):  # P17
    return embedding.model_info(spark.createDataFrame([("intfloat/multilingual-e5-large",), ("text-embedding-3-small",), ("own",)], "model string"))


@query("""
SELECT doc_id AS id, 'documents' AS _config, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, 'pages', NULL, url FROM pages
""")
def union_sources(spark, sf_dir):  # S8 S16 U1
    return readers.union_sources({"documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "pages": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")}).select("id", "_config", "lang", "url")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def dedup_last_wins(spark, sf_dir):  # U8 S19
    return readers.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"""
WITH r AS (SELECT i AS id, {u_sql(42, 'kind', '0', 'i')} AS u FROM range(1000) t(i))
SELECT CASE WHEN u < 0.4 THEN 'math' WHEN u < 0.7 THEN 'code' ELSE 'instruction' END AS category, count(*) AS n FROM r GROUP BY 1
""")
def sample_categories(spark, sf_dir):  # S15 A20
    return readers.sample_data(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---- clusters ----

@query(f"SELECT cluster, size, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM (SELECT cluster, count(*) AS size FROM ({NOISY}) WHERE cluster >= 0 GROUP BY cluster) JOIN {mean_sql(f'({NOISY}) WHERE cluster >= 0', 'cluster')} USING (cluster)")
def centroids(spark, sf_dir):  # A1 A2 F8 U7
    return clusters.centroids(noisy(spark, sf_dir)).select("cluster", "size", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


METRIC_SQL = f"""
WITH m AS ({NOISY}), c AS (SELECT * FROM {mean_sql('m WHERE cluster >= 0', 'cluster')}), a AS (SELECT centroid AS mean FROM {mean_sql('m')}),
k AS (SELECT cluster, count(*) AS size, avg({SQ.format('v', 'centroid')}) AS variance FROM m JOIN c USING (cluster) GROUP BY cluster),
g AS (SELECT cluster, 1 - {COS.format('centroid', 'mean')} AS global_distance FROM c, a),
i AS (SELECT x.cluster, 1 - max({COS.format('x.centroid', 'y.centroid')}) AS isolation FROM c x JOIN c y ON x.cluster <> y.cluster GROUP BY x.cluster),
t AS (SELECT m.cluster, d.lang, count(*)::DOUBLE AS n FROM m JOIN documents d ON d.doc_id = m.id WHERE m.cluster >= 0 GROUP BY ALL),
h AS (SELECT cluster, sum(-(n / s) * ln(n / s)) AS label_entropy FROM (SELECT *, sum(n) OVER (PARTITION BY cluster) AS s FROM t) GROUP BY cluster),
f AS (SELECT * FROM k JOIN g USING (cluster) JOIN i USING (cluster) JOIN h USING (cluster))
"""


def _labelled(spark, sf_dir):
    return noisy(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id", "left")


def _metrics(spark, sf_dir):
    m = noisy(spark, sf_dir)
    base = clusters.cluster_metrics(m).drop("label_entropy")
    lang = m.select("id", "cluster").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").filter("cluster >= 0").groupBy("cluster", "lang").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    entropy = lang.withColumn("p", p).groupBy("cluster").agg(F.sum(-F.col("p") * F.ln("p")).alias("label_entropy"))
    return base.join(entropy, "cluster")


@query(METRIC_SQL + "SELECT cluster, size, round(variance, 6) AS variance, round(global_distance, 6) AS global_distance, round(isolation, 6) AS isolation, round(label_entropy, 6) AS label_entropy FROM f")
def cluster_metrics(spark, sf_dir):  # A3 A4 A5 A25 J13
    return _metrics(spark, sf_dir).select("cluster", "size", *[r6(F.col(c), c) for c in clusters.METRICS])


@query(METRIC_SQL + """, n AS (SELECT cluster, """ + ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-12) AS {c}" for c in clusters.METRICS) + """ FROM f)
SELECT cluster, round(variance, 6) AS variance_norm, round(isolation, 6) AS isolation_norm, round(0.25 * variance + 0.25 * global_distance + 0.25 * isolation + 0.25 * label_entropy, 6) AS prior_score FROM n""")
def prior_scores(spark, sf_dir):  # A6 A7
    return clusters.prior_scores(_metrics(spark, sf_dir)).select("cluster", r6(F.col("variance_norm"), "variance_norm"), r6(F.col("isolation_norm"), "isolation_norm"), r6(F.col("prior_score"), "prior_score"))


def _nearest_sql(cost: str) -> str:
    return f"WITH m AS ({NOISY}), c AS (SELECT * FROM {mean_sql('m WHERE cluster >= 0', 'cluster')}), p AS (SELECT m.id, c.cluster, {cost} AS d FROM m, c WHERE m.cluster < 0) SELECT id, arg_min(cluster, (d, cluster)) AS cluster, round(min(d), 6) AS distance FROM p GROUP BY id"


@query(_nearest_sql(f"sqrt({SQ.format('v', 'centroid')})"))
def assign_nearest_euclid(spark, sf_dir):  # J8 M12 M13
    m = noisy(spark, sf_dir)
    return clusters.nearest(m.filter("cluster < 0").drop("cluster"), clusters.centroids(m)).select("id", "cluster", r6(F.col("distance"), "distance"))


@query(_nearest_sql(f"1 - {COS.format('v', 'centroid')}"))
def assign_nearest_cosine(spark, sf_dir):  # J9
    m = noisy(spark, sf_dir)
    return clusters.nearest(m.filter("cluster < 0").drop("cluster"), clusters.centroids(m), "cosine").select("id", "cluster", r6(F.col("distance"), "distance"))


@query(f"SELECT id, CASE WHEN cluster < 0 THEN (SELECT max(cluster) + 1 FROM ({NOISY})) ELSE cluster END::INT AS cluster, cluster < 0 AS is_noise FROM ({NOISY})")
def noise_separate(spark, sf_dir):  # M12
    return clusters.handle_noise(noisy(spark, sf_dir), "separate").select("id", "cluster", "is_noise")


@query(f"SELECT id, cluster FROM ({NOISY}) WHERE cluster >= 0")
def noise_dropped(spark, sf_dir):  # M12 F8
    return clusters.handle_noise(noisy(spark, sf_dir), "drop").filter("not is_noise").select("id", "cluster")


@query(f"SELECT cluster, count(*) AS size FROM ({S}) GROUP BY cluster HAVING count(*) > 50")
def oversized_clusters(spark, sf_dir):  # F10
    return members(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 50")


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY {u_sql(42, 'pilot', '0', 'vec_id')}, vec_id LIMIT 100")
def pilot_sample(spark, sf_dir):  # M16
    return clusters.pilot(members(spark, sf_dir), 100).select("id")


@query()
def kmeans_clusters(spark, sf_dir):  # M14 M15
    m, _ = clusters.kmeans(members(spark, sf_dir).drop("cluster"), 10, 20)
    return m.select("id", F.col("cluster").cast("int").alias("cluster"))


@query()
def density_clusters(spark, sf_dir):  # M11 M17 M23
    return clusters.large_scale_cluster(members(spark, sf_dir).drop("cluster"), None, 10, 5).select("id", "cluster")


@query()
def subdivided_clusters(spark, sf_dir):  # M18
    return clusters.subdivide(members(spark, sf_dir), 50, 25).select("id", "cluster")


@query()
def pca_reduced(spark, sf_dir):  # M6 A24
    reduced, share = clusters.reduce_dimensions(members(spark, sf_dir), 8)
    return reduced.select("id", F.size("v").alias("dims"), F.transform("v", lambda x: F.round(x, 6)).alias("v"), F.lit(round(sum(share), 4)).alias("explained"))


# ---- compression, neighbours ----

@query(f"""
WITH RECURSIVE m AS (SELECT id, cluster, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM ({S}) WHERE cluster >= 0),
p AS (
  SELECT cluster, 1 AS rank, min(id) AS id, [min(id)] AS chosen FROM m GROUP BY cluster
  UNION ALL
  SELECT p.cluster, p.rank + 1, n.id, list_append(p.chosen, n.id) FROM p, LATERAL (
    SELECT a.id, min(1 - list_dot_product(a.v, b.v)) AS d FROM m a JOIN m b ON a.cluster = p.cluster AND b.cluster = p.cluster AND list_contains(p.chosen, b.id)
    WHERE NOT list_contains(p.chosen, a.id) GROUP BY a.id ORDER BY d DESC, a.id LIMIT 1) n WHERE p.rank < 5)
SELECT cluster, id, rank::INT AS rank FROM p
""")
def fps_cosine(spark, sf_dir):  # M7 W11 L9
    return compress.fps(members(spark, sf_dir), 5)


@query()
def kmeans_representatives(spark, sf_dir):  # M8
    return compress.kmeans_members(members(spark, sf_dir), 5)


REF_SQL = f"(SELECT id, cluster, v, row_number() OVER (PARTITION BY cluster ORDER BY {u_sql(42, 'ref', '0', 'id')}, id)::INT AS rank FROM ({S}) WHERE cluster >= 0 QUALIFY rank <= 20)"


@query(f"SELECT cluster, id, rank FROM {REF_SQL}")
def random_references(spark, sf_dir):  # M9 M10
    return compress.random_members(members(spark, sf_dir), 20, "ref")


@query(f"SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY id)::INT AS rank FROM ({S}) QUALIFY rank <= 30")
def first_references(spark, sf_dir):  # L7
    return compress.first_members(members(spark, sf_dir), 30)


MIX_IN = f"(SELECT id, cluster, (id * 37 % 101) / 100.0::DOUBLE AS priority, (id * 53 % 97) / 96.0::DOUBLE AS rarity, (10 + cluster * 7)::BIGINT AS n FROM ({S}) WHERE id % 13 <> 0)"


@query(f"""
WITH i AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS c, row_number() OVER (PARTITION BY cluster ORDER BY priority DESC, id) AS p FROM {MIX_IN}),
j AS (SELECT *, CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 0 ELSE 1 END AS t FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY cluster, t ORDER BY rarity DESC, id) AS r FROM j),
l AS (SELECT *, CASE WHEN t = 1 AND r <= floor(n * 0.15::DOUBLE) THEN 2 ELSE t END AS s FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY cluster, s ORDER BY {u_sql(42, 'mixed', '1', 'id')}, id) AS u FROM l)
SELECT id, cluster, CASE WHEN c <= n THEN 'all' WHEN s = 0 THEN 'priority' WHEN s = 2 THEN 'rarity' ELSE 'random' END AS picked_by FROM o
WHERE c <= n OR s IN (0, 2) OR u <= n - floor(n * 0.8::DOUBLE) - floor(n * 0.15::DOUBLE)
""")
def mixed_selection(spark, sf_dir):  # W2 B12 L3 J4 F6
    m = members(spark, sf_dir).drop("v")
    retired = m.filter("id % 13 = 0").select("id")
    c = m.join(retired, "id", "left_anti").withColumns({"priority": (F.col("id") * 37 % 101) / 100.0, "rarity": (F.col("id") * 53 % 97) / 96.0})
    budgets = m.select("cluster").distinct().withColumn("n", (10 + F.col("cluster") * 7).cast("bigint"))
    return sampling.mixed_selection(c, budgets).select("id", "cluster", "picked_by")


PICKED = f"(SELECT id, cluster FROM ({ORACLE_SQL['mixed_selection']}))"


KNN_SQL = f"""
WITH m AS ({S}), r AS (SELECT * FROM {REF_SQL}), d AS (SELECT m.id, m.cluster, 1 - {COS.format('m.v', 'r.v')} AS d, row_number() OVER (PARTITION BY m.id ORDER BY 1 - {COS.format('m.v', 'r.v')}) AS k FROM m JOIN r USING (cluster)),
k AS (SELECT id, cluster, avg(d) AS knn FROM d WHERE k <= 10 GROUP BY ALL)
"""


def _references(spark, sf_dir):
    m = members(spark, sf_dir)
    return m, compress.random_members(m, 20, "ref").select("id").join(m, "id")


@query(KNN_SQL + "SELECT id, cluster, round(knn, 6) AS knn FROM k")
def knn_density(spark, sf_dir):  # J10 W8
    m, refs = _references(spark, sf_dir)
    return sampling.knn_distance(m, refs).select("id", "cluster", r6(F.col("knn"), "knn"))


RARITY_SQL = ", y AS (SELECT id, cluster, CASE WHEN max(knn) OVER w = min(knn) OVER w THEN 0 ELSE (knn - min(knn) OVER w) / (max(knn) OVER w - min(knn) OVER w + 1e-12) END AS rarity FROM k WINDOW w AS (PARTITION BY cluster))"


@query(KNN_SQL + RARITY_SQL + " SELECT id, cluster, round(rarity, 6) AS rarity FROM y")
def rarity(spark, sf_dir):  # B9
    m, refs = _references(spark, sf_dir)
    return sampling.rarity(m, refs).select("id", "cluster", r6(F.col("rarity"), "rarity"))


HIST = f"(SELECT v FROM ({S}) WHERE id IN (SELECT id FROM {PICKED}))"
NOVELTY_SQL = f", q AS (SELECT m.id, m.cluster, min(1 - {COS.format('m.v', 'h.v')}) AS d FROM m, {HIST} h GROUP BY ALL), z AS (SELECT id, cluster, CASE WHEN max(d) OVER w = min(d) OVER w THEN 1 ELSE (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-12) END AS novelty FROM q WINDOW w AS (PARTITION BY cluster))"


@query(f"WITH m AS ({S})" + NOVELTY_SQL + " SELECT id, cluster, round(novelty, 5) AS novelty FROM z")
def novelty(spark, sf_dir):  # B10 J11 J17
    return sampling.novelty(members(spark, sf_dir), _history(spark, sf_dir)).select("id", "cluster", F.round("novelty", 5).alias("novelty"))


def _history(spark, sf_dir):
    """Vectors of the samples that ``mixed_selection`` picked."""
    return members(spark, sf_dir).join(mixed_selection(spark, sf_dir).select("id"), "id", "left_semi").select("v")


@query(f"WITH m AS ({S}) SELECT a.cluster, count(DISTINCT a.id) AS n, round(avg(1 - {COS.format('a.v', 'b.v')}), 6) AS diversity FROM m a JOIN m b ON a.cluster = b.cluster AND a.id < b.id GROUP BY a.cluster".replace("count(DISTINCT a.id) AS n", "(SELECT count(*) FROM m z WHERE z.cluster = a.cluster) AS n"))
def diversity_pairwise(spark, sf_dir):  # A14 J12
    return diversity.average_pairwise(members(spark, sf_dir), "cluster").select("cluster", "n", r6(F.col("diversity"), "diversity"))


@query("""
WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM p)
SELECT (count(DISTINCT least(9, floor((x - lx) / ((hx - lx) / 10)))) + count(DISTINCT least(9, floor((y - ly) / ((hy - ly) / 10))))) / 20.0::DOUBLE AS coverage FROM p, s
""")
def diversity_coverage(spark, sf_dir):  # A15
    return diversity.bin_coverage(members(spark, sf_dir).select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


@query()
def diversity_logdet(spark, sf_dir):  # A16
    return spark.range(1).select(F.round(F.lit(diversity.log_determinant(members(spark, sf_dir))), 6).alias("logdet"))


@query(f"SELECT count(DISTINCT cluster)::DOUBLE / 10.0::DOUBLE AS coverage FROM {PICKED}")
def cluster_coverage(spark, sf_dir):  # A17, of the selection
    return diversity.cluster_coverage(mixed_selection(spark, sf_dir), 10)


@query(f"WITH c AS (SELECT count(*)::DOUBLE AS n FROM {PICKED} GROUP BY cluster), t AS (SELECT sum(n) t, count(*) k FROM c) SELECT round(sum(-(n / t) * ln(n / t + 1e-12)) / ln(any_value(k)), 6) AS balance FROM c, t")
def selection_balance(spark, sf_dir):  # A18
    counts = mixed_selection(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return diversity.balance(counts).select(r6(F.col("balance"), "balance"))


# ---- sampling ----

POST_SQL = f"(SELECT cluster, 1.0::DOUBLE + sum(error) AS alpha, 1.0::DOUBLE + sum(1 - error) AS beta, (cluster % 3)::BIGINT AS visits FROM (SELECT (id % 10)::INT AS cluster, error FROM ({EV})) GROUP BY cluster)"


def _posteriors(spark, sf_dir):
    """Posteriors from all events."""
    e = events(spark, sf_dir).withColumn("cluster", (F.col("id") % 10).cast("int"))
    return e.groupBy("cluster").agg((1.0 + F.sum("error")).alias("alpha"), (1.0 + F.sum(1 - F.col("error"))).alias("beta")).withColumn("visits", (F.col("cluster") % 3).cast("bigint"))


@query(f"SELECT cluster, round(1 + 2 * s, 6) AS alpha, round(1 + 2 * (1 - s), 6) AS beta, 0::BIGINT AS visits FROM (SELECT cluster, count(*)::DOUBLE / 100 AS s FROM ({S}) GROUP BY cluster)")
def posterior_init(spark, sf_dir):  # B1
    c = members(spark, sf_dir).groupBy("cluster").agg((F.count(F.lit(1)) / 100.0).alias("prior_score"))
    return sampling.initial_posteriors(c).select("cluster", r6(F.col("alpha"), "alpha"), r6(F.col("beta"), "beta"), "visits")


@query(f"SELECT cluster, round(alpha / (alpha + beta), 6) AS mean, round(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)), 6) AS variance, visits FROM {POST_SQL}")
def posterior_stats(spark, sf_dir):  # A11
    return _posteriors(spark, sf_dir).select("cluster", r6(sampling.posterior_mean(), "mean"), r6(sampling.posterior_variance(), "variance"), "visits")


def gamma_sql(shape: str, name: str, key: str, source: str, seed: int = 42, round_no: int = 3) -> str:
    """Gamma draws (key, g) by the same trials."""
    u = lambda k: f"((0.5 + {u_sql(seed, name, str(round_no), key, 't', str(k))} * 4503599627370496.0) / 4503599627370496.0)"
    return f"""(SELECT {key}, arg_min(d * w, t) AS g FROM (SELECT *, pow(1 + x / sqrt(9 * d), 3) AS w FROM (SELECT {key}, t, {shape} - 1.0 / 3 AS d, sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)}) AS x, {u(2)} AS u3 FROM {source}, range(16) r(t)))
    WHERE w > 0 AND ln(u3) < x * x / 2 + d - d * w + d * ln(greatest(w, 1e-300)) GROUP BY {key})"""


THETA_SQL = f"WITH p AS (SELECT * FROM {POST_SQL}), a AS (SELECT * FROM {gamma_sql('alpha::DOUBLE', 'beta-a', 'cluster', 'p')}), b AS (SELECT * FROM {gamma_sql('beta::DOUBLE', 'beta-b', 'cluster', 'p')}), h AS (SELECT cluster, a.g / (a.g + b.g) AS theta, visits FROM a JOIN b USING (cluster) JOIN p USING (cluster))"


@query(THETA_SQL + " SELECT cluster, round(theta, 6) AS theta, row_number() OVER (ORDER BY theta DESC, cluster)::INT AS rank FROM h QUALIFY rank <= 3")
def thompson_topk(spark, sf_dir):  # B2 B3 B5 W7 L6
    return sampling.thompson_select(_posteriors(spark, sf_dir), 3, 3).select("cluster", r6(F.col("theta"), "theta"), "rank")


@query(THETA_SQL + f" SELECT cluster, row_number() OVER (ORDER BY visits = 0 DESC, CASE WHEN visits = 0 THEN {u_sql(42, 'warmup', '3', 'cluster')} ELSE theta END DESC, cluster)::INT AS rank FROM h QUALIFY rank <= 6")
def warmup_select(spark, sf_dir):  # B4 F11
    return sampling.thompson_select(_posteriors(spark, sf_dir), 6, 3, warmup_rounds=5).select("cluster", "rank")


BUDGET_IN = f"(SELECT cluster, alpha / (alpha + beta) AS weight, (20 + 11 * (cluster % 4))::BIGINT AS capacity, visits FROM {POST_SQL})"
SPREAD = """, s AS (SELECT *, greatest(0, room) AS r, {total} - sum(alloc) OVER () AS rest FROM {source})
SELECT cluster, (alloc + greatest(0, least(r, rest - coalesce(sum(r) OVER (ORDER BY weight DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS alloc FROM s"""


def _budget_input(spark, sf_dir):
    return _posteriors(spark, sf_dir).select("cluster", sampling.posterior_mean().alias("weight"), (20 + 11 * (F.col("cluster") % 4)).cast("bigint").alias("capacity"), "visits")


@query(f"WITH i AS (SELECT *, greatest(5, floor(40.0 / count(*) OVER ())) AS base, floor(600.0 / count(*) OVER ()) AS most FROM {BUDGET_IN}), b AS (SELECT *, least(capacity, base) AS a0, 200 - sum(least(capacity, base)) OVER () AS lft, sum(weight) OVER () AS ws FROM i), c AS (SELECT cluster, weight, CASE WHEN lft > 0 THEN least(capacity, a0 + floor(lft * weight / (ws + 1e-12)), most) ELSE a0 END AS alloc, capacity, most FROM b), d AS (SELECT *, least(capacity, most) - alloc AS room FROM c)" + SPREAD.format(total=200, source="d"))
def budget_allocate(spark, sf_dir):  # B6 W3 J7 F13 L4
    return sampling.allocate(_budget_input(spark, sf_dir), 200)


@query(f"WITH i AS (SELECT *, visits <= min(visits) OVER () + 1 AS low FROM {BUDGET_IN}), b AS (SELECT *, CASE WHEN low THEN least(capacity, floor(40.0 / sum(low::INT) OVER ())) ELSE 0 END AS a0 FROM i), c AS (SELECT *, 200 - sum(a0) OVER () AS lft, sum(weight) OVER () AS ws FROM b), d AS (SELECT cluster, weight, capacity, a0 + least(floor(lft * weight / (ws + 1e-12)), capacity - a0) AS alloc FROM c), e AS (SELECT *, capacity - alloc AS room FROM d)" + SPREAD.format(total=200, source="e"))
def budget_adaptive(spark, sf_dir):  # B8 F12
    return sampling.allocate_adaptive(_budget_input(spark, sf_dir), 200)


SCORED_SQL = KNN_SQL + RARITY_SQL + NOVELTY_SQL + ", g AS (SELECT y.id, y.cluster, rarity, novelty, 0.5 * ((y.id % 11) / 10.0::DOUBLE) + 0.5 * (0.5 * rarity + 0.5 * (1 - (y.id % 11) / 10.0::DOUBLE) * novelty) AS priority FROM y JOIN z USING (id))"


def _scored(spark, sf_dir):
    m, refs = _references(spark, sf_dir)
    df = sampling.rarity(m, refs).join(sampling.novelty(m, _history(spark, sf_dir)).drop("cluster"), "id")
    return df.withColumn("priority", sampling.priority((F.col("id") % 11) / 10.0, F.col("rarity"), F.col("novelty")))


@query(SCORED_SQL + " SELECT id, cluster, round(priority, 5) AS priority FROM g")
def priority_score(spark, sf_dir):  # B11
    return _scored(spark, sf_dir).select("id", "cluster", F.round("priority", 5).alias("priority"))


@query(f"SELECT doc_id AS id, round({u_sql(42, 'baseline', '0', 'doc_id')}, 9) AS u FROM documents ORDER BY {u_sql(42, 'baseline', '0', 'doc_id')}, doc_id LIMIT 50")
def random_baseline(spark, sf_dir):  # B13
    return sampling.random_baseline(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 50).select("id", F.round("u", 9).alias("u"))


# ---- feedback ----

@query(f"SELECT event_id, round(least(1, greatest(0, CASE WHEN event_id % 3 = 0 THEN error ELSE (0.4 * error + 0.6 * (event_id % 2)) / (0.4 + 0.6) END)), 6) AS intensity FROM ({EV})")
def error_intensity(spark, sf_dir):  # E1
    e = events(spark, sf_dir)
    right = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 2).cast("double"))
    return e.select("event_id", r6(feedback.error_intensity({"loss": F.col("error"), "correctness": right}, {"loss": 0.4, "correctness": 0.6, "entropy": 0.0}), "intensity"))


FOLD_SQL = f"""
WITH RECURSIVE b AS (SELECT round AS batch, avg(value) AS m, var_pop(value) AS v, row_number() OVER (ORDER BY round) AS k FROM ({EV}) GROUP BY round),
f AS (SELECT batch, k, m AS mean, v AS var FROM b WHERE k = 1 UNION ALL SELECT b.batch, b.k, 0.99::DOUBLE * f.mean + (1 - 0.99::DOUBLE) * b.m, 0.99::DOUBLE * f.var + (1 - 0.99::DOUBLE) * b.v FROM f JOIN b ON b.k = f.k + 1)
"""


def _batches(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("round").alias("batch"), "event_id", "value")


@query(FOLD_SQL + "SELECT batch, round(mean, 6) AS mean, round(var, 6) AS var FROM f")
def running_stats(spark, sf_dir):  # W5 A12 E8
    return feedback.running_stats(_batches(spark, sf_dir)).select("batch", r6(F.col("mean"), "mean"), r6(F.col("var"), "var"))


@query(FOLD_SQL + f"SELECT event_id, round(least(1, greatest(0, (value - mean) / sqrt(var + 1e-12) + 0.5)), 6) AS error FROM ({EV}) e JOIN f ON f.batch = e.round")
def loss_zscore(spark, sf_dir):  # E2 E18
    return feedback.zscore_errors(_batches(spark, sf_dir)).select("event_id", r6(F.col("error"), "error"))


@query(FOLD_SQL + f"SELECT event_id, round(1 / (1 + exp(-(value - mean) / sqrt(var + 1e-12))), 6) AS error FROM ({EV}) e JOIN f ON f.batch = e.round")
def loss_sigmoid(spark, sf_dir):  # E5
    return feedback.sigmoid_errors(_batches(spark, sf_dir)).select("event_id", r6(F.col("error"), "error"))


@query(f"SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS minmax, round((row_number() OVER (PARTITION BY round ORDER BY value, event_id) - 1) / (count(*) OVER w - 1 + 1e-12), 6) AS percentile, round(least(1, greatest(0, (value - avg(value) OVER w) / stddev_pop(value) OVER w + 0.5)), 6) AS zscore FROM ({EV}) WINDOW w AS (PARTITION BY round)")
def batch_normalisation(spark, sf_dir):  # E3 E4 E6 E9 W1
    b, w = _batches(spark, sf_dir), Window.partitionBy("batch")
    return b.select("event_id", r6(feedback.minmax("value", w), "minmax"), r6(feedback.percentile("value", "batch", "event_id"), "percentile"), r6(feedback.batch_zscore("value", w), "zscore"))


@query("""
WITH e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * 10) AS l, label FROM embeddings), p AS (SELECT id, l, label, list_max(l) AS t, list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS s FROM e)
SELECT id, round(ln(s) + t - l[label + 1], 6) AS loss, round(-list_sum(list_transform(l, lambda x: exp(x - t) / s * ln(exp(x - t) / s + 1e-12))), 6) AS entropy FROM p
""")
def logit_loss_entropy(spark, sf_dir):  # E7
    m = members(spark, sf_dir).select("id", "cluster", F.transform("v", lambda x: x * 10).alias("l"))
    loss, entropy = feedback.logit_losses(F.col("l"), F.col("cluster"))
    return m.select("id", r6(loss, "loss"), r6(entropy, "entropy"))


CE = f"(SELECT m.cluster, count(*) AS n, avg(error) AS mean_error, stddev_pop(error) AS std_error, min(error) AS min_error, max(error) AS max_error, sum(error) AS gain, sum(1 - error) AS loss FROM ({EV}) e JOIN ({S}) m ON m.id = e.id GROUP BY m.cluster)"


@query(f"SELECT cluster, n, round(mean_error, 6) AS mean_error, round(std_error, 6) AS std_error, round(min_error, 6) AS min_error, round(max_error, 6) AS max_error FROM {CE}")
def cluster_error_stats(spark, sf_dir):  # J3 A8 A9 E16 E17
    return feedback.cluster_errors(events(spark, sf_dir), members(spark, sf_dir)).select("cluster", "n", *[r6(F.col(c), c) for c in ("mean_error", "std_error", "min_error", "max_error")])


@query(f"WITH p AS (SELECT DISTINCT cluster FROM ({S})) SELECT cluster, round(1 + coalesce(gain, 0), 6) AS alpha, round(1 + coalesce(loss, 0), 6) AS beta, 0::BIGINT AS visits FROM p LEFT JOIN {CE} c USING (cluster)")
def posterior_update(spark, sf_dir):  # A10 K13, from the start, so that each event counts once
    m = members(spark, sf_dir)
    start = sampling.initial_posteriors(m.select("cluster").distinct())
    return feedback.updated_posteriors(start, feedback.cluster_errors(events(spark, sf_dir), m)).select("cluster", r6(F.col("alpha"), "alpha"), r6(F.col("beta"), "beta"), "visits")


@query(f"WITH r AS (SELECT id, error, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM ({EV})) SELECT id, round(sum(error * (1 - 0.7::DOUBLE) * pow(0.7::DOUBLE, age)) + 0.5 * pow(0.7::DOUBLE, count(*)), 6) AS difficulty FROM r GROUP BY id")
def difficulty_ema(spark, sf_dir):  # W6
    return feedback.difficulties(_ordered(spark, sf_dir)).select("id", r6(F.col("difficulty"), "difficulty"))


def _ordered(spark, sf_dir):
    """Feedback with a round of its own for each event of a sample."""
    e = events(spark, sf_dir)
    return e.select("id", "error", F.struct("ts", "event_id").alias("round"), "event_id")


STREAK_SQL = f"""
WITH e AS (SELECT id, event_id, ts, error, sum(CASE WHEN error < 0.1 THEN 0 ELSE 1 END) OVER w AS island FROM ({EV}) WINDOW w AS (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum(CASE WHEN error < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM e),
t AS (SELECT *, bool_or(streak >= 2) OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS retired FROM s)
"""


@query(STREAK_SQL + "SELECT event_id, id, streak::BIGINT AS streak, retired FROM t")
def retirement_streak(spark, sf_dir):  # W4 F9
    return feedback.retirement(_ordered(spark, sf_dir), 0.1, 2).select("event_id", "id", "streak", "retired")


def _retired(spark, sf_dir):
    return feedback.retirement(_ordered(spark, sf_dir), 0.1, 2).groupBy("id").agg(F.max("retired").alias("retired"))


@query(STREAK_SQL + ", u AS (SELECT id, bool_or(retired) AS retired FROM t GROUP BY id) SELECT count(*) AS total, count(*) FILTER (retired) AS retired, count(*) FILTER (NOT retired) AS active, round(count(*) FILTER (retired) / count(*)::DOUBLE, 6) AS rate FROM u")
def retirement_stats(spark, sf_dir):  # A13
    return feedback.retirement_stats(_retired(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(STREAK_SQL + f", u AS (SELECT id, bool_or(retired) AS retired FROM t GROUP BY id) SELECT id FROM u WHERE NOT retired OR {u_sql(42, 'revisit', '4', 'id')} < 0.3")
def revisit_filter(spark, sf_dir):  # F3 F7 B14
    return sampling.active(_retired(spark, sf_dir), 0.3, round_no=4).select("id")


@query(r"""
WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'so #### ' || round(value, 2)::VARCHAR WHEN 1 THEN 'hence \boxed{' || (event_id % 50)::VARCHAR || '}' WHEN 2 THEN 'The answer is: ' || (event_id * 1000)::VARCHAR WHEN 3 THEN 'numbers 12 and ' || (event_id % 9)::VARCHAR ELSE 'none' END AS t, (event_id % 50)::VARCHAR AS ref FROM events),
a AS (SELECT event_id, ref, coalesce(nullif(regexp_extract(t, '#### ([-\d,\.]+)', 1), ''), nullif(regexp_extract(t, '\\boxed\{([^}]+)\}', 1), ''), nullif(regexp_extract(t, 'The answer is[:\s]*([-\d,\.]+)', 1), ''), regexp_extract_all(t, '-?\d+(?:,\d+)*(?:\.\d+)?')[-1]) AS answer FROM b)
SELECT event_id, answer, CASE WHEN answer IS NOT NULL AND abs(try_cast(answer AS DOUBLE) - ref::DOUBLE) <= 0.001 THEN 0.0 ELSE 1.0 END::DOUBLE AS error FROM a
""")
def math_answers(spark, sf_dir):  # E10 E11 E12 E13 L8 J14
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    t = F.when(k == 0, F.concat(F.lit("so #### "), F.round("value", 2).cast("string"))).when(k == 1, F.concat(F.lit("hence \\boxed{"), (F.col("event_id") % 50).cast("string"), F.lit("}"))).when(k == 2, F.concat(F.lit("The answer is: "), (F.col("event_id") * 1000).cast("string"))).when(k == 3, F.concat(F.lit("numbers 12 and "), (F.col("event_id") % 9).cast("string"))).otherwise("none")
    return e.select("event_id", t.alias("t"), (F.col("event_id") % 50).cast("string").alias("ref")).select("event_id", text.math_answer(F.col("t")).alias("answer"), text.math_error(F.col("t"), F.col("ref")).alias("error"))


@query("SELECT event_type AS task, count(*) AS n, round(avg(((event_id % 7) > 2)::INT) * 100, 6) AS accuracy FROM events GROUP BY event_type")
def task_accuracy(spark, sf_dir):  # A19 E15
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count(F.lit(1)).alias("n"), r6(feedback.accuracy(F.col("event_id") % 7 > 2), "accuracy"))


@query("""
WITH b AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark), n AS (SELECT count(*) AS items FROM benchmark)
SELECT d.doc_id, b.pos, coalesce(contains(lower(d.text), lower(trim(b.text))) OR contains(lower(b.text), lower(trim(d.text))), false) AS correct
FROM (SELECT *, coalesce(((doc_id % items) + items) % items, 0) AS pos FROM documents, n) d FULL JOIN b USING (pos)
""")
def containment_match(spark, sf_dir):  # F15, every document and every item; an item that no document meets has a null doc_id
    items = table(spark, sf_dir, "benchmark")
    b = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("pos"), F.col("text").alias("target"))
    n = items.agg(F.count(F.lit(1)).alias("items"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).withColumn("at", F.when(F.col("items") > 0, F.coalesce(F.pmod("doc_id", "items"), F.lit(0))))
    # The items that no document meets come on their own, so that documents are never exchanged.
    met = d.join(F.broadcast(b), F.col("at") == F.col("pos"), "left").select("doc_id", "pos", F.coalesce(text.contains_match(F.col("target"), F.col("text")), F.lit(False)).alias("correct"))
    alone = b.join(d.select("at").distinct(), F.col("at") == F.col("pos"), "left_anti").select(F.lit(None).cast("long").alias("doc_id"), "pos", F.lit(False).alias("correct"))
    return met.unionByName(alone)


@query("WITH r AS (SELECT event_id % 2 AS m, event_type, (event_id % 7 > 2)::INT AS ok FROM events) SELECT event_type AS task, round(avg(ok) FILTER (m = 0) * 100, 6) AS method, round(avg(ok) FILTER (m = 1) * 100, 6) AS baseline, round(avg(ok) FILTER (m = 0) * 100 - avg(ok) FILTER (m = 1) * 100, 6) AS delta FROM r GROUP BY event_type")
def compare_methods(spark, sf_dir):  # J16
    ok = (F.col("event_id") % 7 > 2).cast("int")
    mean = lambda m: F.avg(F.when(F.col("event_id") % 2 == m, ok)) * 100
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(r6(mean(0), "method"), r6(mean(1), "baseline"), r6(mean(0) - mean(1), "delta"))


@query("SELECT (event_id % 200) AS id, 1 - count(*) FILTER (event_id % 3 > 0) / count(*)::DOUBLE AS error FROM events GROUP BY 1".replace("1 - count", "round(1 - count").replace("::DOUBLE AS error", "::DOUBLE, 6) AS error"))
def test_results(spark, sf_dir):  # E14 E19
    t = table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("id"), (F.col("event_id") % 3 > 0).alias("passed"))
    return feedback.test_errors(t).select("id", r6(F.col("error"), "error"))


# ---- state ----

@query("SELECT e.vec_id AS id, e.label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en')")
def incremental_skip(spark, sf_dir):  # J6 U2 M22
    done = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return sinks.missing_only(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), done)


@query("SELECT coalesce(d.doc_id, e.vec_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'extra' ELSE 'missing' END AS state FROM (SELECT * FROM documents WHERE doc_id % 3 > 0) d FULL JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL OR e.vec_id IS NULL")
def cache_diff(spark, sf_dir):  # J5 U3
    want = table(spark, sf_dir, "documents").filter("doc_id % 3 > 0").select("doc_id")
    have = table(spark, sf_dir, "embeddings").select("vec_id")
    both = want.join(have, F.col("doc_id") == F.col("vec_id"), "full").filter("doc_id is null or vec_id is null")
    return both.select(F.coalesce("doc_id", "vec_id").alias("id"), F.when(F.col("doc_id").isNull(), "extra").otherwise("missing").alias("state"))


@query("SELECT r.conv_id AS pos, e.vec_id AS id, e.label FROM (SELECT DISTINCT conv_id FROM conversations) r JOIN embeddings e ON e.vec_id = r.conv_id * 3")
def ids_to_vectors(spark, sf_dir):  # J1 J2 J18
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pos"), (F.col("conv_id") * 3).alias("id")).distinct()
    return asked.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").select("pos", "id", "label")


@query("SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 4 = 0 THEN n_chars / 10000.0::DOUBLE END, 0.5) AS difficulty, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS note FROM documents")
def sample_update(spark, sf_dir):  # K5 K7 K14
    d = table(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").alias("id"), F.lit(0.5).alias("difficulty"), F.col("source").alias("note"))
    new = d.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 10000.0).alias("difficulty"), F.col("lang").alias("note"), F.lit(1).alias("unknown"))
    return sinks.updated(old, new, "id")


@query("SELECT doc_id AS id, false AS is_representative, 0.5::DOUBLE AS difficulty, 0.5::DOUBLE AS rarity, 1.0::DOUBLE AS novelty, 0 AS times_selected, 0.5::DOUBLE AS last_error_intensity, 0 AS consecutive_low_error, false AS retired FROM documents")
def sample_defaults(spark, sf_dir):  # S12 K6
    return sinks.with_sample_defaults(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query(f"SELECT round, count(*) AS n FROM ({EV}) GROUP BY round ORDER BY round DESC LIMIT 5")
def checkpoint_retention(spark, sf_dir):  # K8 S13 W9 W10
    return sinks.retained(events(spark, sf_dir).groupBy("round").agg(F.count(F.lit(1)).alias("n")), 5)


@query(f"WITH r AS (SELECT e.round, count(*) AS n_updated, avg(error) AS avg_error, count(DISTINCT m.cluster) AS n_clusters FROM ({EV}) e JOIN ({S}) m USING (id) GROUP BY round) SELECT round, n_updated, round(avg_error, 6) AS avg_error, n_clusters, n_clusters / 10.0::DOUBLE AS coverage FROM r")
def round_stats(spark, sf_dir):  # A21
    e = events(spark, sf_dir).join(members(spark, sf_dir).select("id", "cluster"), "id")
    return e.groupBy("round").agg(F.count(F.lit(1)).alias("n_updated"), r6(F.avg("error"), "avg_error"), F.countDistinct("cluster").alias("n_clusters")).withColumn("coverage", F.col("n_clusters") / 10.0)


@query(f"WITH r AS (SELECT round, avg(error) AS e FROM ({EV}) GROUP BY round) SELECT round(arg_min(e, round), 6) AS first_error, round(arg_max(e, round), 6) AS last_error, round(avg(e), 6) AS mean_error FROM r")
def training_summary(spark, sf_dir):  # A22
    r = events(spark, sf_dir).groupBy("round").agg(F.avg("error").alias("e"))
    return r.agg(r6(F.min_by("e", "round"), "first_error"), r6(F.max_by("e", "round"), "last_error"), r6(F.avg("e"), "mean_error"))


@query("SELECT user_id % 10 AS worker, round(avg(value), 6) AS mean_load, max(value) AS peak_load, count(*) FILTER (value > 450) AS alerts FROM events GROUP BY 1")
def resource_summary(spark, sf_dir):  # A23 F14
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("worker")).agg(r6(F.avg("value"), "mean_load"), F.max("value").alias("peak_load"), F.count_if(F.col("value") > 450).alias("alerts"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def history_union(spark, sf_dir):  # U4 U6
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return d.filter("id % 2 = 0").union(d.filter("id % 3 = 0")).distinct()


@query("SELECT doc_id AS id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def ids_in_both(spark, sf_dir):  # U5
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).intersect(table(spark, sf_dir, "embeddings").select("vec_id"))


@query("SELECT doc_id, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', 'over' FROM documents")
def deep_merge(spark, sf_dir):  # J15, of every document
    d = table(spark, sf_dir, "documents")
    merged = F.map_zip_with(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), F.create_map(F.lit("source"), F.lit("over")), lambda k, a, b: F.coalesce(b, a))
    return d.select("doc_id", F.explode(merged).alias("key", "value"))


@query("""
SELECT * FROM (VALUES ('budget.base_ratio', '0.2'), ('budget.total', '500'), ('clustering.k', '100'), ('clustering.noise', '"drop"'), ('priority.ratios', '[0.7, 0.3]'), ('retirement.patience', '3')) t(key, value)
""")
def config_merge(spark, sf_dir):  # J15 P18 of configurations
    from .plans.config import DEFAULTS, merged

    over = {"budget": {"total": 500}, "clustering": {"noise": "drop"}, "priority": {"ratios": [0.7, 0.3]}}
    config = merged(DEFAULTS, over)
    rows = [(f"{a}.{b}", json.dumps(config[a][b])) for a, b in (("budget", "base_ratio"), ("budget", "total"), ("clustering", "k"), ("clustering", "noise"), ("priority", "ratios"), ("retirement", "patience"))]
    return spark.createDataFrame(rows, "key string, value string")


@query()
def hash_embedding(spark, sf_dir):  # M1 M2 M3 M4 M5
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return embedding.embed(texts, embedding.HashEncoder(64)).select("id", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(f"SELECT cluster, count(*) AS size, bool_or(id % 7 = 0) AS selected FROM ({S}) GROUP BY cluster")
def plot_data(spark, sf_dir):  # M21
    return members(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("id") % 7 == 0).alias("selected"))


# ---- streaming ----

def _streamed(spark: SparkSession, df: DataFrame, run: Callable[[DataFrame], DataFrame], mode: str, batches: list | None = None) -> DataFrame:
    """Run a streaming query over the rows of ``df``, written as files, to its end; what it has put out.

    With ``batches``, conditions that share out the rows, each batch is a file, and the files arrive in this order.
    """
    folder = _scratch(spark, "stream")
    if batches is None:
        df.repartition(3).write.parquet(f"{folder}/in")
    for batch in batches or []:
        df.filter(batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = run(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    out = f"{folder}/out"
    query_ = done.foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query_.awaitTermination()
    return spark.read.parquet(out)


@query(f"SELECT (id % 10)::INT AS cluster, round(1 + sum(error), 6) AS alpha, round(1 + sum(1 - error), 6) AS beta FROM ({EV}) GROUP BY 1")
def stream_posterior(spark, sf_dir):  # section 2.14
    e = events(spark, sf_dir).select((F.col("id") % 10).cast("int").alias("cluster"), "error")
    got = _streamed(spark, e, streaming.stream_posteriors, "complete")
    last = got.agg(F.max("_batch")).first()[0]
    return got.filter(F.col("_batch") == last).select("cluster", r6(F.col("alpha"), "alpha"), r6(F.col("beta"), "beta"))


@query(STREAK_SQL + f" SELECT id, arg_max(t.streak::BIGINT, (e.ts, event_id)) AS streak, bool_or(t.retired) AS retired, count(*) AS n FROM t JOIN (SELECT event_id, ts FROM ({EV})) e USING (event_id) GROUP BY id")
def stream_retirement(spark, sf_dir):  # W4 as a stream, each sample's state at the end
    e = events(spark, sf_dir).select("id", F.row_number().over(Window.partitionBy("id").orderBy("ts", "event_id")).cast("long").alias("round"), "error", F.col("round").alias("day"))
    batches = [F.col("day") < 10, F.col("day").between(10, 19), (F.col("day") >= 20) | F.col("day").isNull()]
    got = _streamed(spark, e, lambda s: streaming.stream_retirement(s, 0.1, 2), "update", batches)
    last = got.groupBy("id").agg(F.max_by(F.struct("streak", "retired", "n"), "_batch").alias("s"))
    return last.select("id", "s.*")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_feedback(spark, sf_dir):  # extension of section 2.14
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    day = F.dayofmonth("ts")
    got = _streamed(spark, e, streaming.windowed_feedback, "update", [day <= 10, day.between(11, 20), (day > 20) | day.isNull()])
    last = got.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "mean"), "_batch").alias("w")).select("start", "event_type", "w.*")
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6(F.col("mean"), "mean"))


# ---- the whole pipeline ----

@query()
def pipeline_rounds(spark, sf_dir):
    """Two rounds of selection and feedback over the embeddings, clustered by k-means; the history."""
    from .plans.config import preset
    from .plans.pipeline import SelectionPipeline

    config = preset("small", {"clustering": {"algorithm": "kmeans", "k": 8}, "embedding": {"pca_dim": None}, "compression": {"max_representatives": 20, "reference_size": 16}, "budget": {"total": 40}})
    p = SelectionPipeline(spark, _scratch(spark, "pipeline"), config)
    v = members(spark, sf_dir).select("id", "v")
    samples = v.select("id", F.col("id").cast("string").alias("instruction"), F.lit("").alias("input"), F.lit("").alias("output"))
    p.run_offline(samples=samples, vectors=v)
    return p.train(2, lambda picked: picked.select("id", (F.col("id") % 10 / 10.0).alias("error"))).select("round", "n_selected", "n_clusters_selected", r6(F.col("avg_error"), "avg_error"))
