"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and rereads as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_lattice
from siftline.llm.durable import durable, ensure_checkpoint_dir
from siftline.llm.queries import piece_model, table


def _with(docs: DataFrame, *columns) -> DataFrame:
    """Whole rows of ``docs`` as one column ``doc``, whatever their columns are called, next to ``columns``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on a bounded sample of those with labels.

    Rows are judged one by one: null and empty texts get the model's score for no words, repeated rows equal scores, and a null
    ``doc_id`` only keeps a row out of the sample. An empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.score(_with(docs, "text"), model).filter(F.col("score") >= quality.THRESHOLD).select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, also where rows repeat a ``doc_id`` or lack one.

    Null, empty and blank texts are one group. Of rows alike in id, normalised text and length, that with the smallest hash stays.
    """
    kept = exact_dedup.exact_duplicates(docs).filter("kept").select("doc_id", "text_sha256", "n_points")
    sha, points = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256), F.char_length(F.coalesce("text", F.lit("")))
    own = _with(docs, "doc_id", sha.alias("sha"), points.alias("points"))
    same = own.doc_id.eqNullSafe(kept.doc_id) & (own.sha == kept.text_sha256) & (own.points == kept.n_points)
    return own.join(kept, same, "left_semi").groupBy("doc_id", "sha", "points").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near duplicates link: that with the smallest id (null before all others), then the smallest hash.

    Rows go by a hash of id and text, not by ``doc_id``, which may be null or repeat. Of rows equal in both one stays, but
    texts without words (null, empty, blank) are linked with nothing, and all of them stay.
    """
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    linked = ngram_join.ngram_components(docs.select(row.alias("doc_id"), "text")).dropDuplicates(["doc_id"])
    ids = docs.select(row.alias("row"), F.col("doc_id").alias("id")).dropDuplicates(["row"])
    first = linked.join(ids, F.col("doc_id") == F.col("row")).groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first"), F.max("n_shingles").alias("n"))
    first = durable(first.select("first.row", "n")).select((F.col("row") + 0).alias("row"), "n")
    numbered = _with(docs, row.alias("row")).withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64("doc"))))
    return numbered.join(first, "row").filter("k = 1 or n = 0").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to three times); those that it does not take go.

    Rows of one id, source and size (any of which may be null or repeat) are alike to the mix: its numbers of copies are dealt to them, the
    largest first. Null, empty and blank texts have no words, so the mix does not take them.
    """
    like = lambda size: F.struct("doc_id", "source", size.alias("size"))  # noqa: E731  (a struct's null fields are equal)
    counts = [F.count_if(F.col("copies") >= k).alias(f"times_{k}") for k in (1, 2, 3)]
    copies = durable(mixing.mix(docs).filter("copies > 0").groupBy(like(F.col("size")).alias("like")).agg(*counts))
    numbered = _with(docs, like(mixing.word_count(F.col("text"))).alias("like")).withColumn("k", F.row_number().over(Window.partitionBy("like").orderBy(F.xxhash64("doc"))))
    times = sum((F.col("k") <= F.col(f"times_{k}")).cast("int") for k in (1, 2, 3))
    repeated = numbered.join(copies, "like").withColumn("times", times).filter("times > 0")
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document and copy: doc_id, n_bytes, n_pieces, and the digest of the token ids. Null and empty texts have no pieces."""
    return sentencepiece_lattice.encode(docs, piece_model()).select("doc_id", "n_bytes", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("SentencePiece encoding", tokens)]

#: The classifier, the random rounding and the encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
