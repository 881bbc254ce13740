"""A bounded sample of labelled rows, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts (in code points) are not learnt from, so that the sample is bounded in bytes, too. All texts are scored.
SAMPLE_CHARS = 1 << 17


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, seed: int, where=None, chars: int = SAMPLE_CHARS):
    """At most ``rows`` labelled documents of at most ``chars`` code points as pandas (doc_id, text, label), whole texts, chosen by hash.

    Ids with contradicting labels are left out. The others are chosen among the labels first, half of the rows for each class as
    far as there are that many; so at most ``rows`` ids are broadcast to the one scan of the documents. Of rows that
    repeat an id the one whose text has the smallest hash is taken.
    """
    label = F.col(column).cast("int")
    known = labels.select("doc_id", label.alias("label")).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label")
    if where is not None:
        known = known.filter(where)
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = known.filter("label = 1").orderBy(order, "doc_id").limit(rows // 2).unionByName(known.filter("label <> 1").orderBy(order, "doc_id").limit(rows // 2))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.char_length("text") <= chars).join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"), F.first("label").alias("label")).select("doc_id", "one.text", "label").toPandas()
    return found.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
