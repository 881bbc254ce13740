"""Exact dedup by deterministic block naming.

Each document's normalised bytes are cut into blocks of fixed size. Sorting brings equal blocks
together and gives each distinct block an integer name. Adjacent names are then paired and the
pairs named in the same way, until every document is left with a single name. Two documents have
the same (level, name) exactly when their texts are equal: names stand for contents, not for hashes,
so there are no collisions.

Only DataFrame functions are used.

Skew: a block that a third of all rows share is sorted in as many salted groups as there are shuffle
partitions. Each salted group elects a local name, and only one row per salted group goes on to
elect the global name. No task sees all the copies of a block.

Defined cases: null text is the empty text; the empty text is a document of one empty block, so all
empty texts are equal. Rows that repeat a ``doc_id`` are separate documents; of rows that tie in
length and ``doc_id`` exactly one is kept. A null ``doc_id`` sorts before all others. Columns other
than ``doc_id`` and ``text`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, shuffle_width

#: Bytes of a block. Larger blocks mean fewer naming levels; a level costs four small shuffles.
BLOCK_BYTES = 16384

WHITESPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """``text`` without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, "")


def name_values(df: DataFrame, values: list[str]) -> DataFrame:
    """Integer names for equal ``values``: the identity of one of the rows that share them.

    ``meta`` is an array of strings whose first item is the row's unique identity, a long; it goes along
    whole, so that both uses of the sorted rows need the same columns and Spark makes a single exchange
    of the contents, which is read twice. The result has ``meta`` and ``name``.
    """
    salts = shuffle_width(df.sparkSession)
    salted = df.select(*values, "meta", F.pmod(F.xxhash64(F.col("meta")[0]), F.lit(salts)).alias("_salt"))
    local = salted.withColumn("_elected", F.min("meta").over(Window.partitionBy("_salt", *values)))
    electors = local.filter(F.col("_elected")[0] == F.col("meta")[0]).select(*values, F.col("meta")[0].cast("long").alias("_local"))
    groups = electors.groupBy(*values).agg(F.min("_local").alias("name"), F.collect_list("_local").alias("_members"))  # at most `salts` members
    names = groups.select("name", F.explode("_members").alias("_local"))
    return local.select("meta", F.col("_elected")[0].cast("long").alias("_local")).join(names, "_local").select("meta", "name")


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, n_points, text_sha256, level, name): one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"),
        normalised(F.col("text")).cast("binary").alias("bytes"),
    )
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(float(block_bytes)))).cast("int")
    cut = base.select(
        "rid", "doc_id", "n_points", F.sha2("bytes", 256).alias("sha"), n_blocks.alias("n"),
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes))).alias("blocks"),
    )
    blocks = cut.select("rid", "doc_id", "n_points", "sha", "n", F.posexplode_outer("blocks").alias("i", "block"))
    # What belongs to the document travels with its first block only, as strings in one column.
    first = lambda c: F.when(F.col("i") == 0, F.col(c).cast("string"))
    blocks = blocks.withColumn("bid", F.monotonically_increasing_id())
    packed = lambda *names: F.array(*[F.col(c).cast("string") for c in names])
    meta = F.concat(packed("bid", "rid", "i", "n"), F.array(first("doc_id"), first("n_points"), first("sha")))
    named = name_values(blocks.select(meta.alias("meta"), "block"), ["block"])
    m = lambda k, t: F.col("meta")[k].cast(t)
    level0 = durable(named.select(m(0, "long").alias("bid"), m(1, "long").alias("rid"), m(2, "int").alias("i"), m(3, "int").alias("n"), m(4, kind).alias("doc_id"), m(5, "int").alias("n_points"), F.col("meta")[6].alias("text_sha256"), "name"))

    heads = level0.filter("i = 0").select("rid", "doc_id", "n_points", "text_sha256", "n", "name")
    current = level0.filter("n > 1").select("rid", "i", "n", "bid", "name")
    longest = level0.agg(F.max("n")).first()[0] or 1
    finished, level = None, 0
    while longest > 1:  # as many rounds as the longest document has doublings of a block
        level += 1
        longest = -(-longest // 2)
        pairs = current.groupBy("rid", F.shiftright("i", 1).alias("i")).agg(
            F.min("bid").alias("bid"),
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.ceil(F.max("n") / 2).cast("int").alias("n"),
        )
        named = name_values(pairs.select(packed("bid", "rid", "i", "n").alias("meta"), "left", "right"), ["left", "right"])
        current = durable(named.select(m(0, "long").alias("bid"), m(1, "long").alias("rid"), m(2, "int").alias("i"), m(3, "int").alias("n"), "name"))
        done = current.filter("n = 1").select("rid", F.lit(level).alias("_level"), F.col("name").alias("_name"))
        finished = done if finished is None else finished.unionByName(done)
        current = current.filter("n > 1")
    if finished is None:
        return heads.select("rid", "doc_id", "n_points", "text_sha256", F.lit(0).alias("level"), "name")
    one, more = heads.filter("n = 1"), heads.filter("n > 1")
    return one.select("rid", "doc_id", "n_points", "text_sha256", F.lit(0).alias("level"), "name").unionByName(
        more.join(finished, "rid").select("rid", "doc_id", "n_points", "text_sha256", F.col("_level").alias("level"), F.col("_name").alias("name"))
    )


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    ``doc_id``.
    """
    named = durable(document_names(docs, block_bytes))
    groups = (
        named.groupBy("level", "name")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n_points")).alias("p"), "doc_id", "rid")).alias("keep"))
        .filter("group_size > 1")
    )
    # Written, and its keys made anew, so that both sides of the join are exchanged and a hot group can be split.
    groups = durable(groups).select((F.col("level") + 0).alias("level"), (F.col("name") + 0).alias("name"), "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.rid").alias("keep_rid"))
    return named.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_points",
    )
