"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words. A document of a source with target T and size total S
has the expected number of copies T / S: every document gets the whole part, and the fractions are
rounded so that the source's words stay at the target. The pivotal method pairs fractional documents and
randomly moves words from one side to the other until one has no copy or a whole one. Words are conserved in
each step, so a source misses its target by less than one document; each document keeps its probability.

In a node documents go from the largest to the smallest, and the partner of each is all that are smaller, taken together:
words come from them, or go to them, in fixed proportions, which keep every expectation, so it becomes whole at once. Where
the smaller ones have too few words for that, the rest are paired one by one, from the smallest. What a node leaves
open, and a source misses at last, is so a small document wherever the sizes allow.

Leaves of at most a few dozen documents are folded first; each leaves at most one fractional
document, and those residuals go up a reduction tree of fixed fan-in, until one per source is
left. Only DataFrame functions are used, and no task holds more than a leaf.

Defined cases: null or blank texts have size 0 and take 0 words; a source of size 0 has the target
0; a null source is a source of its own, after all others. Rows that repeat a ``doc_id`` are
mixed as separate documents: equal ones are counted, numbered and dealt to leaves by their numbers, so that
a group of copies fills many leaves. An empty table has no rows. Extra columns are ignored. Random numbers are hashes of the
seed and the documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Documents of a leaf, on average, and residuals that a node of the tree combines.
LEAF = 96
FAN_IN = 96
#: Equal rows that one row stands for while copies are numbered.
CHUNK = 4096

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target): weights 1, 2, 3, repeating by code point, null last.

    The weights share all words; a target stops at ``cap`` times its source's size, and the excess is
    shared again by weight until none is above. That is the level ``l`` at which the sum
    of ``min(cap, l * weight)`` is the total: sources fill up in the order of cap / weight. Works
    on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    caps = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = caps.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("filled"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    levels = levels.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_weight"))
    # the first source that does not fill up sets the level; all later ones are below their caps, too
    unfilled = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    level = F.first(unfilled, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap")).alias("target"))


#: A document in the fold: its hash, its words, and its expected words beyond whole copies (0 to size).
ENTRY = "struct<key:bigint,doc_id:{},size:bigint,mass:double>"


def _unit(*cols: Column) -> Column:
    """Uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(a: Column, b: Column, seed: int) -> Column:
    """Move words between two fractional documents until one of them is whole; an array of both."""
    s_a, m_a, s_b, m_b = a["size"].cast("double"), a["mass"], b["size"].cast("double"), b["mass"]
    up, down = F.least(s_a - m_a, m_b), F.least(m_a, s_b - m_b)  # words that can go from b to a, and from a to b
    rise = _unit(F.lit(seed), a["key"], b["key"]) < down / (up + down)
    new_a = F.when(rise, F.when(up >= s_a - m_a, s_a).otherwise(m_a + up)).otherwise(F.when(down >= m_a, F.lit(0.0)).otherwise(m_a - down))
    new_b = F.when(rise, F.when(up >= m_b, F.lit(0.0)).otherwise(m_b - up)).otherwise(F.when(down >= s_b - m_b, s_b).otherwise(m_b + down))
    with_mass = lambda d, m: F.struct(d["key"].alias("key"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), m.alias("mass"))
    return F.array(with_mass(a, new_a), with_mass(b, new_b))


def _whole(d: Column) -> Column:
    return (d["mass"] <= 0.0) | (d["mass"] >= d["size"].cast("double"))


def _slack(d: Column) -> Column:
    """How many words a document can both give and take."""
    return F.greatest(F.lit(0.0), F.least(d["mass"], d["size"].cast("double") - d["mass"]))


def _pooled(docs: Column, seed: int) -> Column:
    """Entries with new masses: entry k pivots against all later ones together, if those can close it for certain.

    They give or take its words in proportion to their slack, so none leaves its bounds.
    """

    def step(state: Column, k: Column) -> Column:
        a = F.get(state, k)
        size, mass = a["size"].cast("double"), a["mass"]
        room = F.aggregate(F.slice(state, k + 2, F.greatest(F.size(state) - k - 1, F.lit(0))), F.lit(0.0), lambda total, d: total + _slack(d))
        rise = _unit(F.lit(seed), F.lit("pool"), a["key"]) < mass / size  # to one more copy

        def moved(room: Column) -> Column:
            to_a = F.when(rise, size - mass).otherwise(-mass)
            theirs = lambda d: F.greatest(F.lit(0.0), F.least(d["size"].cast("double"), d["mass"] - to_a * _slack(d) / room))
            new = lambda d, j: F.when(j == k, F.when(rise, size).otherwise(F.lit(0.0))).when((j > k) & ~_whole(d), theirs(d)).otherwise(d["mass"])
            changed = F.transform(state, lambda d, j: F.struct(d["key"].alias("key"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), new(d, j).alias("mass")))
            return F.when(room >= F.greatest(mass, size - mass), changed).otherwise(state)

        return F.when(_whole(a), state).otherwise(F.get(F.transform(F.array(room), moved), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.size(docs) - 1), docs, step)


def _fold(docs: Column, entry: str, seed: int) -> Column:
    """Pair an array of entries one by one into (open, done): at most one fractional document, and all others."""
    start = F.struct(F.lit(None).cast(entry).alias("open"), F.array().cast(f"array<{entry}>").alias("done"))

    def step(acc: Column, doc: Column) -> Column:
        return F.when(
            _whole(doc), F.struct(acc["open"].alias("open"), F.concat(acc["done"], F.array(doc)).alias("done"))
        ).when(
            acc["open"].isNull(), F.struct(doc.alias("open"), acc["done"].alias("done"))
        ).otherwise(
            # `done` gets the whole ones of the pair; what may be left is the new open document
            F.aggregate(
                _pivot(acc["open"], doc, seed),
                F.struct(F.lit(None).cast(entry).alias("open"), acc["done"].alias("done")),
                lambda inner, d: F.when(_whole(d), F.struct(inner["open"].alias("open"), F.concat(inner["done"], F.array(d)).alias("done"))).otherwise(F.struct(d.alias("open"), inner["done"].alias("done"))),
            )
        )

    return F.aggregate(docs, start, step)


def mix(docs: DataFrame, cap: float = 3.0, seed: int = 7, leaf: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, copies, source."""
    entry = ENTRY.format(docs.schema["doc_id"].dataType.simpleString())
    sizes = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = durable(source_targets(sizes, cap)).withColumnRenamed("source", "_source")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of_source = ["source", "source_size", "target", "rate"]
    # Equal rows are counted where they are, and numbered after they are dealt out in chunks.
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {CHUNK}"))))
    first = F.col("chunk") * CHUNK
    numbered = alike.repartition("doc_id", "size", "chunk").withColumn("number", F.explode(F.sequence(first, F.least(F.col("times"), first + CHUNK) - 1)))
    rated = numbered.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", rate).withColumn("key", F.xxhash64("doc_id", "size", "number"))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(leaf)))).cast("long")
    entries = rated.select(
        *of_source,
        F.pmod(F.xxhash64(F.lit(seed), "key"), leaves).alias("node"),
        F.struct("key", "doc_id", "size", ((F.col("rate") - F.floor("rate")) * F.col("size")).alias("mass")).alias("entry"),
    )

    # Large documents first: what a node leaves open, and a source misses at last, is then a small one.
    large_first = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("entry.size")).alias("order"), "entry"))), lambda d: d["entry"])

    def fold(entries: DataFrame) -> DataFrame:
        nodes = entries.groupBy("source", "node").agg(*[F.first(c).alias(c) for c in of_source[1:]], large_first.alias("entries"))
        return durable(nodes.select(*of_source, "node", _fold(F.reverse(_pooled(F.col("entries"), seed)), entry, seed).alias("fold")))

    level, parts, nodes = fold(entries), [], max(1, -(-most // leaf))
    parts.append(level.select(*of_source, F.explode("fold.done").alias("d")))
    while nodes > 1:  # as many rounds as the tree over the largest source is high
        nodes = -(-nodes // fan_in)
        above = level.filter("fold.open is not null").select(*of_source, F.floor(F.col("node") / fan_in).cast("long").alias("node"), F.col("fold.open").alias("entry"))
        level = fold(above)
        parts.append(level.select(*of_source, F.explode("fold.done").alias("d")))
    # one document of each source may still be fractional: drawn by itself
    last = level.filter("fold.open is not null").select(*of_source, F.col("fold.open").alias("d"))
    drawn = F.when(_unit(F.lit(seed), F.lit("last"), "d.key") < F.col("d.mass") / F.col("d.size"), F.col("d.size").cast("double")).otherwise(F.lit(0.0))
    parts.append(last.withColumn("d", F.struct("d.key", "d.doc_id", "d.size", drawn.alias("mass"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    extra = F.when((F.col("d.size") > 0) & (F.col("d.mass") >= F.col("d.size").cast("double")), F.lit(1)).otherwise(F.lit(0))
    copies = F.floor("rate") + extra
    return out.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.size").alias("size"), "source_size", "target",
        (copies * F.col("d.size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "source",
    )
