"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

The incidence matrix has a row per document and a column per word shingle (a 64-bit hash). It is cut
into blocks of rows (the documents of about ``BLOCK_BYTES`` of text) and ranges of columns, and moves in packed
arrays, sorted and delta coded, one per row block and column range.

1. Each column range counts its columns. A column with one document cannot contribute to a product; the
   others go back to the row blocks with their counts. Columns that are frequent within a row
   block send only a count to the column range, so a shingle that a third of all documents have is
   one number per row block, never a list in one task.
2. Size-derived bounds: a pair with similarity t shares at least t times the size of either set. So
   a document with fewer shared columns than that has no partner, and any pair has in common one of the
   n - ceil(t n) + 1 rarest columns of both. Only those columns are multiplied, and only pairs whose sizes
   and shared columns allow the similarity are kept.
3. The kept cells of the product are summed exactly, from the packed rows of both documents.

Cells between documents that are already connected are not needed for components: first every document of a
column is paired with the column's first one, and only pairs that the links found so connect in no way are
multiplied out afterwards. Documents with equal sets are one class, of which one representative takes part. No link
between different sets that could join two components is lost.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing (also not with
each other); texts of one to four words have one shingle, the whole sequence. Rows that repeat, also
with one ``doc_id``, are separate documents of one class. ``doc_id`` must be an integer. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .durable import durable, fields, release
from .memory import trim, trimmed
from .textnum import Words, batches, mix64

N = 5
#: Similarity in hundredths.
LEAST = 75
BLOCK_BYTES = 3 << 20
#: Documents of a row block at most: they are numbered by 16 bits.
BLOCK_DOCS = 1 << 16
#: Bits of a shingle's hash that name its column; the sizes and the equality of sets rest on 64 and 128 bits. Two shingles in one
#: column can only loosen the bounds, which loses no link; that a pair's overlap is counted one too high takes two that
#: collide in just these two documents (n * m / 2 ** 48).
BITS = 48
#: A column is frequent within a row block from this share of its documents, and this number.
FREQUENT_SHARE, FREQUENT_DOCS = 0.125, 32
#: Bytes of input (as stored) for a column range.
RANGE_BYTES = 2 << 20

_FACTORS = np.random.default_rng(20240502).integers(0, 1 << 63, N + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, with their lengths in bytes; sorted 64-bit ones go as ``deltas``."""
    return b"".join([np.array([x.nbytes for x in arrays], np.int64).tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(data, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """Byte planes of the differences of sorted numbers: the upper planes are nearly all zero."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T


def undeltas(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text of a batch, sorted by hash, then text."""
    words = Words(raw)
    begin = np.searchsorted(words.start, offsets)
    count = np.diff(begin)
    h = words.hash
    if len(h) >= n:
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * _FACTORS[k]
        doc = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
        first = np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0)
        at = np.arange(len(doc)) - first[doc] + begin[doc]
        hashes = mix64(total[at])
    else:
        doc, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = count[short].astype(np.uint64) * _FACTORS[n]
        for k in range(n - 1):
            has = count[short] > k
            whole[has] += h[begin[short[has]] + k] * _FACTORS[k]
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, mix64(whole)])
        by_doc = np.argsort(doc, kind="stable")
        doc, hashes = doc[by_doc], hashes[by_doc]
    order = np.argsort(hashes, kind="stable")
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def _prints(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of shingles, and 128 bits that depend on the set only."""
    order = np.argsort(doc, kind="stable")
    size = np.bincount(doc, minlength=n_docs)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (0x51ED270B, 0xC2B2AE3D):
        total = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(mix64(hashes[order] ^ np.uint64(salt)), out=total[1:])
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return size, out[0], out[1]


COLUMNS = T.StructType([T.StructField("key", T.LongType()), T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType())])
COUNTED = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("payload", T.BinaryType())])
ROWS = T.StructType([*fields("rid long, doc_id long, n long, f1 long, f2 long, k int, s int").fields, T.StructField("shared", T.BinaryType())])


def _blocks(n: int, bits: int):
    """Cut texts into row blocks, and their incidence into column ranges."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        for frame in (f.slice(at, BLOCK_DOCS) for f in frames for at in range(0, len(f), BLOCK_DOCS)):
            ids, texts = frame.column(0), frame.column(1).to_pylist()
            for first, raw, offsets in batches(texts, BLOCK_BYTES):
                n_docs = len(offsets) - 1
                hashes, doc = shingles(raw, offsets, n)
                size, f1, f2 = _prints(hashes, doc, n_docs)
                hashes = hashes >> np.uint64(64 - BITS)
                start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
                times = np.diff(np.append(start, len(hashes)))
                often = times > max(FREQUENT_DOCS, FREQUENT_SHARE * n_docs)
                hot = np.repeat(often, times)
                own = ids.slice(first, n_docs)
                known = np.array(own.is_valid())
                meta = pack(np.array(own.fill_null(0)).astype(np.int64), known.astype(np.uint8), size.astype(np.int64), f1, f2, hashes[hot], doc[hot].astype(np.uint16))
                keys, payloads = [-serial - 1], [meta]
                cold, cold_doc, hot_hash, hot_times = hashes[~hot], doc[~hot].astype(np.uint16), hashes[start[often]], times[often].astype(np.int64)
                edges = (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(BITS - bits)
                a = np.concatenate([[0], np.searchsorted(cold, edges), [len(cold)]])
                b = np.concatenate([[0], np.searchsorted(hot_hash, edges), [len(hot_hash)]])
                for r in np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1])):
                    x, y = slice(a[r], a[r + 1]), slice(b[r], b[r + 1])
                    keys.append(int(r))
                    payloads.append(pack(deltas(cold[x]), cold_doc[x], hot_hash[y], hot_times[y]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([serial] * len(keys), pa.int64()), pa.array(payloads, pa.binary())], names=["key", "block", "payload"])
                serial += 1
        trim()

    return run


def _magnitude(df: np.ndarray) -> np.ndarray:
    """Counts by eighths of a doubling, in one byte: only the order from rare to frequent matters, and 1 stays 1."""
    return np.where(df > 1, np.minimum(1 + np.floor(8 * np.log2(np.maximum(df, 1))), 255), 1).astype(np.uint8)


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one column range: for each row block the columns that more than one document has."""
    if rows["key"].iloc[0] < 0:
        return pd.DataFrame({"block": rows["block"], "kind": np.int32(0), "payload": rows["payload"]})
    parts = [unpack(p, np.uint8, np.uint16, np.uint64, np.int64) for p in rows["payload"]]
    cold = [undeltas(p[0]) for p in parts]
    hashes = np.concatenate([*cold, *(p[2] for p in parts)])
    times = np.concatenate([*(np.ones(len(c), np.int64) for c in cold), *(p[3] for p in parts)])
    order = np.argsort(hashes)
    ordered = hashes[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order], start) if len(start) else np.zeros(0, np.int64)
    df = np.empty(len(hashes), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(start, len(ordered))))
    df = _magnitude(df)
    blocks, payloads, at, hot_at = [], [], 0, sum(map(len, cold))
    for block, c, part in zip(rows["block"], cold, parts, strict=True):
        d, e = df[at : at + len(c)], df[hot_at : hot_at + len(part[2])]
        at, hot_at = at + len(c), hot_at + len(part[2])
        more = d > 1
        if more.any() or len(e):
            blocks.append(block)
            payloads.append(pack(deltas(c[more]), part[1][more], d[more], part[2], e))
    return pd.DataFrame({"block": np.array(blocks, np.int64), "kind": np.int32(1), "payload": payloads})


def _rows(least: int):
    """Of one row block: its documents, with their shared columns from rare to frequent where a partner is possible."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        ids, known, n, f1, f2, hot, hot_doc = unpack(rows["payload"][rows["kind"] == 0].iloc[0], np.int64, np.uint8, np.int64, np.int64, np.int64, np.uint64, np.uint16)
        hashes, docs, dfs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
        for p in rows["payload"][rows["kind"] == 1]:
            planes, doc, df, hot_hash, hot_df = unpack(p, np.uint8, np.uint16, np.uint8, np.uint64, np.uint8)
            hashes.append(undeltas(planes))
            docs.append(doc)
            dfs.append(df)
            if len(hot_hash):
                a, b = np.searchsorted(hot, hot_hash), np.searchsorted(hot, hot_hash, side="right")
                hashes.append(np.repeat(hot_hash, b - a))
                dfs.append(np.repeat(hot_df, b - a))
                docs.append(np.concatenate([hot_doc[x:y] for x, y in zip(a, b, strict=True)]))
        hashes, docs, dfs = np.concatenate(hashes), np.concatenate(docs).astype(np.int64), np.concatenate(dfs)
        order = np.lexsort((hashes, dfs, docs))
        hashes = hashes[order]
        s = np.bincount(docs, minlength=len(n))
        ends = np.concatenate([[0], np.cumsum(s)])
        need = -(-least * n // 100)
        k = np.where((n > 0) & (s >= need), (n - need + 1) - (n - s), 0)
        seen: set[tuple[int, int, int]] = set()
        shared: list[bytes | None] = []
        for j in range(len(n)):
            cls = (int(n[j]), int(f1[j]), int(f2[j]))
            shared.append(hashes[ends[j] : ends[j + 1]].tobytes() if k[j] > 0 and cls not in seen else None)
            seen.add(cls)
        return pd.DataFrame({"rid": (block << 16) + np.arange(len(n)), "doc_id": pd.array(ids, "Int64").copy() if known.all() else pd.array([int(i) if v else None for i, v in zip(ids, known, strict=True)], "Int64"), "n": n, "f1": f1, "f2": f2, "k": k.astype(np.int32), "s": s.astype(np.int32), "shared": shared})

    return run


@F.pandas_udf(T.ArrayType(T.LongType()))
def _prefix(shared: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, np.int64, int(m)) for x, m in zip(shared, k, strict=True)])


@F.pandas_udf(T.LongType())
def _overlap(x: pd.Series, y: pd.Series) -> pd.Series:
    """Cells of the product: columns that both rows have."""
    trim()
    return pd.Series([len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype="int64")


def incidence(docs: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """One row per document: rid, doc_id, n, (f1, f2) of its set, k rarest columns to multiply, s shared columns, and those (packed)."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = max(6, min(20, (stored // RANGE_BYTES).bit_length()))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(n, bits), COLUMNS)
    counted = cut.groupBy("key").applyInPandas(trimmed(_count), COUNTED)
    return durable(counted.groupBy("block").applyInPandas(trimmed(_rows(least)), ROWS))


def _possible(a: str, b: str, least: int):
    """Bounds on a pair from sizes (n) and numbers of shared columns that are left (r)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= least * F.greatest(n, m)) & ((100 + least) * F.least(F.col(f"{a}.r"), F.col(f"{b}.r")) >= least * (n + m))


def _links(pairs: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the similarity."""
    one = rows.select(F.col("rid").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x"))
    two = rows.select(F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y"))
    cells = pairs.join(one, "a").join(two, "b").withColumn("both", _overlap("x", "y"))
    return durable(cells.filter(100 * F.col("both") >= least * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))


def _cells(able: DataFrame, classes: DataFrame) -> DataFrame:
    """The rarest columns of each class's representative, one row for each.

    A cell knows how many of its row's shared columns are left from here on: r bounds the overlap of two rows whose first common column it is.
    """
    # Spark would filter on the size of the columns before it explodes them, and make them a second time for that, in a second worker for each task.
    columns = _prefix.asNondeterministic()("shared", "k")
    prefix = able.select("rid", "n", "s", columns.alias("columns")).join(classes.select(F.col("rep").alias("rid")), "rid")
    return prefix.select("rid", "n", "s", F.posexplode("columns").alias("at", "column")).select("column", "rid", "n", (F.col("s") - F.col("at")).alias("r"), ((F.col("n") - F.col("s")) / F.col("n")).alias("own"))


def ngram_components(docs: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    rows = incidence(docs, n, least)
    release(docs.sparkSession)  # the shuffles of the incidence are not needed any more
    # Classes of equal sets. Keys are made anew after writing, so that later joins exchange both sides and hot classes can be split.
    classes = durable(rows.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("first_doc")))
    classes = classes.select((F.col("n") + 0).alias("n"), (F.col("f1") + 0).alias("f1"), (F.col("f2") + 0).alias("f2"), "rep", "first_doc")
    able = rows.filter("shared is not null")
    cells = durable(_cells(able, classes))

    # First with the column's most typical document only: the one with the least share of columns of its own.
    heads = durable(cells.groupBy("column").agg(F.min(F.struct("own", "rid", "n", "r")).alias("p"), F.count(F.lit(1)).alias("docs")).filter("docs > 1"))
    heads = heads.select((F.col("column") + 0).alias("column"), "p")
    c = cells.select("column", F.struct("rid", "n", "r").alias("q"))
    first = c.join(heads, "column").filter("q.rid <> p.rid").filter(_possible("p", "q", least)).select(F.col("p.rid").alias("a"), F.col("q.rid").alias("b")).distinct()
    links = _links(first, able, least)
    found = durable(components(links))

    # Then all pairs of a column that are not connected yet.
    placed = cells.join(found.select(F.col("id").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    placed = durable(placed)
    mixed = durable(placed.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select((F.col("column") + 0).alias("column")))
    left = placed.join(mixed, "column")
    p = left.select("column", F.struct("rid", "n", "r", "component").alias("p"))
    q = left.select("column", F.struct("rid", "n", "r", "component").alias("q"))
    second = p.join(q, "column").filter("p.component < q.component").filter(_possible("p", "q", least)).select(F.col("p.rid").alias("a"), F.col("q.rid").alias("b")).distinct()
    found = components(links.unionByName(_links(second, able, least)))

    member = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    member = durable(member)
    smallest = durable(member.groupBy("component").agg(F.min("first_doc").alias("component_id"))).select((F.col("component") + 0).alias("component"), "component_id")
    named = durable(member.join(smallest, "component").select("n", "f1", "f2", "component_id"))
    named = named.select((F.col("n") + 0).alias("n"), (F.col("f1") + 0).alias("f1"), (F.col("f2") + 0).alias("f2"), "component_id")
    return rows.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
