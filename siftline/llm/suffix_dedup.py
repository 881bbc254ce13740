"""Substring dedup with a run-compressed index: remove every byte that a repeated 400-byte string covers.

Two equal strings of ``LENGTH`` bytes have the same leftmost smallest k-gram hash (their anchor) at the same place. So
all occurrences of an anchor are laid above each other, aligned at the anchor, each with the bytes around it that a
string with this anchor can reach: the rows of a table. Of these rows a Burrows-Wheeler transform by columns
(positional BWT, Durbin 2014) is built from left to right: in each column the rows are ordered by what stands before
it, read backwards, and each row knows where its match with the row above begins. The column's symbols in that order
form runs; where a set of matching rows is a single run nothing changes, and only at the ends of runs are the order and
the beginnings of matches made anew. The matching statistics of each row (its longest match with any other row that
ends here, which is one with a neighbour) are read off column by column, and matches of at least ``LENGTH`` are marked.

Rows that are equal are collapsed to one with a count before any text moves: a run of equal rows is
repeated in its whole width. Anchors with one occurrence have no partner and move no text.

An anchor with more than ``HOT_ROWS`` different rows (a passage in ever different surroundings) is no group of one task. Its rows are marked by
counting: the strings of a row come in runs of ``STEP``; rows that share a run's whole extent share all its strings, rows that
do not share its core share none, and only in between are strings counted one by one. All counts are aggregations.

Bytes are compared, not hashes; only the equality of whole rows, and of the strings of hot anchors, rests on 128 bits of hash. Shorter texts
than ``LENGTH`` lose nothing.

Defined cases: a null text is empty. Rows that repeat are occurrences like any others, so texts of ``LENGTH`` bytes or more that occur
twice are removed whole, in both rows. Matches never cross documents. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, packed, unpacked
from .durable import durable, fields
from .memory import trim, trimmed
from .textnum import _TABLE, _power, mix64

LENGTH = 400
GRAM = 16
#: Window starts that are searched for anchors in one go.
PIECE = 1 << 17
#: Bytes of input (as stored) for one bucket of anchors.
BUCKET_BYTES = 1 << 20
#: Rows of the table for which the transform is built at a time, as far as single anchors allow.
ROWS = 4096
PAD = 0xFF  # no byte of UTF-8
#: Different rows of an anchor that one task marks (51 MB of bytes, and 94 MB beside them while they are marked); an anchor with more is split,
#: which needs more disk: some 1.5 kB a row.
HOT_ROWS = 1 << 16
#: Strings of a row, by their first bytes, that are looked at together where an anchor is split.
STEP = 16


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h = np.zeros(len(raw) - GRAM + 1, np.uint64)
    values = _TABLE[raw]
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + values[j : len(raw) - GRAM + 1 + j]
    return mix64(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: from running minima to both sides of cuts that are w apart."""
    n, m = len(x), -(-len(x) // w) * w
    y = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    cut = y.reshape(-1, w)
    right = np.minimum.accumulate(cut, axis=1).ravel()
    left = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, hash of the row) of the anchors of all ``length``-byte strings of a text."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    w = length - GRAM + 1
    places, hashes, rows = [], [], []
    for at in range(0, len(raw) - length + 1, PIECE):
        base = max(0, at - length)  # with what the rows of this piece's anchors can reach
        part = raw[base : at + PIECE + 2 * length]
        grams = _gram_hashes(raw[at : min(len(raw), at + PIECE - 1 + length)])
        low = np.uint64((1 << 20) - 1)
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        p = np.unique(_sliding_min(key, w) & low).astype(np.int64)
        up, down = _power(max(len(part) + 1, PIECE))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=total[1:])
        lo, hi = np.maximum(at + p - (w - 1), 0), np.minimum(at + p + length, len(raw))
        sums = (total[hi - base] - total[lo - base]) * down[lo - base]
        places.append(at + p)
        hashes.append(grams[p])
        rows.append(mix64(mix64(sums) + (at + p - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)))
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first], np.concatenate(rows)[first]


FOUND = fields("block long, doc int, place long, size long, anchor long, row long")
SHIPPED = T.StructType([*fields("bucket int, anchor long, block long, doc int, place long, left int, own boolean, hot boolean").fields, T.StructField("bytes", T.BinaryType())])
MARKS = fields("block long, doc int, start long, stop long")


def _find(length: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(frames):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, text in enumerate(texts):
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                place, h, row = anchors(raw, length)
                for x, y in zip(out, (np.full(len(place), k, np.int32), place, np.full(len(place), len(raw)), h.view(np.int64), row.view(np.int64)), strict=True):
                    x.append(y)
            columns = [np.concatenate(x) for x in out]
            for k in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0][k : k + 200_000]), block)), *(pa.array(c[k : k + 200_000]) for c in columns)], names=FOUND.names)
            trim()

    return run


def long_matches(table: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings of ``length`` columns of the rows of a table occur in another row of the same group, in the same columns.

    ``table`` has 2 * length - GRAM columns; the anchor begins in column length - GRAM. The result has, for each row, one
    flag per string, by its first column.
    """
    n, width = table.shape
    if n < 2:
        return np.zeros((n, width - length + 1), bool)
    apart, limit = width + 1, length - GRAM  # a match that begins after `limit` lacks the anchor and cannot become long enough
    keys = np.empty((n, length + 8), np.uint8)
    keys[:, :8] = groups.astype(">u8").view(np.uint8).reshape(n, 8)
    back = keys[:, 8:]  # the columns up to the anchor's end, backwards; no zero but for padding
    np.add(table[:, length - 1 :: -1], np.uint8(1), out=back)
    order = np.argsort(keys.view(f"S{length + 8}").ravel(), kind="stable")
    common = np.empty(n - 1, np.int64)
    for at in range(0, n - 1, ROWS):
        differ = back[order[at : min(at + ROWS, n - 1)]] != back[order[at + 1 : at + 1 + ROWS]]
        common[at : at + ROWS] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    del keys, back  # as large as the flags
    flags = np.zeros((n, width - length + 1), bool)
    begin = np.full(n, apart, np.int32)
    begin[1:] = np.where(groups[order[1:]] == groups[order[:-1]], length - common, apart)
    begin[begin > limit] = apart
    for column in range(length, width + 1):
        with_above = begin <= column - length
        long = with_above.copy()
        long[:-1] |= with_above[1:]
        flags[order[long], column - length] = True
        if column == width:
            break
        if column % 8 == 0:  # rows that match no other one any more leave
            alive = begin <= limit
            alive[:-1] |= begin[1:] <= limit
            order, begin = order[alive], begin[alive]
        if len(order) < 2:
            break
        symbol = table[order, column]
        run_end = (symbol[1:] != symbol[:-1]) & (begin[1:] <= limit)
        if not run_end.any():
            continue
        sets = np.cumsum(begin > limit)  # sets of matching rows
        sets -= sets[0]
        broken = np.zeros(sets[-1] + 1, bool)
        broken[sets[1:][run_end]] = True
        where = np.flatnonzero(broken[sets])
        place = sets[where] * 256 + symbol[where]
        to = np.argsort(place, kind="stable")
        old, key = where[to], place[to]
        new = np.full(len(old), apart, np.int32)
        stay = np.flatnonzero(key[1:] == key[:-1]) + 1
        i, j = old[stay - 1], old[stay]
        new[stay] = begin[j]
        far = np.flatnonzero(j > i + 1)
        if len(far):  # rows of other symbols stood between: the match begins where the latest of those between begins
            ends = np.stack([i[far] + 1, j[far] + 1], axis=1).ravel()
            padded = np.append(begin, 0)
            new[stay[far]] = np.maximum.reduceat(padded, ends)[::2]
        order[where], begin[where] = order[old], new
    return flags


def _mark(length: int):
    """Of one bucket of anchors: the ranges of bytes that long matches cover. Whole anchors go together, a few thousand rows at a time."""
    width, origin = 2 * length - GRAM, length - GRAM

    def covered(data: list[np.ndarray], chunk: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, own: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first column, column after the last) of the covered ranges of some rows."""
        first = origin - left
        table = np.full((len(begin), width), PAD, np.uint8)
        for k, (i, x, n, c) in enumerate(zip(chunk.tolist(), begin.tolist(), size.tolist(), first.tolist(), strict=True)):
            table[k, c : c + n] = data[i][x : x + n]
        all_flags = long_matches(table, anchor.view(np.uint64), length)
        start = np.arange(all_flags.shape[1], dtype=np.int32)
        parts = []
        for at in range(0, len(begin), ROWS):
            some = slice(at, at + ROWS)
            flags = all_flags[some] & own[some, None]
            flags &= start >= first[some, None]
            flags &= start + length <= (first + size)[some, None]
            edge = np.zeros((len(flags), 1), bool)
            r, a = np.nonzero(flags & ~np.concatenate([edge, flags[:, :-1]], axis=1))
            _, b = np.nonzero(flags & ~np.concatenate([flags[:, 1:], edge], axis=1))
            parts.append((r + at, a, b + length))
        r, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        return r, a, b

    def run(rows: pa.Table) -> pa.Table:
        chunks = [x for x in rows["bytes"].chunks if len(x)]  # as they are: joined, the bytes would be held once more
        ends = [np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4).astype(np.int64) for x in chunks]
        data = [np.frombuffer(x.buffers()[2], np.uint8) for x in chunks]
        chunk = np.repeat(np.arange(len(chunks)), [len(x) for x in chunks])
        begin, size = np.concatenate([x[:-1] for x in ends]), np.concatenate([np.diff(x) for x in ends])
        column = {c: rows[c].to_numpy() for c in ("anchor", "block", "doc", "place", "left", "own")}
        order = np.argsort(column["anchor"], kind="stable")
        anchor = column["anchor"][order]
        ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        parts, at = [], 0
        while at < len(order):
            to = int(ends[min(np.searchsorted(ends, at + ROWS), len(ends) - 1)])
            part = order[at:to]
            r, a, b = covered(data, chunk[part], begin[part], size[part], column["left"][part].astype(np.int64), column["own"][part].astype(bool), anchor[at:to])
            hit = part[r]
            parts.append((column["block"][hit], column["doc"][hit], column["place"][hit] - origin + a, column["place"][hit] - origin + b))
            at = to
        out = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.table({"block": pa.array(out[0], pa.int64()), "doc": pa.array(out[1], pa.int32()), "start": pa.array(out[2], pa.int64()), "stop": pa.array(out[3], pa.int64())})

    return run


def bucket_of(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The bucket (of 2 ** ``bits``) of each anchor. Anchors are the smallest of many hashes, so their own first bits are nearly always zeros; they are hashed again."""
    return (mix64(anchor.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)


def _ship(length: int, bits: int):
    """Of one block: the rows (bytes around an anchor) that are wanted, under the bucket of their anchor."""

    def run(key: tuple, texts: pa.Table, rows: pa.Table) -> pa.Table:
        data: list[bytes] = []
        if len(rows):
            rows = rows.sort_by("doc")
            own, doc, raw = unpacked(texts["payload"][0].as_py())["text"], -1, b""
            for d, place in zip(rows["doc"].to_numpy().tolist(), rows["place"].to_numpy().tolist(), strict=True):
                if d != doc:
                    doc, raw = d, (own[d].as_py() or "").encode("utf-8", "surrogatepass")
                data.append(raw[max(0, place - (length - GRAM)) : place + length])
        anchor, place = rows["anchor"].to_numpy(), rows["place"].to_numpy()
        columns = {
            "bucket": pa.array(bucket_of(anchor, bits)), "anchor": rows["anchor"], "block": rows["block"], "doc": rows["doc"], "place": rows["place"],
            "left": pa.array(np.minimum(place, length - GRAM).astype(np.int32)), "own": rows["own"], "hot": rows["hot"], "bytes": pa.array(data, pa.binary()),
        }
        del data
        trim()
        return pa.table(columns)

    return run


ROW = ["anchor", "block", "doc", "place"]
ROW_FIELDS = "anchor long, block long, doc int, place long, own boolean"
RUNS = T.StructType([*fields(ROW_FIELDS + ", run int").fields, T.StructField("core", T.BinaryType()), T.StructField("extent", T.BinaryType())])
STRINGS = T.StructType([*fields(ROW_FIELDS + ", column int").fields, T.StructField("string", T.BinaryType())])


def _digest(data: memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cut_rows(length: int, single: bool):
    """Of rows of hot anchors: the core and the extent of each run of strings, or with ``single`` each string of the wanted runs."""
    origin, last = length - GRAM, length - GRAM  # the last string begins where the anchor does

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (STRINGS if single else RUNS).names
        for frame in frames:
            out: list[tuple] = []
            for r in frame.to_pylist():
                data, first = memoryview(r["bytes"]), origin - r["left"]  # data[0] is in column `first`
                ident = (r["anchor"], r["block"], r["doc"], r["place"], r["own"])
                for k in sorted(r["runs"]) if single else range(last // STEP + 1):
                    a, b = k * STEP, min(k * STEP + STEP - 1, last)
                    lo, hi = max(a, first), min(b, first + len(data) - length)  # strings that the text has
                    if lo > hi:
                        continue
                    if single:
                        out += [(*ident, c, _digest(data[c - first : c - first + length])) for c in range(lo, hi + 1)]
                    else:
                        out.append((*ident, k, _digest(data[b - first : a + length - first]), _digest(data[a - first : b + length - first]) if (lo, hi) == (a, b) else None))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)
            trim()

    return run


def _marks_of_hot(rows: DataFrame, length: int) -> DataFrame:
    """MARKS of the rows (bytes around an anchor) of hot anchors, by counting."""
    begin = F.col("place") - (length - GRAM)
    runs = durable(rows.mapInArrow(_cut_rows(length, False), RUNS))
    same = runs.filter("extent is not null").groupBy("anchor", "run", "extent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = durable(runs.join(same, ["anchor", "run", "extent"], "left").select(*ROW, "own", "run", "core", F.col("n").isNotNull().alias("whole")))
    first = F.col("run") * STEP
    whole = seen.filter("own and whole").select("block", "doc", (begin + first).alias("start"), (begin + F.least(first + STEP - 1, F.lit(length - GRAM)) + length).alias("stop"))
    parted = seen.groupBy("anchor", "run", "core").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") & ~F.col("whole")).alias("open")).filter("n > 1 and open > 0")
    wanted = seen.join(parted, ["anchor", "run", "core"]).groupBy(*ROW).agg(F.collect_list("run").alias("runs"))  # a row has few runs
    strings = durable(rows.join(wanted, ROW).select(*ROW, "own", "left", "bytes", "runs").mapInArrow(_cut_rows(length, True), STRINGS))
    shared = strings.groupBy("anchor", "column", "string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    single = strings.filter("own").join(shared, ["anchor", "column", "string"]).select("block", "doc", (begin + F.col("column")).alias("start"), (begin + F.col("column") + length).alias("stop"))
    return whole.unionByName(single)


def _remove(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
    doc, start, stop = (marks[c].to_numpy() for c in ("doc", "start", "stop"))
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    parts = []
    for payload in texts["payload"].to_pylist():
        own = unpacked(payload)
        edge = np.searchsorted(doc, np.arange(len(own) + 1))
        out: list[tuple] = []
        for k, text in enumerate(own["text"].to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            a, b = start[edge[k] : edge[k + 1]], stop[edge[k] : edge[k + 1]]
            kept, at, spans = [], 0, []
            if len(a):
                reach = np.maximum.accumulate(b)
                head = np.concatenate([[True], a[1:] > reach[:-1]])
                spans = list(zip(a[head].tolist(), reach[np.append(np.flatnonzero(head)[1:] - 1, len(a) - 1)].tolist(), strict=True))
            for x, y in spans:
                kept.append(data[at:x])
                at = y
            left = b"".join([*kept, data[at:]]) if spans else data
            out.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if spans else text or ""))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        parts.append(pa.table({"doc_id": own["doc_id"], **{n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)}}))
    trim()
    if not parts:
        raise RuntimeError("marks of a block whose texts are not there")
    return pa.concat_tables(parts)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), kept (their text, without characters that lost some of their bytes)."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = max(5, min(20, (stored // BUCKET_BYTES).bit_length()))
    narrow = docs.select("doc_id", "text")
    found = durable(narrow.mapInArrow(_find(length), FOUND))
    # Equal rows with their count, and how many different rows an anchor has; written, with keys made anew, so that hot ones can be split.
    rows = durable(found.groupBy("anchor", "row").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("block", "doc", "place")).alias("one")))
    several = durable(rows.groupBy("anchor").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1"))
    several = several.select((F.col("anchor") + 0).alias("anchor"), "kinds")
    known = durable(rows.join(several, "anchor").select((F.col("anchor") + 0).alias("anchor"), (F.col("row") + 0).alias("row"), "times", "one", "kinds"))
    repeated = found.join(known.filter("times > 1").select((F.col("anchor") + 0).alias("anchor"), (F.col("row") + 0).alias("row")), ["anchor", "row"])
    reach = length - GRAM
    whole = repeated.select("block", "doc", F.greatest(F.lit(0), F.col("place") - reach).alias("start"), F.least(F.col("size"), F.col("place") + length).alias("stop")).filter(F.col("stop") - F.col("start") >= length)
    wanted = known.filter("kinds > 1").select(F.col("one.block").alias("block"), F.col("one.doc").alias("doc"), F.col("one.place").alias("place"), "anchor", (F.col("times") == 1).alias("own"), (F.col("kinds") > HOT_ROWS).alias("hot"))
    texts = packed(narrow)
    ship = lambda rows: texts.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_ship(length, bits), SHIPPED)
    marks = whole.select("block", "doc", "start", "stop").unionByName(ship(wanted.filter("not hot")).groupBy("bucket").applyInArrow(trimmed(_mark(length)), MARKS))
    if not several.filter(F.col("kinds") > HOT_ROWS).isEmpty():
        marks = marks.unionByName(_marks_of_hot(durable(ship(wanted.filter("hot"))), length))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *fields("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string").fields])
    return texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_remove, schema)
