"""SentencePiece encoding and decoding with a relational lattice.

The texts are cut where no piece can span (two neighbouring characters that are neighbours in no piece), which
gives short units; the distinct units are encoded once each:

* explode the substrings of a unit, up to the length of the longest piece,
* equi-join them to the piece table (of fixed size: it is the model),
* group the edges that match by unit,
* fold them with Spark's ``aggregate``. A unigram model is folded by Viterbi: the best score at each
  position from the edges that end there. In a BPE model the best sum of scores is not what the model means
  (its scores are ranks of merges), so its edges are folded in the order of their rank: an edge
  joins two neighbouring symbols if it covers just those.

Most of a text are a few common units. Those of a sample of the documents are encoded first, by the same lattice, and
their encodings (``COMMON_UNITS`` at most) are broadcast, so that only the rest travels: each block of documents sends
its other units to the lattice and gets their encodings back. The sample decides where a unit is looked up, never its encoding.

Blocks then put their texts together; decoding is the reverse, piece by piece. Two kinds of units leave the fold
and are encoded one at a time by the same rules: units longer than ``LONG_UNIT``, for which the fold's copies of its state would
cost a square of the length, and, in BPE models, runs of spaces, whose pieces share one score.

Defined cases: null and empty texts have no pieces. Characters without a piece become byte pieces where the model has
them, else the unknown id. U+2581 in a text is decoded as a space, as in the library. Rows that
repeat give equal results, and a null ``doc_id`` is kept. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, packed, unpacked
from .durable import fields, shuffle_width
from .memory import trim
from .textnum import mix64

SPACE = "▁"
UNIGRAM, BPE = 1, 2
LONG_UNIT = 64
#: Characters of text in one go of the cutting.
PIECE_CHARS = 1 << 18
#: Characters of text in a block: the larger, the fewer units go to and fro, and the more memory a worker needs.
BLOCK_CHARS = 5 << 20
UNKNOWN_PENALTY = 10.0
#: Partitions of units for each shuffle partition.
PARTS = 10
#: Bytes of documents (as stored) from which the common units are taken, and how many of them are broadcast at most (about 30 bytes each).
SAMPLE_BYTES = 32 << 20
COMMON_UNITS = 1 << 18
#: In a fold's result, a character that is no part of a longer piece: this plus its code point.
CHARACTER = 1 << 30


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces by id with scores; ``byte_ids`` is empty without byte fallback."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    kind: int
    byte_ids: list[int]
    unknown: int
    dummy_prefix: bool

    def __post_init__(self):
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.normal[k]}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.lowest = min((s for s, n in zip(self.scores, self.normal, strict=True) if n), default=0.0)
        chars = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.pairs = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.ids:
            k = self.classes[[ord(c) for c in p]]
            self.pairs[k[:-1], k[1:]] = True
        raw = [b" " if p == SPACE else p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(self.pieces, self.normal, strict=True)]
        for b, k in enumerate(self.byte_ids):
            raw[k] = bytes([b])
        self.raw = raw
        self.singles = np.full(0x110000, -1, np.int32)  # the one id of a character by itself
        for b, k in enumerate(self.byte_ids[:128]):
            self.singles[b] = k
        for p, k in self.ids.items():
            if len(p) == 1:
                self.singles[ord(p)] = k

    @classmethod
    def load(cls, data: bytes) -> Model:
        """A model file: pieces are field 1; model type and byte fallback are in field 2, the prefix rule in field 3."""
        pieces, scores, types, kind, fallback, dummy = [], [], [], UNIGRAM, False, True
        for number, value in _message(data):
            if number == 1:
                part = dict(_message(value))
                pieces.append(part[1].decode())
                scores.append(float(np.frombuffer(part.get(2, bytes(4)), "<f4")[0]))
                types.append(part.get(3, 1))
            elif number == 2:
                trainer = dict(_message(value))
                kind, fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(_message(value))
                dummy = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps white space is supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind}")
        byte_ids = [k for k, t in enumerate(types) if t == 6] if fallback else []
        return cls(pieces, scores, [t in (1, 4) for t in types], kind, byte_ids, types.index(2), dummy)

    def marked(self, text: str | None) -> str:
        """The text as the model sees it."""
        return (SPACE if self.dummy_prefix and text else "") + (text or "").replace(" ", SPACE)

    def text_of(self, ids: bytes) -> str:
        """The text of packed ids, piece by piece."""
        data = b"".join([self.raw[k] for k in np.frombuffer(ids, "<i4").tolist()])
        return (data[1:] if self.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")

    def without_piece(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit of any length, by the rules of the fold."""
        cuts = self._merged(unit) if self.kind == BPE else self._viterbi(unit)
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = self.ids.get(unit[a:b])
            out += [k] if k is not None else self.without_piece(unit[a:b])
        return out

    def _viterbi(self, unit: str) -> list[int]:
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(unit)
        for end in range(1, len(unit) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                k = self.ids.get(unit[start:end])
                if k is not None:
                    options.append((best[start][0] + self.scores[k], -start))
                elif start == end - 1:
                    options.append((best[start][0] + self.lowest - UNKNOWN_PENALTY, -start))
            best[end] = max(options)
        cuts = [len(unit)]
        while cuts[-1]:
            cuts.append(-best[cuts[-1]][1])
        return cuts[::-1]

    def _merged(self, unit: str) -> list[int]:
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        after.append(-1)
        alive, agenda = [True] * len(unit), []

        def offer(a: int) -> None:
            if a >= 0 and (b := after[a]) < len(unit):
                k = self.ids.get(unit[a : after[b]])
                if k is not None:
                    heapq.heappush(agenda, (-self.scores[k], a, b, after[b]))

        for a in range(len(unit)):
            offer(a)
        while agenda:
            _, a, b, end = heapq.heappop(agenda)
            if not (alive[a] and b < len(unit) and alive[b] and after[a] == b and after[b] == end):
                continue
            alive[b] = False
            after[a] = end
            if end < len(unit):
                before[end] = a
            offer(a)
            offer(before[a])
        return [a for a in range(len(unit)) if alive[a]] + [len(unit)]

    def cut(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts joined, starts of units and the end, hashes of units, first unit of each text and the end)."""
        marked = [self.marked(t) for t in texts]
        whole = "".join(marked)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(m) for m in marked])])
        kinds = self.classes.take(codes)
        begins = np.ones(len(codes) + 1, bool)
        np.logical_not(self.pairs.ravel().take(kinds[:-1] * len(self.pairs) + kinds[1:]), out=begins[1:-1])
        begins[first] = True
        starts = np.flatnonzero(begins)
        total = np.zeros(len(codes) + 1, np.uint64)
        up, down = _powers(len(codes) + 1)
        np.cumsum(_noise().take(codes) * up[: len(codes)], out=total[1:])
        upto, size = total[starts], np.diff(starts).astype(np.uint64)
        return whole, starts, mix64(np.diff(upto) * down[starts[:-1]] + size), np.searchsorted(starts, first)

    def hash_of(self, unit: str) -> int:
        """The hash that ``cut`` gives a unit."""
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
        up, _ = _powers(len(codes) + 1)
        return int(mix64(np.array([(_noise().take(codes) * up[: len(codes)]).sum(dtype=np.uint64) + np.uint64(len(codes))]))[0])

    def by_lattice(self, unit: str) -> bool:
        """Whether a unit is one for the lattice; the others are encoded where they stand."""
        return self.shortest <= len(unit) <= LONG_UNIT and not (self.kind == BPE and SPACE * 2 in unit)

    @property
    def shortest(self) -> int:
        """Characters of the shortest edge: in BPE models single characters are no merges."""
        return 2 if self.kind == BPE else 1


_cache: list[np.ndarray] = []
_characters: list[np.ndarray] = []


def _noise() -> np.ndarray:
    """A 64-bit number for each code point."""
    if not _characters:
        _characters.append(mix64(np.arange(7, 0x110000 + 7, dtype=np.uint64)))
    return _characters[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0]) < n:
        base = 0xD1342543DE82EF95
        n = max(n, PIECE_CHARS)
        _cache[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]
    return _cache[0], _cache[1]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PIECE_CHARS characters."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > PIECE_CHARS:
            yield at, k
            at, size = k, 0
        size += len(t or "") + 1
    if at < len(texts):
        yield at, len(texts)


class Common:
    """Encodings that every worker has: row k has ``ids[starts[k] : starts[k + 1]]`` for the unit of ``hashes[k]``."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.hashes, self.starts, self.ids, self.index = hashes, starts, ids, None

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if self.index is None:
            self.index = pd.Index(self.hashes)
        return self.index.get_indexer(hashes) if len(self.hashes) else np.full(len(hashes), -1)


NO_UNITS = Common(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))


class _Cut:
    """The units of a block's texts: per part the number of each unit among the part's distinct ones, their rows in ``common``, and the texts' first units."""

    def __init__(self, model: Model, common: Common, texts: list[str | None], count: bool = False):
        self.parts, self.others, self.counts = [], {}, {}
        for a, b in _parts(texts):
            whole, starts, h, first = model.cut(texts[a:b])
            number, own = pd.factorize(h)
            row = common.rows(own)
            at = np.empty(len(own), np.int64)
            at[number[::-1]] = np.arange(len(h) - 1, -1, -1)  # where each stands first
            for k in np.flatnonzero(row < 0).tolist():
                if (x := int(own[k])) not in self.others:
                    self.others[x] = whole[starts[at[k]] : starts[at[k] + 1]]
            if count:
                for x, n in zip(own.tolist(), np.bincount(number, minlength=len(own)).tolist(), strict=True):
                    self.counts[x] = self.counts.get(x, 0) + n
            else:
                self.parts.append((number.astype(np.int32), own, row, first))

    def lattice(self, model: Model) -> list[int]:
        """Hashes of the units for the lattice, in order."""
        return sorted(x for x, unit in self.others.items() if model.by_lattice(unit))


def _clean(unit: str) -> str:
    return unit.encode("utf-8", "replace").decode()


UNITS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("unit", pa.string())])


def _units(shared, common):
    """Distinct units of each block that are not in ``common``, numbered in the order of their hashes."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(frames, BLOCK_CHARS):
            cut = _Cut(shared.value, common.value, texts)
            order = cut.lattice(shared.value)
            for k in range(0, len(order), 100_000):
                part = order[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array([_clean(cut.others[x]) for x in part], pa.string())], schema=UNITS)
            trim()

    return run


def _counted(shared):
    """Units for the lattice and how often each block has them, if more than once."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in blocks(frames, BLOCK_CHARS):
            cut = _Cut(shared.value, NO_UNITS, texts, count=True)
            found = [(cut.others[x], n) for x, n in cut.counts.items() if n > 1 and shared.value.by_lattice(cut.others[x])]
            yield pa.RecordBatch.from_arrays([pa.array([_clean(u) for u, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["unit", "n"])
            trim()

    return run


def common_units(docs: DataFrame, model: Model, sample_bytes: int = SAMPLE_BYTES, most: int = COMMON_UNITS) -> Common:
    """The encodings of the units that are most frequent in a sample of the documents; bounded by ``most``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = docs.select("doc_id", "text")
    if stored > sample_bytes:
        part = part.sample(sample_bytes / stored, seed=11)
    counts = part.mapInArrow(_counted(shared), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "unit").limit(most).select("unit").repartition(shuffle_width(spark), "unit")
    found = encoded_units(top, model).toArrow()
    lists = found["ids"].combine_chunks()
    ids, starts = _resolved(model, np.array(lists.values, np.int32), np.array(lists.offsets, np.int64))
    hashes = np.zeros(len(found), np.uint64)
    for k, unit in enumerate(found["unit"].to_pylist()):
        hashes[k] = model.hash_of(unit)
    return Common(hashes, starts, ids)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score, merge) of the model's pieces."""
    ids = np.array(list(model.ids.values()), np.int64)
    scores = np.array([model.scores[k] for k in ids.tolist()], np.float64)
    # A merge as one number, so that numbers are sorted in the order of merging: rank, start, end (7 bits each), id (25 bits).
    merge = (np.unique(-scores, return_inverse=True)[1].astype(np.int64) << 39) + ids
    # As an Arrow table the rows reach the JVM as they are; rows of pandas would go through Python workers of another pool on each executor.
    rows = pa.table({"piece": pa.array(list(model.ids), pa.string()), "id": pa.array(ids.astype(np.int32)), "score": pa.array(scores), "merge": pa.array(merge)})
    return spark.createDataFrame(rows)


def encoded_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) for distinct units: the lattice and its fold. BPE units without any edge are left out.

    ``units`` have at least ``model.shortest`` characters and should be partitioned by unit. Characters of a BPE lattice that are in no merge are ``CHARACTER`` plus their code point.
    """
    bpe = model.kind == BPE
    table = piece_table(units.sparkSession, model)
    length = F.char_length("unit")
    ends = F.sequence(F.lit(model.shortest), F.least(F.lit(model.longest), length - F.col("s")))
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), length - model.shortest)).alias("s"))
    substrings = starts.select("unit", "s", F.explode(ends).alias("n")).select("unit", "s", (F.col("s") + F.col("n")).alias("e"), F.substring(F.col("unit"), F.col("s") + 1, F.col("n")).alias("piece"))
    # The model has a fixed number of pieces, so its broadcast does not grow with the corpus.
    if bpe:
        joined = substrings.join(F.broadcast(table.select("piece", "merge")), "piece")
        edge = F.col("merge") + F.shiftleft(F.col("s").cast("long"), 32) + F.shiftleft(F.col("e").cast("long"), 25)
    else:  # a character without a piece is an edge, too
        joined = substrings.join(F.broadcast(table.select("piece", "id", "score")), "piece", "left").filter((F.col("e") == F.col("s") + 1) | F.col("id").isNotNull())
        edge = F.struct("e", "s", F.coalesce("score", F.lit(model.lowest - UNKNOWN_PENALTY)).alias("score"), "id")
    lattices = joined.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    if bpe:
        return lattices.select("unit", merge_fold(F.col("edges"), F.col("unit")).alias("ids"))
    cuts = lattices.withColumn("cuts", viterbi_fold(F.col("edges"), length))
    code = lambda at: F.ascii(F.substring(F.col("unit"), at + 1, F.lit(1))) + CHARACTER
    span = lambda k: F.get(F.filter("edges", lambda x: (x["s"] == F.get("cuts", k)) & (x["e"] == F.get("cuts", k + 1))), F.lit(0))["id"]
    ids = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.coalesce(span(k), code(F.get("cuts", k))))
    return cuts.select("unit", ids.cast("array<int>").alias("ids"))


def viterbi_fold(edges: Column, length: Column) -> Column:
    """Cuts of the best path. ``edges`` (e, s, score, id); ties go to the earlier start, as in the library."""
    node = "struct<score:double,start:int>"
    best = F.aggregate(
        F.sequence(F.lit(1), length),
        F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")).cast(node)),
        lambda nodes, p: F.concat(nodes, F.array(F.array_max(F.transform(
            F.filter(edges, lambda x: x["e"] == p),
            lambda x: F.struct((F.get(nodes, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).cast("int").alias("start")),
        )).cast(node))),
    )
    walk = lambda nodes: F.aggregate(F.sequence(F.lit(1), length), F.array(length.cast("int")), lambda cuts, _: F.when(F.get(cuts, F.lit(0)) > 0, F.concat(F.array(-F.get(nodes, F.get(cuts, F.lit(0)))["start"]), cuts)).otherwise(cuts))
    return F.transform(F.array(best), walk)[0]


def merge_fold(edges: Column, unit: Column) -> Column:
    """Ids after all merges. ``edges`` are numbers (rank, start, end, id), sorted.

    The state has an entry for each character: the end of the symbol that begins there (0 if none does) above 32 bits of its id.
    """
    end = lambda symbol: F.shiftright(symbol, 32)
    field = lambda x, at, bits: F.shiftright(x, at).bitwiseAND(F.lit((1 << bits) - 1))

    def step(symbols: Column, x: Column) -> Column:
        start, stop = field(x, 32, 7).cast("int"), field(x, 25, 7)
        middle = end(F.get(symbols, start)).cast("int")
        joined = F.shiftleft(stop, 32) + x.bitwiseAND(F.lit((1 << 25) - 1))
        merged = F.transform(symbols, lambda symbol, k: F.when(k == start, joined).when(k == middle, F.lit(0).cast("long")).otherwise(symbol))
        return F.when((middle > 0) & (end(F.get(symbols, middle)) == stop), merged).otherwise(symbols)

    characters = F.transform(
        F.sequence(F.lit(1), F.char_length(unit)),
        lambda k: F.shiftleft(k.cast("long"), 32) + F.ascii(F.substring(unit, k, F.lit(1))) + CHARACTER,
    )
    symbols = F.filter(F.aggregate(edges, characters, step), lambda symbol: symbol != 0)
    return F.transform(symbols, lambda symbol: symbol.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))


def _resolved(model: Model, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids with the ids of single characters, which may be several byte pieces, in place of their code points."""
    single = np.flatnonzero(ids >= CHARACTER)
    ids = ids.copy()
    points = ids[single] - CHARACTER
    ids[single] = model.singles[points]
    several = ids[single] < 0
    if not several.any():
        return ids, starts
    parts, added, last = [], np.zeros(len(ids), np.int64), 0
    for k, point in zip(single[several].tolist(), points[several].tolist(), strict=True):
        new = model.without_piece(chr(point))
        parts += [ids[last:k], np.array(new, np.int32)]
        added[k] = len(new) - 1
        last = k + 1
    grown = np.concatenate([[0], np.cumsum(added)])
    return np.concatenate([*parts, ids[last:]]), starts + grown[starts]


#: Encodings of units that are packed in one go.
PACK_ROWS = 1 << 18


def _packed_encodings(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, ids) of a partition as one compressed row for each block; null ids are empty."""

    def rows(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept).combine_chunks()
        block, place = table["block"].to_numpy(), table["place"].to_numpy().astype("<i4")
        size = pc.fill_null(pc.list_value_length(table["ids"]), 0).to_numpy().astype("<i4")
        values = pc.list_flatten(table["ids"]).to_numpy().astype("<i4")
        starts = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((place, block))
        edges = np.append(np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1)), len(order))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[a:b]
            n = size[own]
            ids = values[np.arange(n.sum()) + np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n)])[:-1], n)]
            out.append(zstandard.compress(np.int32(b - a).tobytes() + b"".join(_planes(x) for x in (np.diff(place[own], prepend=np.int32(0)), n, ids)), 3))
        return pa.RecordBatch.from_arrays([pa.array(block[order[edges[:-1]]]), pa.array(out, pa.binary())], names=["block", "encodings"])

    kept, n = [], 0
    for frame in frames:
        kept.append(frame)
        n += len(frame)
        if n >= PACK_ROWS:
            yield rows(kept)
            kept, n = [], 0
    if n:
        yield rows(kept)
    trim()


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by the rank of their bytes, which compress better so."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked_encodings(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, ids, starts of each place's ids and the end) of all rows of a block."""
    places, sizes, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for pack in packs:
        raw = np.frombuffer(zstandard.decompress(pack), np.uint8)
        n = int(raw[:4].view("<i4")[0])
        numbers = lambda at, k: np.ascontiguousarray(raw[at : at + 4 * k].reshape(4, -1).T).view("<i4").ravel()
        places.append(np.cumsum(numbers(4, n), dtype=np.int32))
        sizes.append(numbers(4 + 4 * n, n))
        values.append(numbers(4 + 8 * n, int(sizes[-1].sum())))
    return np.concatenate(places), np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


ENCODED = fields("n_bytes long, n_pieces long, ids binary, decoded string")


def encode(docs: DataFrame, model: Model, sample_bytes: int = SAMPLE_BYTES, decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_pieces, ids (32-bit little-endian numbers in one binary); with ``decoded`` also the text that ``ids`` give."""
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text")
    shared, common = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(common_units(narrow, model, sample_bytes))
    # One exchange by unit serves both the lattice and the way back: the lattice's input names all its columns, so that it stays the same
    # (and both leave out null units, of which there are none).
    # Many small partitions: edges of one are grouped in memory, without being sorted (see memory.small_batches).
    placed = narrow.mapInArrow(_units(shared, common), "block long, place int, unit string").filter("unit is not null").repartition(PARTS * shuffle_width(spark), "unit")
    units = placed.groupBy("unit").agg(F.max("place").alias("last"), F.count("block").alias("n")).filter("last >= 0 and n > 0").select("unit")
    found = placed.join(encoded_units(units, model).hint("shuffle_hash"), "unit", "left").select("block", "place", "ids")
    back = found.mapInArrow(_packed_encodings, "block long, encodings binary")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *ENCODED.fields])

    def assemble(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        parts = [_assembled(shared.value, common.value, unpacked(payload), own["encodings"].to_pylist(), decoded) for payload in texts["payload"].to_pylist()]
        trim()
        if not parts:
            raise RuntimeError("encodings of a block whose texts are not there")
        return pa.concat_tables(parts)

    done = packed(narrow, BLOCK_CHARS).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assemble, schema)
    return done if decoded else done.drop("decoded")


def _assembled(model: Model, common: Common, block: pa.Table, packs: list[bytes], decoded: bool) -> pa.Table:
    """The encodings of a block's texts; ``packs`` have those of the units that went to the lattice."""
    texts = block["text"].to_pylist()
    cut = _Cut(model, common, texts)
    order = cut.lattice(model)
    place, ids, starts = _unpacked_encodings(packs)
    if not np.array_equal(np.unique(place), np.arange(len(order))):
        raise RuntimeError("the units of a block are not those that were encoded")
    ids, starts = _resolved(model, ids, starts)
    row = np.zeros(len(order), np.int64)
    row[place] = np.arange(len(place))
    # Units without an answer: those that the lattice does not take, and those without any edge.
    alone = {x for x in cut.others if not model.by_lattice(cut.others[x])} | {order[p] for p in place[starts[1:] == starts[:-1]].tolist()}
    hashes = np.array([*order, *sorted(alone)], np.uint64)
    extra = [model.encode_unit(cut.others[x]) for x in sorted(alone)]
    base = len(common.ids)
    begin = np.concatenate([common.starts[:-1], base + starts[:-1][row], base + len(ids) + np.cumsum([0, *map(len, extra)])[:-1]]).astype(np.int64)
    size = np.concatenate([np.diff(common.starts), np.diff(starts)[row], [len(x) for x in extra]]).astype(np.int64)
    flat = np.concatenate([common.ids, ids, np.array([k for x in extra for k in x], np.int32)]).astype(np.int32)
    by_hash = np.argsort(hashes, kind="stable")
    by_hash = by_hash[np.append(hashes[by_hash][1:] != hashes[by_hash][:-1], True)] if len(by_hash) else by_hash  # a unit without edges is in both lists; its later row counts
    sorted_hashes = hashes[by_hash]
    out = []
    for number, distinct, known, first in cut.parts:
        lost = known < 0
        known = known.copy()
        known[lost] = len(common.hashes) + by_hash[np.searchsorted(sorted_hashes, distinct[lost])]
        at = known[number]
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        found = flat[np.arange(ends[-1]) + np.repeat(begin[at] - ends[:-1], n)].astype("<i4")
        edges = ends[first]
        out += [found[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({
        "doc_id": block["doc_id"], "n_bytes": pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
        "n_pieces": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary()), "decoded": pa.array([model.text_of(x) if decoded else None for x in out], pa.string()),
    })


def decode(ids: Column, model: Model, spark: SparkSession) -> Column:
    """The text of packed ids."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def decoded(column: pd.Series) -> pd.Series:
        out = column.map(shared.value.text_of)
        trim()
        return out

    return decoded(ids)
