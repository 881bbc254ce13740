"""Readers: format detection, JSON lines, JSON containers, CSV, Parquet, local dataset folders, embeddings, state."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FIELD_ALIASES, blank, content_id

SUFFIXES = {".jsonl": "jsonl", ".json": "json", ".parquet": "parquet", ".csv": "csv"}
CONTAINERS = ("data", "samples", "examples")


def detect_format(path: str) -> str:
    """``hub``, ``jsonl``, ``json``, ``parquet`` or ``csv``."""
    if path.startswith("hf://"):
        return "hub"
    suffix = os.path.splitext(path)[1].lower()
    if "/" in path and suffix not in SUFFIXES and not path.startswith(("./", "../", "/")) and "://" not in path and not os.path.exists(path):
        return "hub"
    return SUFFIXES.get(suffix, "jsonl")


def parse_hub_path(path: str) -> tuple[str, str | None, str | None]:
    """(name, subset, split) of ``hf://name[:subset[:split]]``."""
    parts = path.removeprefix("hf://").split(":")
    return (parts[0], *[(p or None) for p in (parts[1:] + [None, None])[:2]])


def hub_parts(path: Column) -> Column:
    """The same as a struct column."""
    parts = F.split(F.regexp_replace(path, "^hf://", ""), ":")
    return F.struct(parts[0].alias("name"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("subset"), F.nullif(F.get(parts, F.lit(2)), F.lit("")).alias("split"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank and malformed lines are skipped. With a schema nothing is inferred."""
    if schema is None:
        df = spark.read.option("mode", "DROPMALFORMED").json(path)
        return df.drop("_corrupt_record")
    parsed = F.from_json("value", schema if isinstance(schema, str) else schema.json(), {"mode": "PERMISSIVE"})
    good = F.expr("try_parse_json(value)").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return spark.read.text(path).filter(good).select(parsed.alias("r")).select("r.*")


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Lines that are not blank, malformed ones included."""
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).count()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of rows, an object that holds one under ``data``, ``samples`` or ``examples``, or a single row."""
    df = spark.read.option("multiLine", True).json(path)
    for name in CONTAINERS:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            rows = df.select(F.explode(name).alias("r"))
            return rows.select("r.*") if isinstance(rows.schema["r"].dataType, T.StructType) else rows
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_hub_folder(spark: SparkSession, root: str, path: str) -> DataFrame:
    """A dataset kept in a folder ``root/name/subset/split``: one subset, or all of them with their name as ``_config``."""
    name, subset, split = parse_hub_path(path)
    if subset:
        return spark.read.parquet(f"{root}/{name}/{subset}/{split or 'train'}")
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{root}/{name}").withColumn("_path", F.input_file_name())
    inside = F.regexp_extract("_path", rf"/{re.escape(name)}/([^/]+)/([^/]+)/", 1)
    at = F.regexp_extract("_path", rf"/{re.escape(name)}/([^/]+)/([^/]+)/", 2)
    return df.withColumn("_config", inside).filter(at == (split or "train")).drop("_path")


READERS = {"jsonl": read_jsonl, "json": read_json, "csv": read_csv, "parquet": lambda spark, path: spark.read.parquet(path)}


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """By the given format, else by the detected one."""
    fmt = fmt or detect_format(path)
    if fmt == "hub":
        return read_hub_folder(spark, options.pop("root", "."), path)
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}")
    return READERS[fmt](spark, path, **options)


def union_sources(frames: dict[str, DataFrame], column: str = "_config") -> DataFrame:
    """All rows, with the name of their source; columns that a source lacks are null."""
    if not frames:
        raise ValueError("no source could be read")
    out = None
    for name, df in frames.items():
        own = df.withColumn(column, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def is_alias(field: str, target: str) -> bool:
    return field.lower() in FIELD_ALIASES[target]


def detect_fields(columns: list[str]) -> dict[str, str]:
    """For each standard field the first column that is one of its aliases."""
    return {t: c for t in FIELD_ALIASES for c in [next((c for c in columns if is_alias(c, t)), None)] if c}


def last_message(messages: Column, role: str) -> Column:
    return blank(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"])


def first_message(messages: Column, role: str) -> Column:
    return blank(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"])


def standard(df: DataFrame, mapping: dict[str, str] | None = None, id_column: str | None = None) -> DataFrame:
    """(id, instruction, input, output) of rows of any shape.

    ``messages`` arrays give the last user and assistant message. Missing fields and nulls are empty. Ids come from
    ``id_column``, ``id``, ``_id``, or the content.
    """
    if not mapping and "messages" in df.columns:
        fields = {"instruction": last_message(F.col("messages"), "user"), "input": F.lit(""), "output": last_message(F.col("messages"), "assistant")}
    else:
        mapping = {"instruction": "instruction", "input": "input", "output": "output"} | (mapping if mapping else detect_fields(df.columns))
        fields = {t: blank(F.col(c)) if c in df.columns else F.lit("") for t, c in mapping.items()}
    given = [F.col(c) for c in dict.fromkeys([id_column, "id", "_id"]) if c and c in df.columns]
    rows = df.select(*[f.alias(t) for t, f in fields.items()], *[g.alias(f"_given{k}") for k, g in enumerate(given)])
    ident = content_id(F.col("instruction"), F.col("input"), F.col("output"), *[F.col(f"_given{k}") for k in range(len(given))])
    return rows.select(ident.alias("id"), "instruction", "input", "output")


def within_length(df: DataFrame, low: int = 10, high: int = 4096, columns: tuple[str, ...] = ("instruction", "input", "output")) -> DataFrame:
    """Rows whose fields have between ``low`` and ``high`` code points together."""
    total = sum((F.length(blank(F.col(c))) for c in columns), F.lit(0))
    return df.filter(total.between(low, high))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key that with the greatest ``order``. An aggregation: what loses goes before the shuffle."""
    last = df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_row"))
    return last.select("_row.*")


def heads(frames: dict[str, DataFrame], n: int, order: str) -> DataFrame:
    """The first ``n`` rows of each source by ``order``, with ``_config``."""
    return union_sources({name: df.orderBy(order).limit(n) for name, df in frames.items()})


def with_position(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 in the order of ``order``: a range sort, then offsets of its partitions; no task has all rows. ``order`` should be unique."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        raise RuntimeError("set spark.checkpoint.dir: positions need a written copy of the sorted rows")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    kept = df.orderBy(order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def zipped(left: DataFrame, right: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Rows of equal position side by side, as far as the shorter goes."""
    return with_position(left, order, name).join(with_position(right.withColumnRenamed(order, f"_{order}"), f"_{order}", name).drop(f"_{order}"), name)


def load(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, low: int = 10, high: int = 4096, limit: int | None = None, **options) -> DataFrame:
    """Detect, read, bring to standard form, filter by length, limit."""
    df = within_length(standard(read(spark, path, **options), mapping), low, high)
    return df.limit(limit) if limit else df


def read_npy(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(pos, embedding) of a two-dimensional ``.npy`` file; one file is one task, so save shards for large stores."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(matrix), 10_000):
                    part = matrix[at : at + 10_000].astype(np.float32)
                    yield pd.DataFrame({"pos": np.arange(at, at + len(part)), "embedding": list(part)})

    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "pos long, embedding array<float>")
    return df.join(ids, "pos") if ids is not None else df


def sample_data(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    """Synthetic samples: 40 % arithmetic, 30 % code, 30 % instructions."""
    from ..functions.det import uniform

    df = spark.range(rows).withColumn("u", uniform(seed, "kind", 0, "id")).withColumn("a", F.floor(uniform(seed, "a", 0, "id") * 90) + 10).withColumn("b", F.floor(uniform(seed, "b", 0, "id") * 90) + 10)
    kind = F.when(F.col("u") < 0.4, "math").when(F.col("u") < 0.7, "code").otherwise("instruction")
    df = df.withColumn("category", kind)
    short = F.when(F.col("category") == "instruction", "inst").otherwise(F.col("category"))
    text = F.when(F.col("category") == "math", F.concat(F.lit("What is "), F.col("a"), F.lit(" plus "), F.col("b"), F.lit("?"))).when(F.col("category") == "code", F.concat(F.lit("Write a function that adds "), F.col("a"), F.lit(" to its argument."))).otherwise(F.concat(F.lit("Name "), F.col("a"), F.lit(" animals.")))
    answer = F.when(F.col("category") == "math", (F.col("a") + F.col("b")).cast("string")).when(F.col("category") == "code", F.concat(F.lit("def f(x): return x + "), F.col("a"))).otherwise(F.lit("Cat, dog and others."))
    return df.select(F.concat(short, F.lit("_"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"), text.alias("instruction"), answer.alias("output"), "category")
