"""Embedding of texts. Encoders are functions from texts to a matrix, run on Arrow batches; the default hashes words."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MODELS, e5_prefixed
from ..sources import sinks


class Encoder(Protocol):
    """What a text encoder offers; ``open`` is called once per task and gives the function that encodes a batch."""

    name: str
    dim: int

    def open(self) -> Callable[[list[str]], np.ndarray]: ...


class HashEncoder:
    """Signed hashing of words to ``dim`` dimensions, at unit length; no model, no network."""

    def __init__(self, dim: int = 256, name: str = "hash"):
        self.dim, self.name = dim, name

    def open(self) -> Callable[[list[str]], np.ndarray]:
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim), np.float32)
            for row, text in zip(out, texts, strict=True):
                for word in text.lower().split():
                    h = zlib.crc32(word.encode())
                    row[h % self.dim] += 1.0 if h & 0x80000000 else -1.0
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode


class RetryingEncoder:
    """A remote encoder with a few retries, each after a longer wait."""

    def __init__(self, call: Callable[[list[str]], np.ndarray], dim: int, name: str, retries: int = 3, wait: float = 1.0):
        self.call, self.dim, self.name, self.retries, self.wait = call, dim, name, retries, wait

    def open(self) -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            for attempt in range(self.retries):
                try:
                    return np.asarray(self.call(texts), np.float32)
                except Exception:  # what a remote end raises is not known here
                    if attempt + 1 == self.retries:
                        raise
                    time.sleep(self.wait * (attempt + 1))
            raise AssertionError

        return encode


ENCODERS: dict[str, Callable[..., Encoder]] = {"hash": HashEncoder}


def make_encoder(name: str, **options) -> Encoder:
    """A registered encoder; what is not registered needs a model that is not here."""
    if name not in ENCODERS:
        raise ValueError(f"no encoder {name!r}; register one in ENCODERS")
    return ENCODERS[name](**options)


def embed(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """(id, embedding) of (id, text). The encoder is opened once per task."""

    ready = texts.select("id", F.coalesce(e5_prefixed(F.col("text"), encoder.name), F.lit("")).alias("text"))
    return ready.mapInPandas(_mapper(encoder), _schema(ready))


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([df.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])


def _mapper(encoder: Encoder):
    def run(frames):
        encode = encoder.open()
        for frame in frames:
            yield pd.DataFrame({"id": list(frame["id"]), "embedding": list(encode(list(frame["text"])))})

    return run


def embed_missing(texts: DataFrame, path: str, encoder: Encoder) -> DataFrame:
    """Embed and append what the store at ``path`` lacks; the vectors of all ``texts``. A repeated or interrupted call loses and doubles nothing."""
    spark = texts.sparkSession
    todo = sinks.missing_only(texts, spark.read.parquet(path)) if sinks.exists(spark, path) else texts
    sinks.append_embeddings(spark, embed(todo, encoder), path)
    return spark.read.parquet(path).join(texts.select("id"), "id")


def model_table(spark) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, dim int, max_length int, multilingual boolean, kind string")


def model_info(names: DataFrame) -> DataFrame:
    """What is known of models (model), with defaults for others."""
    return names.join(F.broadcast(model_table(names.sparkSession)), "model", "left").select("model", "dim", F.coalesce("max_length", F.lit(512)).alias("max_length"), F.coalesce("multilingual", F.lit(False)).alias("multilingual"), F.coalesce("kind", F.lit("unknown")).alias("kind"))
