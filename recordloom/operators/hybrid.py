"""Hybrid search over several tables: keyword and vector lists, fused by rank, with content and provenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from . import vector


def search_docs(tables: dict[str, DataFrame], content: int = 200, preview: int = 50) -> DataFrame:
    """table, id, content, preview, provenance of every row; tables: name to rows (id, text, provenance). Previews are
    one line."""
    out = None
    for name, rows in tables.items():
        one = rows.select(F.lit(name).alias("table"), "id", F.coalesce(F.substring("text", 1, content), F.lit("")).alias("content"), F.regexp_replace(F.coalesce(F.substring("text", 1, preview), F.lit("")), "\n", " ").alias("preview"), "provenance")
        out = one if out is None else out.unionByName(one)
    return out


def hybrid(keyword: DataFrame, near: DataFrame, docs: DataFrame, limit: int = 10) -> DataFrame:
    """table, id, score, source (fts, vec, both), content, preview, provenance: both lists (table, id and rank or
    similarity, each cut at a few times the limit) fused; a row that docs lack has empty content."""
    key = F.concat_ws(":", "table", F.col("id").cast("string"))
    one = keyword.select(key.alias("key"), F.row_number().over(W.orderBy("rank", "table", "id")).alias("place"))
    two = near.select(key.alias("key"), F.row_number().over(W.orderBy(F.desc("similarity"), "table", "id")).alias("place"))
    best = vector.fuse(one, two, limit).withColumn("table", F.substring_index("key", ":", 1)).withColumn("id", F.substring_index("key", ":", -1).cast("long"))
    kept = best.collect()  # `limit` rows: their ids reach the scans of docs as literals, so the lists are made once and no other text is read through
    best = best.sparkSession.createDataFrame(kept, best.schema)
    mine = F.lit(False)
    for table in sorted({r["table"] for r in kept}):
        mine |= (F.col("table") == table) & F.col("id").isin([r["id"] for r in kept if r["table"] == table])
    shown = F.broadcast(best).join(docs.filter(mine), ["table", "id"], "left")
    return shown.select("table", "id", "score", "source", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("preview", F.lit("")).alias("preview"), F.coalesce("provenance", F.lit("unknown")).alias("provenance")).orderBy(F.desc("score"), F.asc_nulls_last("p1"), F.asc_nulls_last("p2"))


def with_fallback(keyword: DataFrame, fused, table: str | None) -> tuple[DataFrame, str]:
    """The keyword list, or where it is empty and no table was asked for, what fused() gives; and which it was."""
    if table is None and keyword.isEmpty():
        return fused(), "hybrid-fallback"
    return keyword, "keyword"


def embed(rows: DataFrame, embedder, text: str = "text", model: str = "model", least: int = 10) -> DataFrame:
    """id, model, dimensions, embedding of rows long enough, by an injected function from a list of texts to vectors."""
    def run(batches):
        for batch in batches:
            made = embedder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model] * len(made)), pa.array([len(v) for v in made], pa.int32()), pa.array([[float(x) for x in v] for v in made], pa.list_(pa.float32()))], ["id", "model", "dimensions", "embedding"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.filter(F.length(text) >= least).select("id", text).mapInArrow(run, f"id {id_type}, model string, dimensions int, embedding array<float>")


def blobs(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vectors as little-endian 32-bit floats, for import and export."""
    @F.pandas_udf(BinaryType())
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return vectors.withColumn("blob", encode(vector)).drop(vector)


def from_blobs(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    @F.pandas_udf(ArrayType(FloatType()))
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return rows.withColumn(vector, decode("blob")).drop("blob")
