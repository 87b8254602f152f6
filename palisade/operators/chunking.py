"""Overlapping chunks of texts, by code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Backend, characters, overlap, most chunks.
CHUNKS = {"jev": (12_000, 400, None), "laya": (1_092, 200, 40), "semif": (6_000, 300, 6), "retry": (2_000, 200, None)}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.when(length <= size, 1).otherwise(F.ceil((length - size) / F.lit(step)) + 1).cast("int")


def chunks(df: DataFrame, text: str, size: int, overlap: int, most: int | None = None) -> DataFrame:
    """A row for each chunk (pos from 0, chunk) of df's texts; truncated says that some were cut off by
    `most`. A blank text is one empty chunk."""
    body = trimmed(F.col(text))
    rows = df.withColumn("body", body).withColumn("n_chunks", chunk_count(F.char_length("body"), size, overlap))
    last = F.col("n_chunks") - 1 if most is None else F.least(F.col("n_chunks"), F.lit(most)) - 1
    rows = rows.withColumn("truncated", F.lit(False) if most is None else F.col("n_chunks") > most)
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("chunk", F.substring(F.col("body"), F.col("pos") * (size - overlap) + 1, F.lit(size))).drop("body")


def windows(df: DataFrame, text: str, size: int, most: int = 80) -> DataFrame:
    """Exploration windows: steps of four fifths of the size to the end of the text, so a last fragment
    stands alone."""
    step = size - size // 5
    body = trimmed(F.col(text))
    rows = df.withColumn("body", F.when(body == "", " ").otherwise(body))
    count = F.when(F.char_length("body") <= size, 1).otherwise(F.ceil(F.char_length("body") / F.lit(step))).cast("int")
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.least(count, F.lit(most)) - 1)))
    return rows.withColumn("window", F.substring(F.col("body"), F.col("pos") * step + 1, F.lit(size))).drop("body")


def sentences(df: DataFrame, text: str, most: int = 80) -> DataFrame:
    """Sentences of over three characters; a text without any gives its first 300 characters."""
    parts = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])\s+|\n+"), trimmed), lambda p: F.char_length(p) > 3)
    found = F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(F.substring(F.col(text), 1, 300)))
    return df.select("*", F.posexplode(found).alias("pos", "window"))


def first_of_group(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; each partition passes on n of a group at most."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
