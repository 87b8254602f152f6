"""Readers and writers: JSON lines, nested JSON, pages, images, the audit log, quarantine and releases.

Every reader has a fixed schema. Every writer appends Parquet or JSON through Spark, so a lost executor
costs a task, and no file is touched from Python.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.text import image_kind

CORPUS = "id string, label int, source string, category string, kind string, text string, path string, position string"
SCORE = "id string, sha string, text map<string,double>, raw map<string,double>, error string"
CALL = "ts timestamp, tool string, mode string, action string, verdict string, score double, reasons array<string>, flags array<string>, chars long, ms long, error string"
# Limits of images and pools.
MOST_IMAGE_BYTES = 15 * 1024 * 1024
POST_LENGTH = (40, 2000)
QUARANTINE_ID = r"^fw-\d{8}-[0-9a-f]{6}$"


def parsed(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """lines with the struct `row`; a line that is not JSON gives null fields."""
    return lines.withColumn("row", F.from_json(F.col(line), schema, {"mode": "PERMISSIVE"}))


def last_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last in order."""
    place = F.struct(*order)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), place).alias("last")).select(key, "last.*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines keyed by id; of lines with one id the last counts."""
    lines = spark.read.text(path, wholetext=False)
    meta = lines.metadataColumn("_metadata")
    lines = lines.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = parsed(lines, CORPUS).select("file", "block", "at", "row.*").filter("id IS NOT NULL")
    return last_of_each(rows, "id", ["file", "block", "at"]).drop("file", "block", "at")


def good_scores(scores: DataFrame) -> DataFrame:
    """Score rows without an error."""
    return scores.filter(F.col("error").isNull() & F.coalesce(F.try_element_at("text", F.lit("unscorable")) == 0, F.lit(True)))


def failed_ids(scores: DataFrame) -> DataFrame:
    return scores.join(good_scores(scores).select("id"), "id", "left_anti").select("id").distinct()


def to_score(corpus: DataFrame, scores: DataFrame, key: str = "id", sha: str = "sha") -> DataFrame:
    """The rows of corpus without a good score of the same content."""
    return corpus.join(scores.select(key, sha), [key, sha], "left_anti")


def flattened(documents: DataFrame, json: str) -> DataFrame:
    """A map of lists (category to texts) in a JSON column, one row for each text."""
    return documents.select(F.explode(F.from_json(F.col(json), "map<string,array<string>>")).alias("category", "texts")).select("category", F.posexplode("texts").alias("pos", "text"))


def posts(lines: DataFrame, line: str, order: str, field: str = "content", seed: str = "7") -> DataFrame:
    """Posts of JSON lines, malformed ones left out: text of 40 to 2,000 characters that is not JSON, each
    once (the first), with the place in the order of a seeded hash."""
    text = F.regexp_replace(F.get_json_object(F.col(line), f"$.{field}"), r"^\s+|\s+$", "")
    rows = lines.select(F.col(order).alias("at"), text.alias("text")).filter(F.col("text").isNotNull() & F.char_length("text").between(*POST_LENGTH) & ~F.col("text").startswith("{"))
    return rows.groupBy("text").agg(F.min("at").alias("at")).select("at", "text", F.sha2(F.concat(F.col("text"), F.lit(f"|{seed}")), 256).alias("spot"))


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows as JSON lines without null keys, by day; never content."""
    kept = [c for c in rows.columns if c not in ("text", "raw", "result", "images")]
    rows.select(*kept, F.to_date("ts").alias("day")).write.mode("append").option("ignoreNullFields", "true").partitionBy("day").json(path)


def quarantined(rows: DataFrame, tool: Column, raw: Column, verdict: Column, digest: Column, day: Column) -> DataFrame:
    """Quarantine records; the id is the day and the content's digest, so a rerun gives the same."""
    qid = F.concat(F.lit("fw-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.substring(digest, 1, 6))
    return rows.select(qid.alias("qid"), tool.alias("tool"), verdict.alias("verdict"), digest.alias("content_sha256"), raw.alias("raw"))


def released(quarantine: DataFrame, wanted: DataFrame, day: Column) -> DataFrame:
    """Release lines of the wanted quarantine ids (qid) that are well formed and exist."""
    good = wanted.filter(F.col("qid").rlike(QUARANTINE_ID)).distinct()
    return quarantine.join(good, "qid").select(F.concat_ws(" ", "content_sha256", "qid", "tool", F.lit("released"), F.date_format(day, "yyyy-MM-dd")).alias("line"))


def release_list(lines: DataFrame) -> DataFrame:
    """The digests of a release list; blank lines and comments are left out."""
    return lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#")).select(F.split("line", r"\s+")[0].alias("digest")).distinct()


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


IMAGE = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])


@F.pandas_udf(IMAGE)
def inline_image(ref: pd.Series) -> pd.DataFrame:
    """Bytes of data: URIs and MEDIA: references as they stand in a result; errors as a column.

    A remote image is an error, as is one over 15 MB; a path is left to read_images()."""
    data, error = [], []
    for r in ref:
        d = e = None
        if r and r.startswith("data:"):
            try:
                d = base64.b64decode(r.partition(",")[2], validate=True)
            except ValueError:
                e = "undecodable data URI"
        elif r and re.match("https?://", r, re.I):
            e = "remote image, fetched by the model provider, not scanned"
        if d is not None and len(d) >= MOST_IMAGE_BYTES:
            d, e = None, "image larger than 15 MB, not scanned"
        data.append(d)
        error.append(e)
    return pd.DataFrame({"data": pd.Series(data, dtype=object), "error": pd.Series(error, dtype=object)})


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, data and error of image files; too large ones without their bytes."""
    large = F.col("length") >= MOST_IMAGE_BYTES
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.when(~large, F.col("content")).alias("data"), F.when(large, "image larger than 15 MB, not scanned").when(~image_kind(F.col("content")), "image could not be decoded").alias("error"))


def segments(data: bytes) -> Iterator[tuple[str, bytes]]:
    """The parts of an image file by name: a JPEG's by marker, with what follows its end as `after`; the chunks
    of a PNG and of a RIFF file."""
    at = 2
    if data[:2] == b"\xff\xd8":
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xD9:
                break
            yield f"{marker:02x}", data[at + 4 : at + 2 + size]
            at += 2 + max(size, 2)
            if marker == 0xDA:  # the picture's own data: any marker in it but the restart ones ends it
                ends = (m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", data[at:]))
                at += next(ends, len(data) - at)
        end = data.find(b"\xff\xd9", at)  # in a file that does not keep the format, the next one there is
        if end >= 0:
            yield "after", data[end + 2 :]
    elif data[:4] == b"\x89PNG":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            yield data[at + 4 : at + 8].decode("latin-1"), data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] == b"RIFF":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            yield data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + size]
            at += 8 + size + size % 2


def text_in(name: str, body: bytes) -> str | None:
    """The text that a part of an image file holds, with what it is."""
    if b"<x:xmpmeta" in body:
        packet = body[body.index(b"<x:xmpmeta") :].partition(b"</x:xmpmeta>")[0].decode("utf-8", "ignore")
        words = " ".join(" ".join(x.partition(">")[2] for x in packet.split("<")).split())
        return f"xmp: {words}" if words else None
    if name == "tEXt" and b"\0" in body:
        key, _, value = body.partition(b"\0")
        return f"{key.decode('latin-1')}: {value.decode('latin-1')}"
    text = body.decode("utf-8", "ignore") if name == "after" and len(body.strip(b"\0")) > 8 else ""
    shown = sum(c.isprintable() or c in "\n\r\t" for c in text)
    return f"trailing data after JPEG end: {text.strip()}" if text and shown > 0.9 * len(text) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def image_metadata(data: pd.Series) -> pd.Series:
    """Text in image bytes that needs no decoder: XMP packets, text chunks, and what follows a JPEG's end."""
    return data.map(lambda b: [text for part in segments(bytes(b or b"")) if (text := text_in(*part))])
