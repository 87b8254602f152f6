"""Exact deduplication by a tree merge of sorted digest runs.

Each partition of the input makes sorted runs of fixed-size records, one for each distinct text.
Slots then exchange runs in binomial rounds of radix 8: in round r, eight slots that differ only in
their r-th octal digit deal their runs out among themselves by the r-th octal digit of the digests.
Every receiver merges its runs multiway, and of equal digests keeps the smallest record, so copies
vanish at every level and a group of any size weighs one record for each slot. After the last round
each slot owns one range of digests.

A record is digest (32 bytes, SHA-256 of the normalised text) | 2^63-1 minus the code points of the
original (8) | doc_id is null (1) | doc_id with its sign bit flipped (8) | uid (16) | group size (8),
all big-endian: the smallest record of a digest, as bytes, is the row that stays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import identified, lookup, packed, save, scanned, text_of, tidy, unpacked

RADIX = 8
DIGEST, RECORD = 32, 73
#: Records in one run row: about 4.6 MB.
RUN = 64_000
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
BIAS = 1 << 63
RUNS = pa.schema([("slot", pa.int32()), ("run", pa.binary())])
KEPT = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_uid", pa.binary()), ("group_size", pa.int64())])


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def rounds_for(rows: int, rows_in_slot: int = 100_000) -> int:
    """Rounds, so that RADIX ** rounds slots hold about rows_in_slot records each; two at least."""
    rounds = 2
    while RADIX**rounds * rows_in_slot < rows:
        rounds += 1
    return rounds


def octal(digest: bytes, r: int) -> int:
    """The r-th octal digit of a digest."""
    return int.from_bytes(digest[:8], "big") >> (61 - 3 * r) & 7


def merged(records: Iterator[bytes]) -> Iterator[bytes]:
    """One record for each digest of sorted records: the smallest, with the sizes added."""
    for _, same in groupby(records, lambda x: x[:DIGEST]):
        first = next(same)
        n = int.from_bytes(first[-8:], "big") + sum(int.from_bytes(x[-8:], "big") for x in same)
        yield first[:-8] + n.to_bytes(8, "big")


def dealt(records: Iterator[bytes], slot: int, r: int) -> Iterator[pa.RecordBatch]:
    """Sorted records as run rows, each for the slot that has the records' r-th digit as its own."""
    step = RADIX**r
    base = slot - slot // step % RADIX * step
    held: dict[int, list[bytes]] = {}
    for x in records:
        to = base + octal(x, r) * step
        run = held.setdefault(to, [])
        run.append(x)
        if len(run) >= RUN:
            yield pa.record_batch([[to], [b"".join(held.pop(to))]], schema=RUNS)
    for to, run in held.items():
        yield pa.record_batch([[to], [b"".join(run)]], schema=RUNS)


def first_runs(slots: int):
    """Digest rows to run rows for round 0; each batch is one sorted run."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = []
            for slot, digest, length, doc_id, uid in zip(*(c.to_pylist() for c in b.columns), strict=True):
                records.append((slot % slots, digest + (BIAS - 1 - length).to_bytes(8, "big") + (b"\1" if doc_id is None else b"\0") + ((doc_id or 0) + BIAS).to_bytes(8, "big") + uid + (1).to_bytes(8, "big")))
            records.sort()
            for slot, same in groupby(records, lambda x: x[0]):
                yield from dealt(merged(x for _, x in same), slot, 0)

    return f


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Each slot of a task with its records, merged multiway. Memory: the packed runs of the task."""
    runs: dict[int, list[bytes]] = {}
    for b in batches:
        for slot, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            runs.setdefault(slot, []).append(run)
    cut = lambda run: (run[i : i + RECORD] for i in range(0, len(run), RECORD))
    for slot in list(runs):
        yield slot, merged(heapq.merge(*map(cut, runs.pop(slot))))


def exchange(r: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, records in merge_runs(batches):
            yield from dealt(records, slot, r)

    return f


def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of two or more; a text of its own needs no answer."""
    for _, records in merge_runs(batches):
        out: tuple[list, ...] = ([], [], [], [])
        for x in records:
            if (n := int.from_bytes(x[-8:], "big")) > 1:
                doc_id = None if x[40] else int.from_bytes(x[41:49], "big") - BIAS
                for column, value in zip(out, (x[:DIGEST], doc_id, x[49:65], n), strict=True):
                    column.append(value)
                if len(out[0]) >= RUN:
                    yield pa.record_batch(list(out), schema=KEPT)
                    out = ([], [], [], [])
        yield pa.record_batch(list(out), schema=KEPT)


def groups(digests: DataFrame, rounds: int) -> DataFrame:
    """(digest, keep_id, keep_uid, group_size) of every group of two or more.

    digests: slot int (any numbering of where rows come from), digest, length, doc_id, uid.
    """
    slots = RADIX**rounds
    runs = digests.select("slot", "digest", "length", "doc_id", "uid").mapInArrow(first_runs(slots), "slot int, run binary")
    for r in range(1, rounds):
        runs = runs.repartitionById(slots, F.col("slot")).mapInArrow(exchange(r), "slot int, run binary")
    return runs.repartitionById(slots, F.col("slot")).mapInArrow(last, "digest binary, keep_id long, keep_uid binary, group_size long")


def decided(spark: SparkSession, digests: DataFrame) -> DataFrame:
    """digests (uid, slot, doc_id, digest, length), with keep_id, keep_uid and group_size for every row."""
    digests = save(spark, digests, "digests")
    found = save(spark, groups(digests, rounds_for(digests.count())), "copies")
    out = lookup(digests, found, ["digest"], F.col("slot"))
    alone = F.col("group_size").isNull()
    return out.select("uid", "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("keep_uid") == F.col("uid"))).alias("kept"))


def digest_columns(text: Column, doc_id: Column) -> list[Column]:
    return [F.spark_partition_id().alias("slot"), doc_id.cast("long").alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(text), "utf-8"), 256)).alias("digest"), F.char_length(text).cast("long").alias("length")]


@tidy
def exact_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without [\\x20\\x09-\\x0D]; a null text counts as empty, and empty
    texts are a group like any other. Of a group the row with the most code points in its original
    text stays, then the smallest doc_id (null last); of rows that are equal in both, exactly one is
    kept. An empty table gives no rows; further columns are not read.
    """
    docs = scanned(spark, docs)
    digests = identified(docs, digest_columns(text_of(docs), docs["doc_id"]))
    return decided(spark, digests).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@tidy
def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_copies() keeps, with their columns."""
    docs = scanned(spark, docs)
    digests = identified(docs, digest_columns(text_of(docs), docs["doc_id"]))
    gone = decided(spark, digests).filter(~F.col("kept")).select("uid")
    return unpacked(packed(docs).join(gone, "uid", "left_anti"), docs.columns)
