"""Packing by optimal length buckets.

A histogram of all lengths is gathered: a row for each distinct length, which the longest document bounds,
however many documents there are. Dynamic programming chooses at most BUCKETS boundaries among the lengths,
so that the padding, the sum over documents of their bucket's boundary minus their length, is least. Inside
a bucket documents are dealt, in a hashed order or in the one in which they come, to batches of as many as
the token budget holds at the bucket's length.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import identified, ranked, ranked_as_stored, save, scanned, stored_at, tidy
from palisade.llm.token_count import LibraryMerges, with_token_counts

BUCKETS, BUDGET = 16, 65_536


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The boundaries (ascending, the last is the greatest length) that pad least, from distinct
    lengths in ascending order and the documents of each; of equals, the fewest buckets.

    A bucket of the lengths i..j-1 weighs its documents times the length j-1. So the best weight of the
    first j lengths is the least of lines, one for each i, at the length j-1; their slopes fall as i grows and
    the lengths rise, so the lower envelope of the lines is kept in a queue and each layer takes linear time.
    """
    tops, n = [int(x) for x in lengths], len(lengths)
    held = [0, *accumulate(int(x) for x in counts)]
    cost: list[int | None] = [0, *[None] * n]
    choices, weights = [], []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        pick = [0] * (n + 1)
        envelope: deque[tuple[int, int, int]] = deque()  # slope, height, i
        for j in range(1, n + 1):
            if (height := cost[j - 1]) is not None:
                slope = -held[j - 1]
                # the last line goes if the one before it and this one are together never above it
                while len(envelope) > 1 and (height - envelope[-2][1]) * (envelope[-2][0] - envelope[-1][0]) <= (envelope[-1][1] - envelope[-2][1]) * (envelope[-2][0] - slope):
                    envelope.pop()
                envelope.append((slope, height, j - 1))
            x = tops[j - 1]
            while len(envelope) > 1 and envelope[1][0] * x + envelope[1][1] < envelope[0][0] * x + envelope[0][1]:
                envelope.popleft()
            if envelope:
                slope, height, pick[j] = envelope[0]
                new[j] = slope * x + height + held[j] * x
        choices.append(pick)
        weights.append(new[n])
        cost = new
    out, j = [], n
    used = min(range(len(weights)), key=lambda k: weights[k], default=-1) + 1
    for pick in reversed(choices[:used]):
        out.append(tops[j - 1])
        j = pick[j]
    return out[::-1]


def packed_lengths(spark: SparkSession, lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, as_given: bool = False) -> DataFrame:
    """lengths (uid, doc_id, n_tokens; one row for each document) with bucket, bucket_length, batch,
    place and padding. as_given: the documents of a bucket are dealt in the order of file and row, which lengths
    then have too."""
    histogram = sorted(map(tuple, lengths.groupBy("n_tokens").count().collect()))  # no more rows than the longest document has tokens
    tops = boundaries(np.array([x for x, _ in histogram]), np.array([n for _, n in histogram]), buckets)
    ends = F.array(*[F.lit(t).cast("long") for t in tops]) if tops else F.array().cast("array<long>")
    bucket = F.size(F.filter(ends, lambda e: e < F.col("n_tokens"))).cast("int")
    rows = lengths.withColumn("bucket", bucket).withColumn("bucket_length", F.get(ends, F.col("bucket")))
    placed = ranked_as_stored(rows, ["bucket"]) if as_given else ranked(rows, ["bucket"], ["doc_id", "uid"], total=sum(n for _, n in histogram))
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    batch = F.floor(F.col("place") / fit).cast("long")
    return placed.withColumn("batch", batch).withColumn("place", F.col("place") - F.col("batch") * fit).withColumn("padding", F.col("bucket_length") - F.col("n_tokens"))


@tidy
def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, buckets: int = BUCKETS, budget: int = BUDGET, as_given: bool = False) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch (in the bucket), place (in the batch) and padding
    for each row of docs (doc_id, text).

    Lengths are token counts under the vocabulary file. A document longer than the budget is a batch
    of its own, whole; null and empty texts have length 0. Repeated rows are packed each; an empty
    table gives no rows; further columns are not read, whatever their names.

    as_given: the batches of a bucket, and the places in them, follow the order of docs (that in which its rows
    are sorted, or stand in its files); else that of a hash.
    """
    docs = scanned(spark, docs)
    at, names = (stored_at(docs), ["file", "row"]) if as_given else ([], [])
    counted = with_token_counts(spark, identified(docs, [docs["doc_id"], docs["text"], *at]), vocabulary, "uid", *names, merges=LibraryMerges)
    counted = save(spark, counted, "lengths")
    return packed_lengths(spark, counted, buckets, budget, as_given).select("doc_id", "n_tokens", "bucket", "bucket_length", "batch", "place", "padding")
