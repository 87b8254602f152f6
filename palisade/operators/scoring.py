"""Scoring of chunks by a detector: one client or model for each Python worker, batches through Arrow.

A detector is a function from texts to a list of signals (question to probability), made once for each
worker by its maker. Failures are rows, not exceptions.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import KEYWORDS

Detector = Callable[[list[str]], list[dict[str, float]]]


class ScorerError(Exception):
    """A failed call. outage: the scorer is failing, not this input; split: try smaller pieces."""

    def __init__(self, message: str, outage: bool = True, split: bool = False):
        super().__init__(message)
        self.outage, self.split = outage, split


def keyword_detector() -> Detector:
    """The deterministic baseline: 1 where a phrase of the keyword list occurs."""
    find = re.compile(KEYWORDS, re.I).search
    return lambda texts: [{"keywords": float(find(t) is not None)} for t in texts]


DETECTORS: dict[str, Callable[[], Detector]] = {"keywords": keyword_detector}


def register(name: str, maker: Callable[[], Detector]) -> None:
    DETECTORS[name] = maker


class Gate:
    """At most `rate` calls a minute from one worker."""

    def __init__(self, rate: float | None, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.step, self.next, self.now, self.sleep = 60 / rate if rate else 0.0, 0.0, now, sleep

    def wait(self) -> None:
        if self.step:
            self.sleep(max(0.0, self.next - self.now()))
            self.next = max(self.next, self.now()) + self.step


def scored_batch(detector: Detector, texts: list[str], pieces: Callable[[str], list[str]], gate: Gate, deadline: float, now: Callable[[], float]) -> list[tuple[dict[str, float], int, bool, str | None]]:
    """signals, failed chunks, outage and error of each text."""
    out = []
    for text in texts:
        if not text.strip():
            out.append(({}, 0, False, None))  # nothing to score
            continue
        if now() > deadline:
            out.append(({}, 1, False, "scan deadline reached"))
            continue
        try:
            gate.wait()
            out.append((detector([text])[0], 0, False, None))
        except ScorerError as e:
            parts = pieces(text) if e.split else []
            best: dict[str, float] = {}
            failed, outage = 0, e.outage and not parts
            for part in parts:
                try:
                    gate.wait()
                    for q, p in detector([part])[0].items():
                        best[q] = max(p, best.get(q, p))
                except ScorerError as inner:
                    failed, outage = failed + 1, outage or inner.outage
            out.append((best, failed if parts else 1, outage, str(e)[:200] if failed or not parts else None))
    return out


def score_chunks(chunks: DataFrame, text: str, detector: str, rate: float | None = None, seconds: float = 30.0, piece: tuple[int, int] = (2_000, 200)) -> DataFrame:
    """chunks with signals, failed, outage and error. A batch has `seconds`; what is left then counts as
    failed, not as an outage. A chunk that a scorer asks to split is scored in pieces."""
    maker = DETECTORS[detector]
    size, step = piece[0], piece[0] - piece[1]

    def pieces(t: str) -> list[str]:
        return [t] if len(t) <= size else [t[i : i + size] for i in range(0, len(t) - size + step, step)]

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, gate = maker(), Gate(rate)
        for frame in frames:
            found = scored_batch(own, frame[text].fillna("").tolist(), pieces, gate, time.monotonic() + seconds, time.monotonic)
            yield frame.assign(signals=[x[0] for x in found], failed=[x[1] for x in found], outage=[x[2] for x in found], error=[x[3] for x in found])

    columns = ", ".join(f"`{k}` {v}" for k, v in chunks.dtypes)
    return chunks.mapInPandas(f, f"{columns}, signals map<string,double>, failed int, outage boolean, error string")


def merged(scores: DataFrame, key: str, *any_of: str) -> DataFrame:
    """Chunk scores to items: the greatest probability of each question, what failed, and whether any chunk has the
    columns any_of. The scores are read once: each chunk counts in the row of its first question."""
    answers = scores.select(key, "failed", "outage", *any_of, F.posexplode_outer("signals").alias("pos", "question", "p"))
    first = F.coalesce("pos", F.lit(0)) == 0
    ors = ["outage", *any_of]
    answers = answers.groupBy(key, "question").agg(
        F.max("p").alias("p"), F.count_if(first).alias("n_chunks"), F.sum(F.when(first, F.col("failed")).otherwise(0)).alias("failed_chunks"), *[F.bool_or(c).alias(c) for c in ors]
    )
    entries = F.collect_list(F.when(F.col("question").isNotNull(), F.struct("question", "p")))  # a row for each question
    return answers.groupBy(key).agg(F.map_from_entries(entries).alias("signals"), F.sum("n_chunks").alias("n_chunks"), F.sum("failed_chunks").alias("failed_chunks"), *[F.bool_or(c).alias(c) for c in ors])


def fit_logistic(rows: DataFrame, features: str, label: str = "label"):
    """A balanced logistic regression on an array of features (spark.ml)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = rows.count(), max(1, counts.count())
    weighted = rows.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(total)) / (classes * F.col("n"))).withColumn("x", array_to_vector(F.col(features)))  # one row for each class
    return LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", maxIter=200, regParam=1.0 / max(1, total)).fit(weighted)
