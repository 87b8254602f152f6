"""Language ID by prediction by partial matching over bytes.

For each language a context tree of order 2 counts the bytes that follow each context of 0, 1 and 2
bytes. A byte that a context has not seen costs an escape and is coded one order lower, at last by
one of 256 equal codes (escape method C: an escape weighs as much as the distinct bytes seen). The
statistics are frozen after the fit, so a text's code length is a sum over its bytes; the language
with the shortest code wins.

The trees of all languages lie side by side in sparse tables: a row of costs, one for each language, for each
string of up to three bytes that some sample holds, and rows of escapes for the contexts. A byte whose
context and itself have a row is scored under every language by one lookup; any other escapes to the
table of the next order. Costs are integers in 1/4096 bit, so sums are exact and do not hang on how rows are
batched. The tables take 4 bytes for each language and distinct string, and so grow with the number of
languages and what the bounded samples hold, not with the corpus (some 8,000 strings for a language in one
script, a few hundred thousand for fifty in many).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import released, text_of

UNIT = 4096
#: The byte that stands before a text.
BEFORE = 32
#: Documents of one language that the fit uses, about; a bound on the sample whatever the corpus.
SAMPLE = 300
#: Bytes scored at once.
SCORED = 1 << 20


@dataclass(frozen=True)
class Order:
    """The strings of a context and a byte after it, for contexts of one length."""

    pages: np.ndarray  # int32[contexts of this length]: the page of a context, 0 for one that no sample holds
    rows: np.ndarray  # int32[pages, 256]: the row of a context and a byte, 0 where no sample holds them
    costs: np.ndarray  # int32[rows, languages]
    escapes: np.ndarray  # int32[pages, languages]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    orders: list[Order]  # of contexts of 0, 1 and 2 bytes
    lowest: int = 8 * UNIT


def strings(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of `length` bytes that end at a byte of the texts, as numbers, and their counts."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(texts), 64):
        parts = [found]
        for t in texts[at : at + 64]:
            c = np.frombuffer(bytes([BEFORE] * 2) + t, np.uint8).astype(np.int64)
            parts.append(sum(c[3 - length + j : len(c) - length + j + 1] << 8 * (length - 1 - j) for j in range(length)))
        weights = np.concatenate([counts, np.ones(sum(map(len, parts[1:])), np.int64)])
        found, where = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(where, weights, len(found)).astype(np.int64)
    return found, counts


def fit(samples: dict[str, list[bytes]]) -> Model:
    """The model of some texts of each language."""
    languages = sorted(samples)
    orders: list[Order] = []
    for order in range(3):
        own = [strings(samples[k], order + 1) for k in languages]
        keys = np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.int64)
        contexts = np.unique(keys >> 8)
        pages = np.zeros(256**order, np.int32)
        pages[contexts] = np.arange(1, len(contexts) + 1)
        page = pages[keys >> 8]
        rows = np.zeros((len(contexts) + 1, 256), np.int32)
        rows[page, keys & 255] = np.arange(1, len(keys) + 1)
        costs = np.zeros((len(keys) + 1, len(languages)), np.int32)
        escapes = np.zeros((len(contexts) + 1, len(languages)), np.int32)
        # of what is not in a sample, the codes of the order below
        lower = code_of(orders, keys, len(languages)) if len(languages) else costs[1:]
        for at, (found, counts) in enumerate(own):
            total, distinct = np.bincount(pages[found >> 8], counts, len(contexts) + 1), np.bincount(pages[found >> 8], minlength=len(contexts) + 1)
            weight = np.maximum(total + distinct, 1)
            escape = np.where(total > 0, distinct / weight, 1.0)
            escapes[:, at] = np.round(-np.log2(escape) * UNIT)
            costs[1:, at] = lower[:, at] + escapes[page, at]
            costs[1 + np.searchsorted(keys, found), at] = np.round(-np.log2(counts / weight[pages[found >> 8]]) * UNIT)
        orders.append(Order(pages, rows, costs, escapes))
    return Model(languages, orders)


def code_of(orders: list[Order], keys: np.ndarray, languages: int) -> np.ndarray:
    """int32[keys, languages]: costs of the last byte of each string, after as much of its context as the
    orders have."""
    if not orders:
        return np.full((len(keys), languages), 8 * UNIT, np.int32)
    order = orders[-1]
    context, byte = (keys >> 8) & (len(order.pages) - 1), keys & 255
    page = order.pages[context]
    row = order.rows[page, byte]
    out = order.costs[row]
    new = np.flatnonzero(row == 0)
    if len(new):
        out[new] = order.escapes[page[new]] + code_of(orders[:-1], keys[new], languages)
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """int64[texts, languages]: code lengths in 1/UNIT bit. data: bytes; offsets: int64[texts + 1]."""
    n, k = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, k), np.int64)
    scored = max(1, 4 * SCORED // max(k, 1))  # 4 * SCORED costs are held at once
    at = 0
    while at < n:
        # whole texts of about `scored` bytes; a longer one is scored in pieces
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + scored, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        for a in range(lo, max(hi, lo + 1), scored):
            b = min(hi, a + scored)
            if a == b:
                continue
            c = data[max(lo, a - 2) : b].astype(np.int32)
            c = np.concatenate([np.full(2 - (a - max(lo, a - 2)), BEFORE, np.int32), c])
            first = c[1:-1].copy()
            second = c[:-2].copy()
            starts = offsets[at:to]
            starts = starts[(starts >= a) & (starts < b) & (offsets[at + 1 : to + 1] > starts)] - a
            first[starts] = second[starts] = BEFORE
            nexts = starts + 1
            nexts = nexts[nexts < b - a]
            nexts = nexts[~np.isin(nexts, starts)]
            second[nexts] = BEFORE
            costs = code_of(model.orders, second << 16 | first << 8 | c[2:], k)
            ends = np.zeros((b - a + 1, k), np.int64)
            np.cumsum(costs, axis=0, dtype=np.int64, out=ends[1:])
            l, r = np.clip(offsets[at:to] - a, 0, b - a), np.clip(offsets[at + 1 : to + 1] - a, 0, b - a)
            out[at:to] += ends[r] - ends[l]
        at = to
    return out


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    found = np.zeros(len(texts), bool)
    if len(full):
        found[full] = np.logical_or.reduceat(letters[data], offsets[full])
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return found


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and bits for each byte of each text. A null text, one without a letter, and
    every text where nothing was learned, is `und` with score 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[:1]
    if not model.languages or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    lengths = code_lengths(model, data, offsets)
    best = lengths.argmin(1)  # ties: the first language by name
    least = lengths[np.arange(len(best)), best]
    share = 1 / np.exp2(-np.minimum((lengths - least[:, None]) / UNIT, 1000)).sum(1)
    known = has_letter(texts, data, offsets)
    bits = least / UNIT / np.maximum(offsets[1:] - offsets[:-1], 1)
    return [model.languages[i] if k else "und" for i, k in zip(best, known, strict=True)], np.where(known, share, 0.0), bits


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit. A null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def learn(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the documents that are not held out: of each language those whose
    id and text hash lowest, `sample` on average if there are more; one at least. Every value of lang is
    learned. Rows that repeat an id and its text count once."""
    usable = docs.filter(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"]))
    usable = usable.select(usable["lang"].cast("string").alias("lang"), F.xxhash64(usable["doc_id"].cast("string"), text_of(usable)).alias("spot"), text_of(usable).alias("text"))
    counts = usable.groupBy("lang").count()
    share = F.shiftrightunsigned("spot", 12) / F.lit(2.0**52)
    low = usable.join(F.broadcast(counts), "lang").filter(share * F.col("count") < sample)  # a row for each language
    rows = low.groupBy("lang", "spot").agg(F.min("text").alias("text")).select("lang", "text").collect()
    missing = counts.join(spark.createDataFrame([(k,) for k in {r["lang"] for r in rows}], "lang string"), "lang", "left_anti")
    rows += usable.join(F.broadcast(missing), "lang").groupBy("lang").agg(F.min(F.struct("spot", "text")).alias("x")).select("lang", "x.text").collect()
    samples: dict[str, list[bytes]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8"))
    return fit(samples)


def languages(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte for each row of docs (doc_id, text, lang).

    A null text or one without a letter is `und` with score 0; so is everything if no row has a
    language. score is the winner's share of 2 ** -code length over the languages. Repeated rows get
    a result each; an empty table gives none; ids, languages and sources are not inputs of a
    prediction.
    """
    model = spark.sparkContext.broadcast(learn(spark, docs, sample))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, bits = predict(model.value, b.column(2))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])
        released()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(f, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_languages(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs in a learned language, with their columns, whatever their names; only `und` rows go:
    null texts, texts without a letter, and all where nothing is learned. Repeated rows stay each; an empty
    table gives no rows."""
    model = spark.sparkContext.broadcast(learn(spark, docs, sample))
    place = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, _, _ = predict(model.value, b.column(place))
            yield b.filter(pa.array([x != "und" for x in lang], pa.bool_()))
        released()

    # positions, not names: names may repeat a reserved word or differ in case only
    return docs.mapInArrow(f, docs.schema)
