"""Word shingles of texts, weighted by TF-IDF, over whole Arrow columns at once.

A word is a run of ASCII letters (in either case), digits, underscores and bytes of other characters; a
shingle is five words in a row, and a text of one to four words is one shingle. Hashes are 64-bit
polynomials of the lower-case bytes.

A shingle weighs (1 + ln tf) times the mean IDF of its words. The IDF of a word is that of its hash
bucket, 1 + ln((1 + n) / (1 + df)) / ln(1 + n), between 1 and 2: document frequencies are counted over
the whole corpus, but in a table whose size does not grow with it. Words, not shingles, are counted,
so that the copies of a text do not make its own shingles cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from palisade.llm.anchors import BASE, INVERSE
from palisade.llm.suffix_dedup import utf8

WORDS = 5
BUCKETS = 1 << 16
#: Bytes handled at once.
MOST = 1 << 21
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
MULTIPLIERS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int) -> np.ndarray:
    out = np.full(MOST + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Words:
    def __init__(self) -> None:
        self.up, self.down = powers(BASE), powers(INVERSE)

    def of(self, data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of at most MOST bytes, and where they start; no word crosses a cut."""
        inside = IN_WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[[0, -1]] = True
        if cuts is not None:
            cut[cuts] = True
        gap = np.concatenate([[True], ~inside, [True]])
        starts = np.flatnonzero(inside & (cut[:-1] | gap[:-2]))
        ends = np.flatnonzero(inside & (cut[1:] | gap[2:])) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER[data] + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts]), starts

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """first text, last text, word hashes, text of each word. Texts come whole; the words of one
        over MOST bytes are gathered from stretches that end between words (or inside a longer word)."""
        at, n = 0, len(offsets) - 1
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + MOST, "right")) - 1
            if to > at:
                lo = offsets[at]
                words, starts = self.of(data[lo : offsets[to]], offsets[at : to + 1] - lo)
                yield at, to, words, np.searchsorted(offsets[at : to + 1] - lo, starts, "right") - 1
                at = to
                continue
            found, a, stop = [], int(offsets[at]), int(offsets[at + 1])
            while a < stop:
                z = min(a + MOST, stop)
                if z < stop:
                    gaps = np.flatnonzero(~IN_WORD[data[a:z]])
                    z = a + int(gaps[-1]) + 1 if len(gaps) else z
                found.append(self.of(data[a:z])[0])
                a = z
            words = np.concatenate(found)
            yield at, at + 1, words, np.zeros(len(words), np.int64)
            at += 1


def split_at_texts(text: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of n texts begin, and the end."""
    return np.searchsorted(text, np.arange(n + 1))


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to the documents of a partition that have a word of each bucket: bucket, documents."""
    words, counts = Words(), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, hashes, text in words.parts(*utf8(b.column(0))):
            keys = np.unique(text.astype(np.int64) * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
            counts += np.bincount(keys % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "documents"])


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log((1 + n) / (1 + np.minimum(counts, n))) / np.log(1 + max(n, 1))


def weighted(words: np.ndarray, text: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash, weight; sorted by text, then hash."""
    begin = split_at_texts(text, n)
    length = np.diff(begin)
    value = idf[(words % np.uint64(BUCKETS)).astype(np.int64)]
    count = np.where(length >= WORDS, length - WORDS + 1, (length > 0).astype(np.int64))
    of = np.repeat(np.arange(n), count)
    first = np.repeat(begin[:-1] - (np.cumsum(count) - count), count) + np.arange(len(of))
    hashes, weights, size = np.zeros(len(of), np.uint64), np.zeros(len(of)), np.zeros(len(of))
    stop = begin[1:][of]
    for j in range(WORDS):
        at = first + j
        real = at < stop
        at = np.minimum(at, len(words) - 1) if len(words) else at
        hashes += np.where(real, words[at] * MULTIPLIERS[j], np.uint64(0))
        weights += np.where(real, value[at], 0)
        size += real
    hashes, weights = mixed(hashes), weights / np.maximum(size, 1)
    order = np.lexsort((hashes, of))
    hashes, of, weights = hashes[order], of[order], weights[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([new, [len(of)]]))
    return of[new], hashes[new], weights[new] * (1 + np.log(np.maximum(tf, 1)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two vectors (sorted hashes, weights): the sum of the lesser weights over that of the greater."""
    total = a[1].sum() + b[1].sum()
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = b[0][at] == a[0]
    least = np.minimum(a[1][common], b[1][at[common]]).sum()
    return float(least / (total - least))
