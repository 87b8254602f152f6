"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token is a linked list of symbols, one for each byte. A heap holds the adjacent pairs that the
vocabulary can merge, by (rank, position); the lowest is popped, its two symbols become one, and the
pairs of the new symbol with its neighbours are pushed. Entries whose symbols have changed since are
skipped. The count is the initial symbols minus the merges; no ids are looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import text_of

#: Pieces whose counts a Python worker remembers; the store is emptied when it is full.
REMEMBERED = 1_000_000
# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes that are
    printable in Latin-1 stand for themselves, the others for the code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """Ranks of pairs, as the merges of a tokenizer file list them, and the special strings."""

    def __init__(self, file: str):
        spec = json.loads(file)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.symbols = byte_symbols()

    def count(self, token: bytes) -> int:
        """Tokens of one pre-token."""
        symbol: list[str | None] = [self.symbols[b] for b in token]
        n = len(symbol)
        if n < 2:
            return n
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if symbol[i] != left or (j := after[i]) >= n or symbol[j] != right:
                continue
            merges += 1
            symbol[i], symbol[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        return n - merges


class LibraryMerges(Merges):
    """Counts by the tokenizers library, for operators that need lengths and are not about merging."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.special = [t["content"] for t in json.loads(file)["added_tokens"]]
        self.symbols = byte_symbols()
        self.model = Tokenizer.from_str(file).model

    def count(self, token: bytes) -> int:
        return len(self.model.tokenize("".join([self.symbols[b] for b in token])))


class Counter:
    """Counts tokens of whole texts. What is between two single spaces is a piece that no pre-token
    crosses, so a text's count is the sum of its pieces', and those are remembered."""

    def __init__(self, merges: Merges):
        import regex

        self.merges, self.pretokens = merges, regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(regex.escape(s) for s in merges.special)) if merges.special else None
        self.pieces: dict[str, int] = {}

    def raw(self, text: str) -> int:
        return sum(self.merges.count(t.encode("utf-8")) for t in self.pretokens(text))

    def plain(self, text: str) -> int:
        pieces = text.split(" ")
        if "" in pieces:  # runs of spaces, or spaces at an end, may be pre-tokens of their own
            return self.raw(text)
        known, total = self.pieces, 0
        if len(known) > REMEMBERED:
            known.clear()
        first = pieces[0]
        total = self.raw(first)
        for p in pieces[1:]:
            n = known.get(p)
            if n is None:
                n = known[p] = self.raw(" " + p)
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.specials is None or not any(s in text for s in self.merges.special):
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def counter_for(file, merges: type[Merges] = Merges) -> Callable[[], Counter]:
    """One Counter for each Python worker, from a broadcast of the vocabulary's text (its size is the
    vocabulary's, whatever the corpus)."""
    made: list[Counter] = []

    def get() -> Counter:
        if not made:
            made.append(Counter(merges(file.value)))
        return made[0]

    return get


def vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def with_token_counts(spark: SparkSession, docs: DataFrame, path: str, *kept: str, merges: type[Merges] = Merges) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens for each row of docs, after the columns named in kept, in
    one pass without a shuffle.

    The counts are those of the tokenizers library for the vocabulary file at `path`, with special
    strings in a text taken as special tokens (its default) and none added. Null and empty texts
    count 0; each repeated row is counted; an empty table gives no rows.
    """
    get = counter_for(vocabulary(spark, path), merges)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = get().count
        for b in batches:
            counts = pa.array([count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.record_batch([*b.columns[:-1], counts], names=[*b.schema.names[:-1], "n_tokens"])

    text = text_of(docs)
    rows = docs.select(*[docs[k] for k in kept], docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(f, T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]))


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    return with_token_counts(spark, docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
