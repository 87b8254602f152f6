"""A content-addressed store of token ids.

Each document's ids (and its end id) are cut into chunks where a rolling hash of the last 32 ids has
its low bits clear, so equal passages mostly give equal chunks wherever they stand. A chunk is named by a
128-bit digest of its bytes and stored once; a document is a recipe, the names and lengths of its
chunks. Merkle manifests verify: a chunk's name is its leaf, a document's root is the digest of its
leaves, the manifest has the root of a tree over the documents of each recipe file, and one root is over all.

Layout of a store, all Parquet, in a folder that driver and executors share:

  chunks/    key binary(16), data binary (further columns are null): ids as little-endian unsigned 16-bit integers where the
             vocabulary has at most 65,536 ids, else 32-bit
  recipes/   part=N/, N ascending with doc_id (nulls first): doc_id, start (ids of all documents
             before), n_tokens, names (16 bytes each), lengths (little-endian 32-bit integers),
             root; sorted
  manifest/  part, documents, n_tokens, root
  root/      documents, n_tokens, root: of the whole store
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from palisade.llm.common import fresh_path, released, save, text_of, tidy
from palisade.llm.token_count import byte_symbols

LEAST, MEAN, MOST, WINDOW = 64, 512, 4096, 32
#: Pieces whose ids a Python worker remembers, and chunk names that it has sent already.
REMEMBERED, SENT = 500_000, 100_000
#: Documents whose ids a worker holds at once.
HELD = 1024
NAME = 16
#: A capital before what may be a combining mark (the first is U+0300, bytes CC 80).
MARKED = re.compile(rb"[A-Z][\xcc-\xff]")
SYMBOLS = byte_symbols()
PUNCTUATION = string.punctuation.encode()
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 1 << 16, np.uint64)
ROWS = T.StructType([T.StructField("route", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("data", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("names", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("root", T.BinaryType())])
ARROW = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("data", pa.binary()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("lengths", pa.binary()), ("root", pa.binary())])


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NAME).digest()


def places(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: after ids at which the hash of the last WINDOW ids has its low bits clear."""
    # h[i] = sum of GEAR[ids[i - j]] << j over the last WINDOW ids, by doubling
    h = GEAR[ids & 0xFFFF]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    return np.flatnonzero((h >> np.uint64(32)) & np.uint64(MEAN - 1) == 0) + 1


def chosen(found: list[int], start: int, stop: int) -> list[int]:
    """The ends of the chunks of the ids from start to stop, of the places found in them. A chunk has LEAST ids
    or more, but for a document's last: so the WINDOW before its end lies inside the document."""
    ends, last = [], start
    for c in found:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            last = c
            ends.append(c)
    while stop - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == stop else [*ends, stop]


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of one document."""
    return chosen(places(ids).tolist(), 0, len(ids))


class Encoder:
    """Ids of whole texts, as the library gives them.

    A vocabulary of the kind WORDLY drops white space, no token crosses it, and a run of letters is one
    word. So a text is the ids of its pieces between spaces and
    newlines, and those of frequent pieces are remembered. A new piece of letters, maybe with a run of ASCII
    punctuation after it, is one word of the vocabulary's model, which gets it as it is after
    normalisation, and the ids of the run; others go through the whole tokenizer. ASCII letters are put in lower case
    before, as the vocabulary has it, but in no text where that may give other ids: where a
    special string stands in any case (they are matched on the text as it is), or a combining mark may
    follow a capital (they are composed before the case is lowered).

    With any other vocabulary the whole tokenizer gets whole texts.
    """

    def __init__(self, spec: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.end = self.ids([end])
        self.by_words = wordly(json.loads(spec))
        if self.by_words:
            self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.known = pieces(self)

    def ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.ids(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text (in UTF-8) and the end id, as bytes."""
        if not self.by_words:
            yield from (x + self.end for x in self.whole([t.decode() for t in texts]))
            return
        known = self.known
        if len(known) > REMEMBERED:
            known.turn()
        raws = []
        for raw in texts:
            low = raw.lower()
            if not any(x in low for x in self.special) and (raw.isascii() or not MARKED.search(raw)):
                raw = low
            raws.append(raw.replace(b"\n", b" "))
        # each distinct piece of the batch is looked up once; laid out again in their order, the ids of a
        # text's pieces are one stretch
        split = pc.split_pattern(pa.array(raws, pa.large_binary()), b" ")
        coded = split.flatten().dictionary_encode()
        laid = pa.array([known[p] for p in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
        at = np.frombuffer(laid.buffers()[1], np.int64)[np.asarray(split.offsets)].tolist() if len(laid) else [0] * (len(texts) + 1)
        data = memoryview(laid.buffers()[2] or b"")
        yield from (bytes(data[a:z]) + self.end for a, z in zip(at, at[1:]))


def pieces(encoder: Encoder) -> dict[bytes, bytes]:
    """The ids of pieces; those of a new one are made when they are asked for. Two generations are held:
    what has not been asked for since the last turn is dropped at the next."""
    tokenize, symbol = encoder.tokenizer.model.tokenize, SYMBOLS.__getitem__
    of = {i: encoder.ids([i]) for i in encoder.tokenizer.get_vocab().values()}

    class Pieces(dict):
        older: dict[bytes, bytes] = {}

        def __missing__(self, piece: bytes) -> bytes:
            ids = self.older.get(piece)
            if ids is None:
                word = piece.rstrip(PUNCTUATION)
                if word.isalpha():  # ASCII letters
                    symbols = word.lower().decode()
                elif (text := word.decode()).isalpha() and max(text) < "\u0100":
                    # of Latin-1 letters the lower case is beyond doubt, and they are composed already
                    symbols = "".join(map(symbol, text.lower().encode()))
                else:
                    self[piece] = ids = encoder.whole([piece.decode()])[0]
                    return ids
                ids = b"".join([of[t.id] for t in tokenize(symbols)])
                if len(word) < len(piece):
                    ids += self[piece[len(word) :]]
            self[piece] = ids
            return ids

        def turn(self) -> None:
            self.older = dict(self)
            self.clear()
            self[b""] = b""

    return Pieces({b"": b""})


#: The parts of a tokenizer file of the kind that Encoder takes apart (fixed values: its pattern and settings).
END_OF_WORD = "</w>"
WORDLY = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def wordly(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind WORDLY: with these parts, a byte-level BPE model that has every
    byte inside and at the end of a word, and special strings without white space that take none."""
    model, vocabulary = spec["model"], spec["model"].get("vocab", {})
    whole = all(s + e in vocabulary for s in SYMBOLS for e in ("", END_OF_WORD))
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == END_OF_WORD and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return whole and plain and added and all(spec.get(k) == v for k, v in WORDLY.items())


ENCODERS: dict[tuple[int, int, int], Encoder] = {}


def encoder_for(spec: str, end: int) -> Encoder:
    """The Encoder of this Python worker; it lives on from task to task."""
    key = (zlib.crc32(spec.encode()), len(spec), end)
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(spec, end)
    return ENCODERS[key]


@dataclass(frozen=True)
class Store:
    path: str
    dtype: str

    def chunks(self, spark: SparkSession) -> DataFrame:
        """name, data."""
        return spark.read.schema("key binary, data binary").parquet(f"{self.path}/chunks").select(F.col("key").alias("name"), "data")

    def recipes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("doc_id long, start long, n_tokens long, names binary, lengths binary, root binary, part int").parquet(f"{self.path}/recipes")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part int, documents long, n_tokens long, root binary").parquet(f"{self.path}/manifest")


def root_of(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree over the leaves; an odd node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [name_of(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def encoded(spark: SparkSession, docs: DataFrame, file: str, end: int) -> DataFrame:
    """Rows of two kinds in one pass: chunks (key, data), and recipes (data null)."""
    spec = spark.sparkContext.broadcast(file)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = encoder_for(spec.value, end), set()
        width = encoder.dtype.itemsize
        for whole in batches:
            for b in (whole.slice(i, HELD) for i in range(0, len(whole), HELD)):
                if len(sent) > SENT:
                    sent.clear()
                held = list(encoder.encode(b.column(1).cast(pa.binary()).to_pylist()))
                stops = np.cumsum([len(x) // width for x in held])
                data = b"".join(held)
                found = places(np.frombuffer(data, encoder.dtype))
                keys, pieces, names, lengths, roots = [], [], [], [], []
                start, a = 0, 0
                for stop, z in zip(stops.tolist(), np.searchsorted(found, stops, "right").tolist()):
                    ends = chosen(found[a:z].tolist(), start, stop)
                    own, sizes, last = [], array("i"), start
                    for c in ends:
                        piece = data[last * width : c * width]
                        own.append(key := name_of(piece))
                        sizes.append(c - last)
                        last = c
                        if key not in sent:
                            sent.add(key)
                            keys.append(key)
                            pieces.append(piece)
                    names.append(b"".join(own))
                    lengths.append(sizes.tobytes())
                    roots.append(root_of(own))
                    start, a = stop, z
                nulls = lambda n: [pa.nulls(n, f.type) for f in ARROW]
                ids, chunks, recipes = b.column(0), nulls(len(keys)), nulls(len(b))
                chunks[0] = pa.array([int.from_bytes(k[:7], "big") for k in keys], pa.int64())
                chunks[2], chunks[3] = pa.array(keys, pa.binary()), pa.array(pieces, pa.binary())
                # copies of a text are dealt by their ids as well
                recipes[0] = pa.array(np.array([zlib.crc32(x) for x in names], np.int64) ^ (pc.fill_null(ids, 0).to_numpy() & 0xFFFFFF))
                recipes[1], recipes[4] = ids, pa.array(np.diff(stops, prepend=0), pa.int64())
                recipes[5:] = [pa.array(x, pa.binary()) for x in (names, lengths, roots)]
                yield pa.record_batch(chunks, schema=ARROW)
                yield pa.record_batch(recipes, schema=ARROW)
        # idle workers hold little memory while other stages run
        sent.clear()
        released()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(f, ROWS)


def first_of_each(rows: DataFrame) -> DataFrame:
    """rows, dealt by route, without the chunks that are there already; recipes have no key and stay."""
    same = W.partitionBy("route", "key").orderBy("key")
    return rows.withColumn("n", F.row_number().over(same)).filter("key IS NULL OR n = 1").drop("n")


def write_store(spark: SparkSession, docs: DataFrame, file: str, end: int, path: str | None = None, rows_in_file: int = 100_000) -> Store:
    """Encode docs (doc_id, text) with the tokenizers file whose text is `file`, and write a store.

    Null texts are empty; an empty text is its end id alone. Documents of one doc_id (and those of
    null ids, which come first) stand next to each other, in the order of their contents. An empty
    table gives an empty store.
    """
    path = path or fresh_path(spark, "store")
    dtype = Encoder(file, end).dtype.str
    # one shuffle brings equal chunks together; recipes travel with them, and what is written is final
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = first_of_each(encoded(spark, docs, file, end).repartition(partitions, "route"))
    raw = f"{path}/raw"
    rows.withColumn("kind", F.when(F.col("key").isNull(), "recipe").otherwise("chunk")).write.option("compression", "zstd").partitionBy("kind").parquet(raw)
    raw_rows = spark.read.schema(T.StructType([*ROWS.fields, T.StructField("kind", T.StringType())])).parquet(raw)
    jvm = spark.sparkContext._jvm
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    recipes = raw_rows.filter("kind = 'recipe'").select("doc_id", "n_tokens", "names", "lengths", "root")
    parts = max(1, -(-recipes.count() // rows_in_file))
    # recipes are a few per cent of the ids; the numbering of the ranges is fixed by writing it
    ranged = save(spark, recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("held")).orderBy("part").collect()  # a row for each file
    before, total = [], 0
    for r in sums:
        before.append((r["part"], total))
        total += r["held"]
    offsets = spark.createDataFrame(before, "part int, before long")
    inside = W.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "names").rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(offsets), "part")
    placed = placed.withColumn("start", F.col("before") + F.col("inside")).select("doc_id", "start", "n_tokens", "names", "lengths", "root", "part")
    placed.sortWithinPartitions("part", "start").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/recipes")
    chunk_dir = f"{raw}/kind=chunk"
    if fs.exists(hadoop(chunk_dir)):
        # the chunk files stay as written: they are moved, and the columns that they have besides are not read
        fs.rename(hadoop(chunk_dir), hadoop(f"{path}/chunks"))
    else:
        spark.createDataFrame([], "key binary, data binary").write.parquet(f"{path}/chunks")
    fs.delete(hadoop(raw), True)
    store = Store(path, dtype)
    made = part_roots(spark, store).collect()  # a row for each file
    spark.createDataFrame(made, MANIFEST).write.parquet(f"{path}/manifest")
    spark.createDataFrame([whole_root(made)], "documents long, n_tokens long, root binary").write.parquet(f"{path}/root")
    return store


MANIFEST = "part int, documents long, n_tokens long, root binary"


def part_roots(spark: SparkSession, store: Store) -> DataFrame:
    """The manifest, from the recipes: a leaf of a part's tree is the digest of a document's id, start,
    n_tokens and root."""

    def f(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        ids, starts, sizes, roots = (rows.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root"))
        leaves = [name_of(f"{i} {at} {n} ".encode() + root) for i, at, n, root in zip(ids, starts, sizes, roots, strict=True)]
        return pa.table([rows.column("part")[:1], pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([root_of(leaves)], pa.binary())], names=["part", "documents", "n_tokens", "root"])

    return store.recipes(spark).select("part", "doc_id", "start", "n_tokens", "root").groupBy("part").applyInArrow(f, MANIFEST)


def whole_root(parts: list) -> tuple[int, int, bytes]:
    """Documents, n_tokens and root of a store, from the rows of its manifest."""
    parts = sorted(parts, key=lambda r: r["part"])
    return sum(r["documents"] for r in parts), sum(r["n_tokens"] for r in parts), root_of([bytes(r["root"]) for r in parts])


def verify(spark: SparkSession, store: Store) -> None:
    """An error, if the recipes do not give the manifest, or the manifest does not give the root over all."""
    rows = lambda df: sorted((r["part"], r["documents"], r["n_tokens"], bytes(r["root"])) for r in df.collect())
    found, manifest = rows(part_roots(spark, store)), store.manifest(spark)
    whole = spark.read.schema("documents long, n_tokens long, root binary").parquet(f"{store.path}/root").first()
    if found != rows(manifest) or whole is None or whole_root(manifest.collect()) != (whole["documents"], whole["n_tokens"], bytes(whole["root"])):
        raise ValueError("the manifest of the store does not verify")


POLY = 0xEDB88320


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc * x^(8 n_bytes) modulo the CRC-32 polynomial (reflected): what a CRC becomes when it is
    followed by n_bytes more, apart from their own CRC."""

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for i in range(32):
            out ^= np.where(a >> np.uint32(31 - i) & np.uint32(1), b, np.uint32(0))
            b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(POLY), b >> np.uint32(1))
        return out

    crc, left = crc.astype(np.uint32), n_bytes.astype(np.uint64)
    power = np.array([1 << 23], np.uint32)  # x^8
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            crc[odd] = times(crc[odd], np.broadcast_to(power, odd.sum()).copy())
        power, left = times(power, power.copy()), left >> np.uint64(1)
    return crc


def checked_chunks(spark: SparkSession, store: Store) -> DataFrame:
    """name, n_ids and crc (of the ids as 32-bit integers) of each stored chunk; a chunk whose bytes
    do not give its name is an error."""
    dtype = store.dtype

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name_of(data) != name:
                    raise ValueError(f"chunk {name.hex()} does not verify")
                ids = np.frombuffer(data, dtype).astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], names=["name", "n_ids", "crc"])

    return store.chunks(spark).mapInArrow(f, "name binary, n_ids int, crc long")


def names_of(packed: list[bytes]) -> pa.Array:
    raw = b"".join(packed)
    return pa.Array.from_buffers(pa.binary(NAME), len(raw) // NAME, [None, pa.py_buffer(raw)]).cast(pa.binary())


def uses(spark: SparkSession, store: Store) -> DataFrame:
    """A row for each chunk of each document: doc_id, start, n_tokens, at, name, length, after (ids of
    the document that follow the chunk). A recipe whose names do not give its root is an error."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            packed = b.column(3).to_pylist()
            length = np.frombuffer(b"".join(b.column(4).to_pylist()), "<i4").astype(np.int64)
            size = np.array([len(x) // NAME for x in packed], np.int64)
            for doc_id, names, root in zip(b.column(0).to_pylist(), packed, b.column(5).to_pylist(), strict=True):
                if root_of([names[i : i + NAME] for i in range(0, len(names), NAME)]) != root:
                    raise ValueError(f"the recipe of document {doc_id} does not verify")
            if len(length) != size.sum() or (size == 0).any() or (np.add.reduceat(length, np.cumsum(size) - size) != b.column(2).to_numpy()).any():
                raise ValueError("the lengths of a recipe do not verify")
            own = np.repeat(np.arange(len(b)), size)
            at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            upto = np.cumsum(length)
            ends = upto[np.cumsum(size) - 1] if len(own) else upto
            after = np.repeat(ends, size) - upto
            rows = b.select([0, 1, 2]).take(pa.array(own))
            yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), pa.array(at.astype(np.int32)), names_of(packed), pa.array(length.astype(np.int32)), pa.array(after)], names=["doc_id", "start", "n_tokens", "at", "name", "length", "after"])

    recipes = store.recipes(spark).select("doc_id", "start", "n_tokens", "names", "lengths", "root")
    return recipes.mapInArrow(f, "doc_id long, start long, n_tokens long, at int, name binary, length int, after long")


def read_checksums(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    A document's CRC-32 is the exclusive or of its chunks' CRCs, each shifted by the bytes that
    follow, so chunks are read and verified where they lie and only their CRCs travel. Recipes are
    verified against the manifest before.
    """
    verify(spark, store)
    found = uses(spark, store).join(checked_chunks(spark, store), "name", "left")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(5).null_count or (b.column(3).to_numpy() != b.column(5).to_numpy()).any():
                raise ValueError("a chunk of a recipe is missing or has another length")
            crc = shifted(b.column(6).to_numpy(), b.column(4).to_numpy() * 4)
            yield pa.record_batch([*b.columns[:3], pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "crc"])

    terms = found.select("doc_id", "start", "n_tokens", "length", "after", "n_ids", "crc").mapInArrow(f, "doc_id long, start long, n_tokens long, crc long")
    return terms.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start and ids (array<long>) of each document, rebuilt from the files."""
    dtype = store.dtype

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x), dtype).astype(np.int64) for x in b.column(2).to_pylist()]
            yield pa.record_batch([*b.columns[:2], pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    whole = uses(spark, store).join(store.chunks(spark), "name").groupBy("doc_id", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "data"))), lambda x: x["data"]).alias("data"))
    return whole.mapInArrow(f, "doc_id long, start long, ids array<long>")


@tidy
def token_store(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write a store for docs with the tokenizers file at `tokenizer`, and read the checksums back."""
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    return read_checksums(spark, write_store(spark, docs, file, end))
