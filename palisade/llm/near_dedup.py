"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

For each of BANDS * ROWS hash functions a text's sample is the shingle, and the quantised weight, with
the least value of the exponential race of consistent weighted sampling: two texts agree in it with
the probability of their weighted Jaccard similarity. Texts that agree in all ROWS samples of a band
share a bucket. At similarity 0.8 that happens in some band with probability 0.998, at 0.85 with
0.9999.

Texts with equal words are one node. In a bucket every node is compared with the first one, the pivot,
by the exact weighted Jaccard similarity; those that pass are linked. Buckets of three nodes or more
that are in several components then are open. Pairs inside them that were not compared go by a prefix
index: shingles are put in one order, rare ones first, and two texts of similarity SIMILAR must share one
inside the first 1 - SIMILAR of the weight of each; the weight from that shingle on bounds what they can
have in common, and so does the sum of the lesser weights in PROFILE classes of shingles. All these bounds
are exact, so every pair that shares a bucket is connected, compared, or ruled out. Nodes that share a shingle of their prefixes are compared with the first of them, then with a
few, then with each other, and never inside a component: a large group of copies is connected before its
pairs would be made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.llm.common import few, identified, lookup, packed, save, scanned, text_of, tidy, unpacked
from palisade.llm.components import components
from palisade.llm.shingles import BUCKETS, Words, document_frequencies, inverse_frequencies, split_at_texts, weighted, weighted_jaccard
from palisade.llm.suffix_dedup import utf8

BANDS, ROWS = 12, 4
SIMILAR = 0.8
#: Elements whose samples are drawn at once.
DRAWN = 1 << 15
#: Nodes of a shingle that are compared with the others in a round (None: all of them); how many nodes one
#: copy of a node's text is compared with.
ROUNDS, COMPARED = (1, 16, None), 256
#: Classes of shingles in a node's profile.
PROFILE = 128
#: What sums of doubles, and of the floats of a profile, may be off by.
SLACK, FLOAT_SLACK = 1e-9, 1e-5


def gamma_quantiles(n: int) -> np.ndarray:
    """n equally likely values of a Gamma(2, 1) variable, ascending."""
    x = np.concatenate([[0], np.geomspace(1e-5, 60, 200_000)])
    return np.interp((np.arange(n) + 0.5) / n, -np.expm1(-x) - x * np.exp(-x), x)


class Sampler:
    def __init__(self) -> None:
        self.r = gamma_quantiles(1 << 16).astype(np.float32)
        self.ln_c = np.log(gamma_quantiles(1 << 20)).astype(np.float32)
        self.seeds = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """uint64[texts, BANDS * ROWS]; text i has entries begin[i]:begin[i + 1], one at least."""
        ln_w = np.log(weights).astype(np.float32)
        place = np.arange(len(hashes), dtype=np.uint64)
        out = np.zeros((len(begin) - 1, len(self.seeds)), np.uint64)
        for k, seed in enumerate(self.seeds):
            h = hashes * seed
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9FB21C651E98DF25)
            r = self.r[(h >> np.uint64(28)).astype(np.uint16)]
            beta = (h & np.uint64(0xFFFFFFF)).astype(np.float32) * np.float32(2.0**-28)
            t = np.floor(ln_w / r + beta)
            ln_a = self.ln_c[(h >> np.uint64(44)).astype(np.int32)] - r * (t - beta + np.float32(1))
            # the order of floats as that of integers: least value first, then least place
            bits = ln_a.view(np.int32)
            bits = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
            least = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | place, begin[:-1])
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out[:, k] = (hashes[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * seed
        return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """int64[texts, BANDS]: the bucket of each band."""
    out = np.zeros((len(samples), BANDS), np.uint64)
    for j in range(ROWS):
        out = (out ^ samples[:, j::ROWS]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def signatures(idf):
    """(uid, doc_id, text) to uid, doc_id, words (digest of the word sequence; null without words) and
    bands."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sampler = Words(), Sampler()
        for b in batches:
            digests: list[bytes | None] = [None] * len(b)
            bands = np.zeros((len(b), BANDS), np.int64)
            for at, to, hashes, text in words.parts(*utf8(b.column(2))):
                begin = split_at_texts(text, to - at)
                raw = hashes.tobytes()
                for i in np.flatnonzero(np.diff(begin)).tolist():
                    digests[at + i] = hashlib.blake2b(raw[8 * begin[i] : 8 * begin[i + 1]], digest_size=16).digest()
                of, shingles, weights = weighted(hashes, text, to - at, idf.value)
                starts = split_at_texts(of, to - at)
                full = np.flatnonzero(np.diff(starts))
                a = 0
                while a < len(full):
                    z = max(a + 1, int(np.searchsorted(starts[full], starts[full[a]] + DRAWN)))
                    z = min(z, len(full))
                    lo, hi = starts[full[a]], starts[full[z - 1] + 1]
                    edges = np.concatenate([starts[full[a:z]], [hi]]) - lo
                    bands[at + full[a:z]] = bands_of(sampler.samples(shingles[lo:hi], weights[lo:hi], edges))
                    a = z
            yield pa.record_batch([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(list(bands), pa.list_(pa.int64()))], names=["uid", "doc_id", "words", "bands"])

    return f


def similarities(idf):
    """Rows sorted by pivot and deal (pivot, deal, uid null for the pivot's own text, text) to pivot,
    uid and similarity."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own, vector = Words(), None, None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            uids, out = b.column(2).to_pylist(), ([], [], [])
            for at, to, hashes, text in words.parts(*utf8(b.column(3))):
                of, shingles, weights = weighted(hashes, text, to - at, idf.value)
                starts = split_at_texts(of, to - at)
                for i in range(to - at):
                    entry = shingles[starts[i] : starts[i + 1]], weights[starts[i] : starts[i + 1]]
                    if uids[at + i] is None:
                        own, vector = keys[at + i], (entry[0].copy(), entry[1].copy())
                        continue
                    if keys[at + i] != own:
                        raise ValueError("a pivot's text is missing")
                    for column, value in zip(out, (own[0], uids[at + i], weighted_jaccard(vector, entry)), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["pivot", "uid", "similarity"])

    return f


def verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """pairs (pivot, uid) with their similarity. A pivot's text goes out once for every COMPARED nodes."""
    deals = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("int").alias("deals"))
    dealt = save(spark, pairs.join(deals, "pivot").withColumn("deal", F.pmod(F.hash("uid"), F.col("deals"))).select("pivot", "deal", "uid"), "dealt")
    others = dealt.join(texts, "uid").select("pivot", "deal", "uid", "text")
    own = dealt.select("pivot", "deal").distinct().join(texts.withColumnRenamed("uid", "pivot"), "pivot").select("pivot", "deal", F.lit(None).cast("binary").alias("uid"), "text")
    rows = own.unionByName(others).repartition("pivot", "deal").sortWithinPartitions("pivot", "deal", F.col("uid").asc_nulls_first())
    return save(spark, rows.mapInArrow(similarities(idf), "pivot binary, uid binary, similarity double"), "similar")


def frequencies(spark: SparkSession, texts: DataFrame):
    """A broadcast of the IDF of each bucket (BUCKETS numbers, whatever the corpus)."""
    rows = texts.select("text").mapInArrow(document_frequencies, "bucket int, documents long").groupBy("bucket").agg(F.sum("documents").alias("documents")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["documents"]
    return spark.sparkContext.broadcast(inverse_frequencies(counts, texts.count()))


def own_shingles(idf):
    """(uid, text) to a row for each distinct shingle of each text: shingle, uid, weight."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at, to, hashes, text in words.parts(*utf8(b.column(1))):
                of, shingles, weights = weighted(hashes, text, to - at, idf.value)
                yield pa.record_batch([pa.array(shingles.view(np.int64)), b.column(0).take(pa.array(of + at)), pa.array(weights)], names=["shingle", "uid", "weight"])

    return f


def profiles(idf):
    """(uid, text) to uid and profile, the weight of a text's shingles in each class of them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            out = np.zeros((len(b), PROFILE))
            for at, to, hashes, text in words.parts(*utf8(b.column(1))):
                of, shingles, weights = weighted(hashes, text, to - at, idf.value)
                classes = of * PROFILE + (shingles % np.uint64(PROFILE)).astype(np.int64)
                out[at:to] += np.bincount(classes, weights, (to - at) * PROFILE).reshape(-1, PROFILE)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1).astype(np.float32)), PROFILE)
            yield pa.record_batch([b.column(0), rows.cast(pa.list_(pa.float32()))], names=["uid", "profile"])

    return f


def prefixes(spark: SparkSession, texts: DataFrame, idf) -> DataFrame:
    """A row for each shingle in the prefix of each text: shingle, uid, total (the weight of all shingles
    of the text) and rest (of this one and those after it).

    Only shingles that another text of `texts` has too are listed, but all weigh.
    """
    each = save(spark, texts.mapInArrow(own_shingles(idf), "shingle long, uid binary, weight double"), "shingles")
    known = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    totals = each.groupBy("uid").agg(F.sum("weight").alias("total"))
    common = save(spark, each.join(known, "shingle"), "common")
    shared = common.groupBy("uid").agg(F.sum("weight").alias("shared"))
    # a text whose own shingles weigh more than it may lack has no partner
    able = totals.join(shared, "uid").filter(F.col("shared") >= SIMILAR * F.col("total") * (1 - SLACK))
    behind = W.partitionBy("uid").orderBy(F.desc("texts"), F.desc("shingle")).rowsBetween(W.unboundedPreceding, 0)
    listed = common.join(able, "uid").withColumn("rest", F.sum("weight").over(behind))
    # what stands before a shingle is the unshared weight and the rarer shared ones
    return listed.filter(F.col("rest") >= SIMILAR * F.col("total") * (1 - SLACK)).select("shingle", "uid", "total", "rest")


def with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("of", F.coalesce("component", "uid")).drop("component")


def joined(spark: SparkSession, compared: DataFrame) -> DataFrame:
    return components(spark, compared.filter(F.col("similarity") >= SIMILAR).select(F.col("uid").alias("a"), F.col("pivot").alias("b")))


def apart(members: DataFrame, key: list[str]) -> DataFrame:
    """The groups of members (of, the component) that have several components, and three members or more."""
    sizes = members.groupBy(*key).agg(F.min("of").alias("a"), F.max("of").alias("z"), F.count(F.lit(1)).alias("n"))
    return sizes.filter((F.col("a") != F.col("z")) & (F.col("n") > 2)).select(*key)


def linked(spark: SparkSession, nodes: DataFrame, texts: DataFrame, idf) -> DataFrame | None:
    """node and component for the nodes (uid, bands) that are similar to another one; None without any."""
    entries = nodes.select("uid", F.posexplode("bands").alias("band", "bucket"))
    full = entries.groupBy("band", "bucket").agg(F.min("uid").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = save(spark, entries.join(full, ["band", "bucket"]), "buckets")
    n = members.count()
    pairs = save(spark, few(members.filter("uid <> pivot").select("pivot", "uid").distinct(), n), "pairs")
    if pairs.isEmpty():
        return None
    texts = save(spark, texts.join(members.select("uid").distinct().hint("shuffle_hash"), "uid"), "texts")
    compared = verified(spark, pairs, texts, idf)
    found = joined(spark, compared)
    of = with_components(members, found)
    left = save(spark, few(of.join(few(apart(of, ["band", "bucket"]), n), ["band", "bucket"], "left_semi").select("uid").distinct(), n), "open")
    if left.isEmpty():
        return found
    entries = save(spark, prefixes(spark, texts.join(left, "uid"), idf), "prefixes")
    # a similarity of s needs an overlap of s / (1 + s) of the two totals
    needed = (F.col("x_total") + F.col("y_total")) * (SIMILAR / (1 + SIMILAR))
    for most in ROUNDS:
        of = with_components(entries, found)
        members = save(spark, of.join(of.groupBy("shingle").agg(F.min("of").alias("a"), F.max("of").alias("z")).filter("a <> z").select("shingle"), "shingle"), "members")
        kept = ["uid", "of", "total", "rest"]
        bound = F.lit(True)
        if most is None:
            seen = texts.join(members.select("uid").distinct(), "uid").mapInArrow(profiles(idf), "uid binary, profile array<float>")
            members = save(spark, members.join(seen, "uid"), "profiled")
            kept.append("profile")
            overlap = F.aggregate(F.zip_with("x_profile", "y_profile", lambda a, b: F.least(a, b)), F.lit(0.0), lambda a, b: a + b)
            bound = overlap >= needed * (1 - FLOAT_SLACK)
            order = F.col("x_uid") < F.col("y_uid")
            first = members
        else:
            order = F.lit(True)
            first = members.groupBy("shingle", F.pmod(F.hash("uid"), F.lit(most)).alias("class")).agg(F.min(F.struct("uid", "of", "total", "rest")).alias("x")).select("shingle", "x.*")
        x = first.select("shingle", *[F.col(k).alias(f"x_{k}") for k in kept])
        y = members.select("shingle", *[F.col(k).alias(f"y_{k}") for k in kept])
        new = x.join(y, "shingle").filter((F.col("x_of") != F.col("y_of")) & order & (F.least("x_rest", "y_rest") >= needed * (1 - SLACK)) & bound)
        new = new.select(F.least("x_uid", "y_uid").alias("pivot"), F.greatest("x_uid", "y_uid").alias("uid")).distinct()
        new = save(spark, new.join(compared, ["pivot", "uid"], "left_anti"), "pairs")
        if new.isEmpty():
            continue
        answers = verified(spark, new, texts, idf)
        compared = compared.unionByName(answers)
        if not answers.filter(F.col("similarity") >= SIMILAR).isEmpty():
            found = joined(spark, compared)
    return found


@tidy
def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """uid, doc_id, class_id (the smallest doc_id of the class), class_size and kept for each row of docs
    (doc_id, text).

    Further columns are not read, whatever their names. Repeated rows are in one class. Texts with the same words in the same order are
    in one class; a text without any word (null, empty, only punctuation) is a class of its own. kept
    holds for one row of each class, that of the smallest doc_id (null last). An empty table gives no
    rows.
    """
    docs = scanned(spark, docs)
    texts = identified(docs, [docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")])
    idf = frequencies(spark, texts)
    rows = save(spark, texts.mapInArrow(signatures(idf), "uid binary, doc_id long, words binary, bands array<long>").withColumn("salt_of", F.spark_partition_id()), "signatures")
    nodes = save(spark, rows.filter("words IS NOT NULL").groupBy("words").agg(F.min(F.struct("uid", "bands")).alias("one")).select("words", "one.uid", "one.bands"), "nodes")
    found = linked(spark, nodes, texts.select("uid", "text"), idf)
    owners = nodes.select("words", F.col("uid").alias("node"))
    owners = owners.select("words", F.col("node").alias("class")) if found is None else owners.join(found, "node", "left").select("words", F.coalesce("component", "node").alias("class"))
    named = save(spark, lookup(rows.select("uid", "doc_id", "words", "salt_of"), owners, ["words"], F.col("salt_of")).select("uid", "doc_id", "salt_of", F.coalesce("class", "uid").alias("class")), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    sizes = named.groupBy("class").agg(first, F.count(F.lit(1)).alias("class_size")).select("class", F.col("first.doc_id").alias("class_id"), F.col("first.uid").alias("kept_uid"), "class_size")
    out = lookup(named, sizes, ["class"], F.col("salt_of"))
    return out.select("uid", "doc_id", "class_id", "class_size", (F.col("uid") == F.col("kept_uid")).alias("kept"))


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that classes() keeps, with their columns."""
    docs = scanned(spark, docs)
    gone = classes(spark, docs).filter(~F.col("kept")).select("uid")
    return unpacked(packed(docs).join(gone.hint("shuffle_hash"), "uid", "left_anti"), docs.columns)
