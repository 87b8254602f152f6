"""What the operators of this subpackage share: the shared scratch folder, row identity, joins back
to rows that stand hot groups, and ranks without a window over a whole group."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves a local[...] master only (tests); any other master
    has executors that would not see it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders of intermediate tables that are still there: a list for each tidy() call under way, at the bottom
#: those that a frame given to the caller reads.
WRITTEN: list[list[str]] = [[]]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/palisade/{name}-{uuid.uuid4().hex}"
    WRITTEN[-1].append(path)
    return path


def leaves(df: DataFrame) -> list:
    """The scans of df's plan, as the JVM has them."""
    found = df._jdf.queryExecution().analyzed().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def roots(leaf) -> list[str]:
    """The paths that a scan was made from; none if it is not one of files."""
    if leaf.nodeName() != "LogicalRelation" or not hasattr(leaf.relation(), "location"):
        return []
    paths = leaf.relation().location().rootPaths()
    return [paths.apply(i).toString() for i in range(paths.size())]


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, with its intermediate tables deleted, but for those that the frame it returns reads.

    What such a frame reads stays until forget(), as nothing tells when the last frame made from it is done.
    """

    @functools.wraps(operator)
    def f(spark: SparkSession, *args, **kwargs) -> DataFrame:
        WRITTEN.append([])
        try:
            out = operator(spark, *args, **kwargs)
            read = {r.split(":", 1)[-1].lstrip("/") for leaf in leaves(out) for r in roots(leaf)}
            for path in WRITTEN[-1][:]:
                own = path.split(":", 1)[-1].lstrip("/")
                if not any(r == own or r.startswith(own + "/") for r in read):
                    delete(spark, path)
                    WRITTEN[-1].remove(path)
            return out
        finally:
            WRITTEN[-2].extend(WRITTEN.pop())

    return f


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of all frames that operators have returned so far; for when their
    results are written."""
    for path in WRITTEN[0]:
        delete(spark, path)
    WRITTEN[0].clear()


def save(spark: SparkSession, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, in_one: int = 50_000) -> DataFrame:
    """df, of narrow rows, in no more partitions than so many rows are worth."""
    return df.coalesce(max(8, -(-rows // in_one)))


def row_name(frame: DataFrame) -> Column:
    meta = frame.metadataColumn("_metadata")
    return F.unhex(F.concat(F.lpad(F.hex(F.xxhash64(meta["file_path"])), 16, "0"), F.lpad(F.hex(meta["row_index"]), 16, "0")))


def plain(df: DataFrame) -> bool:
    """Whether df is a scan of files, each read once, with projections and filters over it at most: then a
    row's file and its place in it name the row. A row that is exploded or joined may come several times."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    paths = [p.rstrip("/") + "/" for p in roots(plan)]
    if not paths or any(a.startswith(b) for i, a in enumerate(paths) for j, b in enumerate(paths) if i != j):
        return False
    try:
        df.select(row_name(df))
    except AnalysisException:
        return False
    return True


def scanned(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df if it is a plain() scan of files, else df written to the shared folder and read again."""
    return df if plain(df) else save(spark, df, "rows")


def identified(df: DataFrame, columns: list[Column]) -> DataFrame:
    """`columns` of a scanned() df behind `uid`, a binary(16) that names the row: its file and its place
    in it.

    The name does not hang on how a scan is split, so two jobs agree on it whatever executors they had.
    """
    return df.select(row_name(df).alias("uid"), *columns)


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """uid, the whole row as the struct `row` (so that no column of docs can clash), and extra."""
    return identified(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *extra])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def released() -> None:
    """Give back what a Python worker no longer uses; it may sit idle while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text of a row as a string that is never null."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def lookup(rows: DataFrame, groups: DataFrame, key: list[str], salt: Column) -> DataFrame:
    """rows left-joined to groups (one row per key) without one task meeting all rows of a hot key.

    The keys that each salt holds are joined first, one row for each (salt, key); rows then join on
    (salt, key), so a hot key is spread over as many tasks as there are salts.
    """
    rows = rows.withColumn("salt", salt)
    held = rows.groupBy("salt", *key).agg(F.lit(1).alias("held")).drop("held").join(groups, key)
    return rows.join(held, ["salt", *key], "left").drop("salt")


def ranked(df: DataFrame, group: list[str], order: list[str], rows_in_bucket: int = 20_000, total: int | None = None) -> DataFrame:
    """df with `place`, the 0-based long rank of each row in its group, in the order of a hash of
    `order` and then `order` itself.

    No task sorts a whole group: rows go to hash buckets of about rows_in_bucket rows, ranks are
    taken inside each (group, bucket), and the counts of the buckets before are added. Rows that are
    equal in `order` may swap places.
    """
    total = df.count() if total is None else total
    buckets = max(1, -(-total // rows_in_bucket))
    df = df.withColumn("spot", F.xxhash64(*order))
    # the top 31 bits of the hash, scaled: buckets follow the order of the hash
    df = df.withColumn("part", F.floor((F.shiftrightunsigned("spot", 33)) * F.lit(buckets) / F.lit(2.0**31)).cast("int"))
    sizes = df.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("held"))
    before = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = W.partitionBy(*group, "part").orderBy(F.shiftrightunsigned("spot", 33), "spot", *order)
    df = df.withColumn("place", F.row_number().over(inside).cast("long") - 1)
    on = [df[g].eqNullSafe(sizes[g]) for g in [*group, "part"]]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    out = df.join(sizes, cond, "inner")
    return out.select(*[df[c] for c in df.columns if c not in ("spot", "part", "place")], (df["place"] + sizes["before"]).alias("place"))


def stored_at(docs: DataFrame) -> list[Column]:
    """`file` and `row`: where each row of a scanned() frame is stored. The files of a frame that was sorted and written
    follow each other by name."""
    meta = docs.metadataColumn("_metadata")
    return [meta["file_path"].alias("file"), meta["row_index"].alias("row")]


def ranked_as_stored(df: DataFrame, group: list[str], rows_in_part: int = 20_000) -> DataFrame:
    """df (file, row: see stored_at) with `place`, the 0-based long rank of each row in its group, in the order in which
    rows are stored.

    No task sorts a whole group: ranks are taken inside stretches of rows_in_part rows of a file, and the counts of the
    stretches before are added.
    """
    df = df.withColumn("part", F.floor(F.col("row") / F.lit(rows_in_part)).cast("long"))
    sizes = df.groupBy(*group, "file", "part").agg(F.count(F.lit(1)).alias("held"))
    before = W.partitionBy(*group).orderBy(F.length("file"), "file", "part").rowsBetween(W.unboundedPreceding, -1)  # the 100,000th file has a longer name
    sizes = sizes.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = W.partitionBy(*group, "file", "part").orderBy("row")
    df = df.withColumn("place", F.row_number().over(inside).cast("long") - 1)
    cond = F.lit(True)
    for g in [*group, "file", "part"]:
        cond = cond & df[g].eqNullSafe(sizes[g])
    out = df.join(sizes, cond)
    return out.select(*[df[c] for c in df.columns if c not in ("part", "place")], (df["place"] + sizes["before"]).alias("place"))


DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
