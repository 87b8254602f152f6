"""Names of rows, and intermediate tables."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from palisade.llm import common
from palisade.llm.common import forget, scanned
from palisade.llm.exact_dedup import drop_copies, exact_copies
from palisade.llm.near_dedup import classes
from palisade.llm.suffix_dedup import without_repeats


def several(spark, path):
    """Frames of a table of 40 rows, 8 of them with a copy, in which every row comes twice."""
    docs = spark.read.parquet(path)
    return {
        "exploded": docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n"),
        "read twice": spark.read.parquet(path, path),
        "joined": docs.join(spark.createDataFrame([(1,), (2,)], "n int"), F.col("n") > 0).drop("n"),
        "united": docs.unionByName(docs),
    }


def test_each_group_keeps_one_row_whatever_the_frame(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"text {i % 32} " + "of some words that are much the same " * 3) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    for name, docs in several(spark, path).items():
        assert docs.count() == 80, name
        found = exact_copies(spark, docs).collect()
        assert (len(found), sum(r["kept"] for r in found)) == (80, 32), name
        assert drop_copies(spark, docs).count() == 32, name
    docs = several(spark, path)["exploded"]
    found = classes(spark, docs).collect()
    assert len(found) == 80 and sum(r["kept"] for r in found) == len({r["class_id"] for r in found})


def test_spans_of_an_exploded_row(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, ["a" * 10 + "".join(map(chr, range(33, 120))) * 6, "short"])], "doc_id long, texts array<string>").write.parquet(path)
    docs = spark.read.parquet(path).select("doc_id", F.explode("texts").alias("text"))
    found = {r["n_bytes"]: r["n_removed"] for r in without_repeats(spark, docs).collect()}
    assert found[5] == 0 and found[10 + 87 * 6] == 87 * 6


def test_plain_scans_are_not_written_again(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    for df in (docs, docs.filter("doc_id > 1").select("doc_id", "text"), docs.alias("x")):
        assert scanned(spark, df) is df
    assert scanned(spark, docs.filter(F.rand() < 0.5)) is not docs


def test_intermediate_tables_go(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i % 5}") for i in range(20)], "doc_id long, text string")
    forget(spark)
    folder = Path(common.shared_folder(spark).removeprefix("file:")) / "palisade"
    before = set(os.listdir(folder)) if folder.exists() else set()
    out = exact_copies(spark, df)
    left = set(os.listdir(folder)) - before
    assert left and out.filter("kept").count() == 5
    forget(spark)
    assert set(os.listdir(folder)) - before == set()
