from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import common


def test_stages(spark, messy_docs, no_docs):
    docs, sizes = messy_docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == messy_docs.columns
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_packing_follows_the_mix(spark, messy_docs):
    """Inside each bucket, batches and places keep the order of what the mixing stage gives."""
    once = messy_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    mixed = corpus_pipeline.mixing(spark, once, "")
    for docs in (mixed, mixed.orderBy(F.desc("doc_id"))):
        order = [r["doc_id"] for r in docs.collect()]
        rows = sorted(corpus_pipeline.packing(spark, docs, "").collect(), key=lambda r: (r["bucket"], r["batch"], r["place"]))
        assert sorted(order) == sorted(r["doc_id"] for r in rows)
        for bucket in {r["bucket"] for r in rows}:
            own = [r["doc_id"] for r in rows if r["bucket"] == bucket]
            assert own == [i for i in order if i in set(own)]


def test_ranks_as_stored(spark, tmp_path):
    """Over several files and stretches of them."""
    path = str(tmp_path / "rows.parquet")
    spark.range(0, 1_000, 1, 12).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g")).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = common.ranked_as_stored(docs.select("id", "g", *common.stored_at(docs)), ["g"], 7).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        assert r["place"] == seen.setdefault(r["g"], 0)
        seen[r["g"]] += 1
    assert sum(seen.values()) == 1_000 and set(seen) == {None, 1, 2}


def test_names():
    import __spark_entry__ as e

    queries = e.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in queries) == 1
    assert "pipeline" in queries and set(e.oracle_sql()) <= set(queries)
