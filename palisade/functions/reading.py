"""The whole reading of untrusted text: what is left to score of it, and the flags of what it hid.

First-party texts go, invisible characters are revealed and the rest is composed (NFKC), HTML becomes labelled
text, base64 is decoded, opaque tokens are collapsed. Each step is a column of its own and is computed once;
only rows that need it go through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import markup
from palisade.functions import text as X
from palisade.functions.trusted import strip_first_party


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if it is so small that it comes in fewer partitions than there are: reading is costly."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read(df: DataFrame, text: str, to: str = "text", flags: str = "flags") -> DataFrame:
    """df with `to`, the reading of its column `text` (null: empty), and the array `flags`."""
    kept = [c for c in df.columns if c not in (to, flags)]
    df = df.withColumn("_own", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = strip_first_party(df, "_own", "_own")
    df = df.withColumn("_shown", X.shown(F.col("_own")))
    composed = F.coalesce(markup.nfkc(F.when(~X.ascii_only(F.col("_shown")), F.col("_shown"))), F.col("_shown"))
    df = df.withColumn("_composed", composed).withColumn("_read", X.with_tag_text(F.col("_composed"), F.col("_own")))
    df = df.withColumn("_page", markup.html_text(F.when(X.looks_like_html(F.col("_read")), F.col("_read"))))
    html = X.looks_like_html(F.col("_read"))
    of_page = F.when(html, F.col("_page.flags")).otherwise(F.array().cast("array<string>"))
    body = F.when(html, F.col("_page.text")).otherwise(F.col("_read"))
    done = X.let(body, lambda b: X.let(X.decoded_base64(b), lambda d: F.struct(X.let(X.with_decoded(b, d), X.collapse_opaque).alias("text"), (F.size(d) > 0).alias("decoded"))))
    df = df.withColumn("_done", done)
    decoded = F.when(F.col("_done.decoded"), F.array(F.lit("base64_text"))).otherwise(F.array().cast("array<string>"))
    return df.select(*kept, F.col("_done.text").alias(to), F.concat(X.unicode_flags(F.col("_own")), of_page, decoded).alias(flags))
