"""Queries over the driver's tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.secret_scan import secrets

    return secrets(spark, documents(spark, sf_dir))


def secret_sql() -> str:
    """Each rule's matches by their lengths and those of the texts between them, without an index."""
    from palisade.llm.secret_scan import BASE, MORE

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, n, {at} AS ord, '{r.kind}' AS kind, regexp_extract_all(t, {quoted(r.regex)}) AS ms, "
        f"regexp_extract_all(t, {quoted(r.regex)}, {r.group}) AS gs, string_split_regex(t, {quoted(r.regex)}) AS ps, {r.least} AS least FROM d"
        for at, r in enumerate([*BASE, *MORE])
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    text = "concat_ws(':', kind, s, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
m AS ({found}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
p AS (SELECT doc_id, n, ord, kind, length(gs[i]) >= least AS ok,
             list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::BIGINT AS s,
             length(ms[i]) AS w FROM i),
q AS (SELECT n, ord, kind, s, s + w AS e FROM p WHERE ok),
g AS (SELECT n, {counts},
             coalesce(string_agg({text}, ',' ORDER BY s, ord) FILTER (kind IN ({base})), '') AS base,
             string_agg({text}, ',' ORDER BY s, ord) AS spans FROM q GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.exact_dedup import exact_copies

    return exact_copies(spark, documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.token_count import token_counts

    return token_counts(spark, documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.nearest import neighbours

    return neighbours(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.near_dedup import classes

    return classes(spark, documents(spark, sf_dir)).drop("uid")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.mixing import mixture

    return mixture(spark, documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.language_id import languages

    return languages(spark, documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.packing import pack

    return pack(spark, documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.token_store import token_store

    return token_store(spark, documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.suffix_dedup import without_repeats

    return without_repeats(spark, documents(spark, sf_dir)).drop("removed")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_exact_dedup, op3_token_counts, op4_nearest, op5_near_dedup, op6_mixing, op7_language_id, op8_packing, op9_token_store, op10_suffix_dedup)}

ORACLE_SQL = {
    "op1_secret_scan": secret_sql(),
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)
