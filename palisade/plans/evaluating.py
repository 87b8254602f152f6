"""Queries on scores: aggregation over chunks, policies, verdicts, actions, thresholds and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.functions import verdict as V
from palisade.operators import evaluation as E
from palisade.plans.inputs import CALLS_SQL, ITEMS_SQL, SIGNALS_SQL, calls, items, signals, tables
from palisade.plans.registry import query
from palisade.plans.scanning import MODE, routed

S = f"s AS ({SIGNALS_SQL})"
I = f"i AS ({ITEMS_SQL})"  # noqa: E741
C = f"c AS ({CALLS_SQL})"


def num(x: float | None) -> str:
    return "NULL::DOUBLE" if x is None else f"CAST({x!r} AS DOUBLE)"


POLICIES = "pol AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', [{', '.join(repr(q) for q in qs)}], '{agg}', {num(b)}, {num(w)}, {num(lb)})" for p, qs, agg, b, w, lb in V.POLICIES) + ") AS t(policy, questions, agg, block, warn, local_block))"
SCORED = "sc AS (SELECT item_id, split, label, source, category, kind, policy, questions, agg, block, warn, local_block, CASE agg WHEN 'max' THEN max(coalesce(p, 0)) ELSE sum(p ORDER BY list_position(questions, question)) / len(questions) END AS score FROM s JOIN pol ON list_contains(questions, question) GROUP BY item_id, split, label, source, category, kind, policy, questions, agg, block, warn, local_block)"


def policies(spark: SparkSession) -> DataFrame:
    """A row for each policy; the list is part of the library."""
    return spark.createDataFrame(V.POLICIES, V.POLICY_SCHEMA)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its signals as a map."""
    key = ["item_id", "split", "label", "source", "category", "kind"]
    return signals(spark, sf_dir).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("question", "p"))).alias("signals"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array(*[F.struct(F.lit(p).alias("policy"), F.array(*map(F.lit, qs)).alias("questions"), F.lit(agg).alias("agg"), F.lit(float(b)).alias("block"), F.lit(float(w)).alias("warn"), F.lit(lb).cast("double").alias("local_block")) for p, qs, agg, b, w, lb in V.POLICIES])
    rows = wide(spark, sf_dir).withColumn("pol", F.explode(every)).select("*", "pol.*").drop("pol")
    return rows.withColumn("score", V.policy_score(F.col("signals"), F.col("questions"), F.col("agg")))


@query(f"WITH {S} SELECT item_id // 5 AS group_id, question, max(p) AS p, sum(item_id % 100)::BIGINT AS tokens, count(*) AS n_chunks FROM s GROUP BY 1, 2")
def d1_max_over_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five items stand for the chunks of one."""
    rows = signals(spark, sf_dir).groupBy(F.floor(F.col("item_id") / 5).cast("long").alias("group_id"), "question")
    return rows.agg(F.max("p").alias("p"), F.sum(F.col("item_id") % 100).alias("tokens"), F.count(F.lit(1)).alias("n_chunks"))


@query(f"WITH {S} SELECT item_id // 5 AS group_id, question, max(p) FILTER (item_id % 11 <> 0) AS p, count(*) FILTER (item_id % 11 = 0) AS failed_chunks, bool_or(item_id % 22 = 0) AS outage FROM s GROUP BY 1, 2")
def d2_partial_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum over good chunks; failed ones are counted."""
    rows = signals(spark, sf_dir).withColumn("ok", F.col("item_id") % 11 != 0)
    rows = rows.groupBy(F.floor(F.col("item_id") / 5).cast("long").alias("group_id"), "question")
    return rows.agg(F.max(F.when(F.col("ok"), F.col("p"))).alias("p"), F.count_if(~F.col("ok")).alias("failed_chunks"), F.bool_or(F.col("item_id") % 22 == 0).alias("outage"))


@query(f"WITH {S}, {POLICIES}, {SCORED} SELECT item_id, policy, round(score, 9) AS score FROM sc UNION ALL SELECT item_id, 'logistic', round(1 / (1 + exp(-(-1 + sum(CASE question WHEN 'override' THEN 2 WHEN 'covert' THEN -1 ELSE 0 END * p)))), 9) FROM s GROUP BY item_id")
def d3_policy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("item_id", "policy", F.round("score", 9).alias("score"))
    weights = F.create_map(F.lit("override"), F.lit(2.0), F.lit("covert"), F.lit(-1.0))
    logistic = V.policy_score(F.col("signals"), F.array(F.lit("override"), F.lit("covert")), F.lit("logistic"), weights, -1.0)
    return rows.unionByName(wide(spark, sf_dir).select("item_id", F.lit("logistic").alias("policy"), F.round(logistic, 9).alias("score")))


RANK = "CASE WHEN label = 1 AND item_id % 3 = 0 THEN 2 WHEN item_id % 5 = 0 THEN 1 ELSE 0 END"


@query(f"""WITH {I}, p AS (SELECT item_id // 4 AS group_id, item_id AS part, {RANK} AS rank, CASE WHEN item_id % 9 <> 0 THEN (item_id % 50) / 50::DOUBLE END AS score, 'r' || (item_id % 3) AS reason FROM i)
SELECT group_id, max(rank)::INT AS rank, arg_max(part, (rank, -part)) AS top_part, max(score) AS score, (SELECT string_agg(reason, ',' ORDER BY first_at) FROM (SELECT reason, min(part) AS first_at FROM p AS q WHERE q.group_id = p.group_id GROUP BY reason)) AS reasons, count(*) AS n_chunks FROM p GROUP BY group_id""")
def d4_merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a result: the worse verdict (of equals the first), the highest score, distinct reasons in order."""
    i = F.col("item_id")
    rank = F.when((F.col("label") == 1) & (i % 3 == 0), 2).when(i % 5 == 0, 1).otherwise(0)
    parts = items(spark, sf_dir).select(F.floor(i / 4).cast("long").alias("group_id"), i.alias("part"), rank.alias("rank"), F.when(i % 9 != 0, (i % 50) / 50).alias("score"), F.concat(F.lit("r"), i % 3).alias("reason"))
    found = parts.groupBy("group_id").agg(F.max("rank").alias("rank"), F.max_by("part", F.struct("rank", -F.col("part"))).alias("top_part"), F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("part", "reason"))).alias("r"), F.count(F.lit(1)).alias("n_chunks"))
    return found.select("group_id", "rank", "top_part", "score", F.array_join(F.array_distinct(F.transform("r", lambda x: x["reason"])), ",").alias("reasons"), "n_chunks")


AGGREGATORS = """ag AS (SELECT item_id, split, label, 'maxall' AS name, 0 AS ordinal, max(p) AS score FROM s GROUP BY 1, 2, 3
 UNION ALL SELECT item_id, split, label, 'meanall', 1, sum(p ORDER BY k) / 7 FROM s GROUP BY 1, 2, 3
 UNION ALL SELECT item_id, split, label, question, 2 + k, p FROM s
 UNION ALL SELECT a.item_id, a.split, a.label, m || '(' || a.question || ',' || b.question || ')', 9 + 2 * (a.k * 6 - a.k * (a.k - 1) // 2 + b.k - a.k - 1) + CASE m WHEN 'max' THEN 0 ELSE 1 END, CASE m WHEN 'max' THEN greatest(a.p, b.p) ELSE (a.p + b.p) / 2 END
 FROM s a JOIN s b ON a.item_id = b.item_id AND a.k < b.k CROSS JOIN (VALUES ('max'), ('mean')) AS t(m))"""
AUC = """h AS (SELECT {g}, score, sum(label) AS pos, sum(1 - label) AS neg FROM {t} GROUP BY ALL),
 c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {g} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM h),
 au AS (SELECT {g}, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(coalesce(sum(pos * lower + pos * neg / 2::DOUBLE) / nullif(sum(pos) * sum(neg), 0), 0.5::DOUBLE), 9) AS auc FROM c GROUP BY {g})"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {S}, {AGGREGATORS} SELECT item_id, name, ordinal::INT AS ordinal, round(score, 9) AS score FROM ag")
def d5_aggregators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.aggregators(signals(spark, sf_dir), ["item_id"]), "score").select("item_id", "name", "ordinal", "score")


@query(f"WITH {S}, {AUC.format(g='split, question', t='(SELECT split, question, label, p AS score FROM s)')} SELECT * FROM au")
def d6_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.auc(signals(spark, sf_dir), ["split", "question"], "p"), "auc")


THRESHOLD = """hh AS (SELECT {g}, score, sum(1 - label) AS neg FROM {t} GROUP BY ALL),
 cc AS (SELECT *, sum(neg) OVER (PARTITION BY {g} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS over_t, sum(neg) OVER (PARTITION BY {g}) AS n_neg FROM hh),
 th AS (SELECT {g}, budget, coalesce(min(score) FILTER (over_t / greatest(1, n_neg) <= budget), 1.01::DOUBLE) AS threshold FROM cc CROSS JOIN (VALUES {b}) AS t(budget) GROUP BY ALL)"""


@query(f"WITH {S}, {THRESHOLD.format(g='question', t='''(SELECT question, label, p AS score FROM s WHERE split = 'dev')''', b='(0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)')} SELECT * FROM th")
def d7_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.thresholds(signals(spark, sf_dir).filter("split = 'dev'"), ["question"], [0.01, 0.02, 0.05], "p")


@query(f"WITH {S}, {AGGREGATORS}, {AUC.format(g='split, name, ordinal', t='ag')} SELECT split, arg_max(name, (auc, -ordinal)) AS name, max(auc) AS auc FROM au GROUP BY split")
def d8_best_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = E.aggregators(signals(spark, sf_dir), ["item_id", "split", "label"])
    return E.best(rounded(E.auc(candidates, ["split", "name", "ordinal"]), "auc"), ["split"])


CONFUSION = "sum(label * f)::BIGINT AS tp, sum((1 - label) * f)::BIGINT AS fp, sum(label * f) / nullif(sum(label), 0)::DOUBLE AS tpr, sum((1 - label) * f) / nullif(sum(1 - label), 0)::DOUBLE AS fpr, sum(label * f) / greatest(1, sum(f))::DOUBLE AS precision"


@query(f"WITH {S} SELECT question, {CONFUSION} FROM (SELECT question, label, CASE WHEN p >= 0.6::DOUBLE THEN 1 ELSE 0 END AS f FROM s) GROUP BY question")
def d9_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(signals(spark, sf_dir), ["question"], F.col("p") >= 0.6)


@query(f"WITH {S} SELECT source, CASE WHEN source = 'carrier' THEN category ELSE '' END AS category, label, count(*) FILTER (p >= 0.6::DOUBLE) AS flagged, count(*) AS total FROM s WHERE question = 'override' GROUP BY 1, 2, 3")
def d10_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).filter("question = 'override'")
    category = F.when(F.col("source") == "carrier", F.col("category")).otherwise("").alias("category")
    return rows.groupBy("source", category, "label").agg(F.count_if(F.col("p") >= 0.6).alias("flagged"), F.count(F.lit(1)).alias("total"))


BENCH_VERDICT = "CASE WHEN score >= block THEN 'block' WHEN score >= warn OR category = 'unicode_tags' THEN 'warn' ELSE 'pass' END"


@query(f"WITH {S}, {POLICIES}, {SCORED}, v AS (SELECT policy, source, label, {BENCH_VERDICT} AS verdict FROM sc) SELECT policy, coalesce(source, 'ALL') AS source, label, count(*) FILTER (verdict = 'block') AS n_block, count(*) FILTER (verdict = 'warn') AS n_warn, count(*) FILTER (verdict = 'pass') AS n_pass FROM v GROUP BY GROUPING SETS ((policy, source, label), (policy, label))")
def d11_verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by source and label, with a row for all sources. A source twice in the input, once as ALL, is one aggregation."""
    rows = bench_verdicts(spark, sf_dir).select("policy", F.explode(F.array("source", F.lit("ALL"))).alias("source"), "label", "verdict")
    return rows.groupBy("policy", "source", "label").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("block", "warn", "pass")])


def bench_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hiding = F.col("category") == "unicode_tags"
    verdict = F.when(F.col("score") >= F.col("block"), "block").when((F.col("score") >= F.col("warn")) | hiding, "warn").otherwise("pass")
    return scored(spark, sf_dir).withColumn("verdict", verdict)


@query("SELECT event_type, median(value) AS p50, min(value) FILTER (rn = floor(0.95::DOUBLE * (n - 1))::BIGINT + 1) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def d12_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.at_rank(tables(spark, sf_dir, "events")["events"], ["event_type"], "value", E.latency_ranks())
    return found.select("event_type", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95")


@query("SELECT event_type, min(value) FILTER (rn = n // 2 + 1) AS p50 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def d13_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.at_rank(tables(spark, sf_dir, "events")["events"], ["event_type"], "value", E.latency_ranks()).select("event_type", F.col("upper").alias("p50"))


@query(f"WITH {S}, x AS (SELECT a.split, round(abs(a.p - b.p), 9) AS d FROM s a JOIN s b ON a.item_id = b.item_id WHERE a.question = 'override' AND b.question = 'covert'), r AS (SELECT split, d, row_number() OVER (PARTITION BY split ORDER BY d) AS rn, count(*) OVER (PARTITION BY split) AS n FROM x) SELECT split, median(d) AS p50, min(d) FILTER (rn = floor(0.95::DOUBLE * (n - 1))::BIGINT + 1) AS p95, max(d) AS most, count(*) FILTER (d > 0.1::DOUBLE) AS over_tenth FROM r GROUP BY split")
def d14_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two scorers are apart, item by item (also C6)."""
    rows = signals(spark, sf_dir)
    a, b = (rows.filter(F.col("question") == q).select("item_id", "split", F.col("p").alias(q)) for q in ("override", "covert"))
    d = a.join(b, ["item_id", "split"]).select("split", F.round(F.abs(F.col("override") - F.col("covert")), 9).alias("d"))
    ranks = E.at_rank(d, ["split"], "d", E.latency_ranks()).select("split", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95")
    return ranks.join(d.groupBy("split").agg(F.max("d").alias("most"), F.count_if(F.col("d") > 0.1).alias("over_tenth")), "split")


TRANSFER = "(SELECT count(*) FILTER (p >= 0.6::DOUBLE) / count(*)::DOUBLE FROM s WHERE split = 'dev' AND label = 0 AND question = 'override')"


@query(f"WITH {S}, h AS (SELECT p AS score, sum(1 - label) AS neg FROM s WHERE split = 'dev' AND question = 'covert' GROUP BY 1), c AS (SELECT score, sum(neg) OVER (ORDER BY score DESC) AS over_t, sum(neg) OVER () AS n FROM h) SELECT round({TRANSFER}, 9) AS budget, coalesce(min(score), 1.01::DOUBLE) AS threshold FROM c WHERE over_t / greatest(1, n) <= {TRANSFER}")
def d16_threshold_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of benign rows at 0.6 under one scorer, as the budget of another."""
    rows = signals(spark, sf_dir).filter("split = 'dev'")
    share = rows.filter("label = 0 AND question = 'override'").agg(F.avg((F.col("p") >= 0.6).cast("double")).alias("budget"))
    h = E.histogram(rows.filter("question = 'covert'"), ["split"], "p", "label")
    above = W.partitionBy("split").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("over", F.sum("neg").over(above)).withColumn("n", F.sum("neg").over(W.partitionBy("split")))
    h = h.crossJoin(F.broadcast(share)).filter(F.col("over") / F.greatest("n", F.lit(1)) <= F.col("budget"))  # one row
    return h.groupBy(F.round("budget", 9).alias("budget")).agg(F.coalesce(F.min("score"), F.lit(1.01)).alias("threshold"))


@query(f"WITH {I} SELECT source, label, count(*) AS n FROM i t WHERE split = 'test' AND EXISTS (SELECT 1 FROM i d WHERE d.split = 'dev' AND d.text = t.text) GROUP BY 1, 2")
def d18_duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("sha", F.sha2("text", 256)).drop("text")
    dev = rows.filter("split = 'dev'").select("sha").distinct()
    return rows.filter("split = 'test'").join(dev, "sha", "left_semi").groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S}, g AS (SELECT CASE WHEN category IN ('plain', 'zero_width') THEN 'pixel' WHEN category = '' THEN 'photo' ELSE 'metadata' END AS grp, label, p AS score FROM s WHERE kind = 'image' AND question = 'override'), {AUC.format(g='grp', t='g')} SELECT grp, n_pos, n_neg, auc FROM au")
def d19_image_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("category").isin("plain", "zero_width"), "pixel").when(F.col("category") == "", "photo").otherwise("metadata")
    rows = signals(spark, sf_dir).filter("kind = 'image' AND question = 'override'").withColumn("grp", group)
    return rounded(E.auc(rows, ["grp"], "p"), "auc")


@query("SELECT event_type, min(value) AS least FROM events GROUP BY event_type")
def d20_least_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "events")["events"].groupBy("event_type").agg(F.min("value").alias("least"))


SLICES = {"planted_email": "source = 'src3'", "deepset": "source = 'src4'", "gandalf_vs_benign": "source = 'carrier' OR label = 0", "carrier_text": "source = 'carrier' AND kind = 'text'", "carrier_image": "source = 'carrier' AND kind = 'image'", "attacks_vs_nostr": "label = 1 OR source = 'src5'", "attacks_vs_web": "label = 1 OR source = 'src6'", "markup": "source = 'carrier' AND category LIKE 'attr_%'", "all": "true"}


@query("WITH " + S + ", sl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS slice, label, p AS score FROM s WHERE question = 'override' AND ({c})" for n, c in SLICES.items()) + f"), {AUC.format(g='slice', t='sl')} SELECT * FROM au")
def b10_auc_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping slices: each row is dealt to all of its slices, then there is one aggregation."""
    rows = signals(spark, sf_dir).filter("question = 'override'")
    of = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in SLICES.items()]))
    return rounded(E.auc(rows.select(F.explode(of).alias("slice"), "label", "p"), ["slice"], "p"), "auc")


@query(f"WITH {S} SELECT item_id, label, p FROM s WHERE question = 'override' AND item_id % 13 <> 0")
def c1_scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).filter("question = 'override'")
    scores = rows.filter("item_id % 13 <> 0").select("item_id", "p")
    return rows.select("item_id", "label").join(scores, "item_id")


@query(f"WITH {S} SELECT item_id FROM s WHERE item_id % (k + 5) <> 0 GROUP BY item_id HAVING count(DISTINCT question) = 7")
def c2_scored_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that every scorer has scored."""
    rows = signals(spark, sf_dir).filter(F.col("item_id") % (F.col("k") + 5) != 0)
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 7").select("item_id")


@query(f"WITH {I} SELECT item_id FROM i t WHERE split = 'test' AND item_id % 9 <> 1 AND NOT EXISTS (SELECT 1 FROM i d WHERE d.split = 'dev' AND d.text = t.text)")
def c3_comparable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows that are neither in dev nor changed."""
    rows = items(spark, sf_dir).select("item_id", "split", F.sha2("text", 256).alias("sha"))
    changed = rows.filter("item_id % 9 = 1").select("item_id")
    kept = rows.filter("split = 'test'").join(rows.filter("split = 'dev'").select("sha").distinct(), "sha", "left_anti")
    return kept.join(changed, "item_id", "left_anti").select("item_id")


@query(f"WITH {S}, {POLICIES}, {SCORED} SELECT item_id, round(CASE WHEN source = 'src6' THEN max(score) FILTER (policy = 'laya') ELSE max(score) FILTER (policy = 'semif') END, 9) AS score FROM sc GROUP BY item_id, source")
def c4_hybrid_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two detectors by the source of a row."""
    picked = F.when(F.col("source") == "src6", "laya").otherwise("semif")
    return scored(spark, sf_dir).filter(F.col("policy") == picked).select("item_id", F.round("score", 9).alias("score"))


@query(f"WITH {S}, {POLICIES}, {SCORED} SELECT item_id, policy, round(score, 9) AS score FROM sc")
def c5_policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form: signals joined to the policies' questions."""
    asked = policies(spark).select("policy", "agg", F.size("questions").alias("n"), F.posexplode("questions").alias("at", "question"))
    rows = signals(spark, sf_dir).select("item_id", "question", "p").join(F.broadcast(asked), "question")  # the shipped policies
    score = F.when(F.col("agg") == "max", F.max("p")).otherwise(F.sum("p") / F.max("n"))
    return rows.groupBy("item_id", "policy", "agg").agg(score.alias("score")).select("item_id", "policy", F.round("score", 9).alias("score"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, 'fw-20240101-' || substring(sha256(coalesce(text, '')), 1, 6) AS qid, sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 17 = 0) AS released FROM documents WHERE doc_id % 6 = 0")
def c7_quarantine_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined results, and whether their content is released now."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    released = docs.filter("doc_id % 17 = 0").select("sha").distinct().withColumn("released", F.lit(True))
    held = docs.filter("doc_id % 6 = 0").withColumn("qid", F.concat(F.lit("fw-20240101-"), F.substring("sha", 1, 6)))
    return held.join(released, "sha", "left").select("doc_id", "sha", "qid", F.coalesce("released", F.lit(False)).alias("released"))


@query(f"WITH {S}, w AS (SELECT item_id, max(p) FILTER (question = 'override') AS a, max(p) FILTER (question = 'covert') AS b FROM s GROUP BY item_id) SELECT item_id, CASE item_id % 3 WHEN 0 THEN a WHEN 1 THEN CASE WHEN item_id % 2 = 0 THEN b ELSE 0 END ELSE a / 2 END AS p FROM w")
def h2_p_yes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probability from the three kinds of answers."""
    rows = wide(spark, sf_dir)
    i, a, b = F.col("item_id"), F.col("signals")["override"], F.col("signals")["covert"]
    kind = F.element_at(F.array(F.lit("noul"), F.lit("choice"), F.lit("score")), (i % 3 + 1).cast("int"))
    probs = F.when(i % 3 == 1, F.when(i % 2 == 0, F.create_map(F.lit("injection"), b)).otherwise(F.create_map(F.lit("content"), b))).otherwise(F.create_map(F.lit("0"), b, F.lit("2"), a / 2, F.lit("1"), b / 2))
    return rows.select("item_id", V.p_yes(kind, a, probs).alias("p"))


@query("SELECT event_id, CASE WHEN status = 200 THEN 'ok' WHEN status IN (429, 502, 503, 504) THEN 'retry' WHEN status = 500 THEN 'split' WHEN status IN (400, 413, 422) THEN 'input' ELSE 'outage' END AS status_class FROM (SELECT event_id, [200, 429, 500, 400, 401, 503, 413][event_id % 7 + 1] AS status FROM events)")
def h7_status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 429, 500, 400, 401, 503, 413)]), (F.col("event_id") % 7 + 1).cast("int"))
    return tables(spark, sf_dir, "events")["events"].select("event_id", V.status_class(status).alias("status_class"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' OR doc_id % 10 = 0 THEN 0 ELSE length(text) END::BIGINT AS scored_chars FROM documents")
def h9_empty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty texts are not sent to a scorer and have no signals."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", F.when(F.trim("text") != "", F.char_length("text")).otherwise(0).cast("long").alias("scored_chars"))


FLAGS = {0: ["unicode_tags"], 1: ["html_hidden_text"], 2: ["scan_truncated"], 3: [], 4: ["zero_width", "ocr_failed"]}


def flags_of(i: Column) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(f) for f in fs]).cast("array<string>") for fs in FLAGS.values()]), (i % 5 + 1).cast("int"))


VERDICT = "CASE WHEN score >= block THEN 'injection' WHEN score >= warn OR item_id % 5 IN (0, 2, 4) THEN 'suspicious' ELSE 'safe' END"


@query(f"WITH {S}, {POLICIES}, {SCORED} SELECT item_id, policy, round(score, 4) AS score, {VERDICT} AS verdict FROM sc")
def i1_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.decide(F.col("score"), F.col("block"), F.col("warn"), flags_of(F.col("item_id")))
    return scored(spark, sf_dir).select("item_id", "policy", F.round("score", 4).alias("score"), v.alias("verdict"))


@query(f"WITH {S}, {POLICIES}, {SCORED} SELECT item_id, policy, {BENCH_VERDICT} AS verdict FROM sc")
def i2_bench_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_verdicts(spark, sf_dir).select("item_id", "policy", "verdict")


@query(f"WITH {S} SELECT item_id, p >= 0.6::DOUBLE OR category = 'unicode_tags' AS flagged FROM s WHERE question = 'override'")
def i3_flag_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).filter("question = 'override'")
    return rows.select("item_id", ((F.col("p") >= 0.6) | (F.col("category") == "unicode_tags")).alias("flagged"))


@query(f"WITH {S}, {POLICIES}, {SCORED} SELECT item_id, policy, CASE WHEN {VERDICT} = 'injection' AND item_id % 2 = 0 AND round(score, 4) < local_block THEN 'suspicious' ELSE {VERDICT} END AS verdict FROM sc")
def i4_local_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.decide(F.col("score"), F.col("block"), F.col("warn"), flags_of(F.col("item_id")))
    mode = F.when(F.col("item_id") % 2 == 0, "local").otherwise("external")
    return scored(spark, sf_dir).select("item_id", "policy", V.local_downgrade(v, mode, F.col("score"), F.col("local_block")).alias("verdict"))


E_SCORE = "(event_id % 97) / 97::DOUBLE"
E_VERDICT = f"CASE WHEN {E_SCORE} >= 0.38::DOUBLE THEN 'injection' WHEN {E_SCORE} >= 0.2::DOUBLE THEN 'suspicious' ELSE 'safe' END"
FINAL = f"CASE WHEN mode = 'local' AND {E_VERDICT} = 'injection' AND round({E_SCORE}, 4) < 0.6::DOUBLE THEN 'suspicious' ELSE {E_VERDICT} END"


def action_sql(closed: str, warn_only: str, block: str) -> str:
    enforce = f"(mode <> 'warn' AND NOT {warn_only})"
    return f"""CASE WHEN mode IS NULL THEN NULL WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 23 = 0 THEN 'passed-released' WHEN event_id % 29 = 0 AND NOT ({closed} AND {enforce}) THEN 'passed-unscanned'
 WHEN event_type = 'error' AND {E_VERDICT} <> 'injection' THEN CASE WHEN {closed} AND {enforce} THEN 'blocked-unavailable' ELSE 'passed-unavailable' END
 WHEN {FINAL} = 'injection' AND {enforce} THEN 'blocked' WHEN event_id % 7 = 0 AND {enforce} AND {block} THEN 'blocked-incomplete' WHEN {FINAL} IN ('injection', 'suspicious') THEN 'flagged' ELSE 'passed' END"""


def acted(spark: SparkSession, sf_dir: str, closed: bool, warn_only: bool, block: bool) -> DataFrame:
    i = F.col("event_id")
    score = (i % 97) / 97
    v = F.when(score >= 0.38, "injection").when(score >= 0.2, "suspicious").otherwise("safe")
    rows = routed(calls(spark, sf_dir))
    return rows.withColumn("action", V.action(F.col("mode"), F.when(i % 10 == 9, 2).otherwise(20), F.lit(0), i % 23 == 0, i % 29 == 0, F.col("event_type") == "error", v, score, F.lit(0.6), i % 7 == 0, F.lit(closed), F.lit(warn_only), F.lit(block)))


@query(f"WITH {C}, m AS (SELECT *, {MODE} AS mode FROM c) SELECT event_id, mode, {action_sql('false', 'false', 'false')} AS action FROM m")
def i5_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acted(spark, sf_dir, False, False, False).select("event_id", "mode", "action")


@query(f"WITH {C}, m AS (SELECT *, {MODE} AS mode FROM c) SELECT event_id, {action_sql('true', 'false', 'true')} AS closed, {action_sql('true', 'true', 'true')} AS warn_only FROM m")
def i6_fail_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results when a failing scanner withholds, and when nothing is enforced."""
    a = acted(spark, sf_dir, True, False, True).select("event_id", F.col("action").alias("closed"))
    return a.join(acted(spark, sf_dir, True, True, True).select("event_id", F.col("action").alias("warn_only")), "event_id")


@query("SELECT user_id, 'suspicious' AS verdict, NULL::DOUBLE AS score, 'not fully scanned: ' || (count(*) - 8) || ' images over the limit of 8' AS reason FROM events GROUP BY user_id HAVING count(*) > 8")
def i8_unscanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with more images than are scanned (here: a user's events): never safe, without a score."""
    counts = tables(spark, sf_dir, "events")["events"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 8").select("user_id", V.over_limit(F.col("n"), 8).alias("v")).select("user_id", "v.*")


@query(f"WITH {POLICIES} SELECT policy AS model, array_to_string(questions, ',') AS questions, agg, block, warn, local_block FROM pol")
def i9_policy_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of each model that has one; asking for another model's is an error (gate.policy_of)."""
    from palisade.operators.gate import policy_of

    rows = [(m, ",".join(p.questions), p.agg, p.block, p.warn, p.local_block) for m in [x[0] for x in V.POLICIES] for p in [policy_of(m)]]
    return spark.createDataFrame(rows, "model string, questions string, agg string, block double, warn double, local_block double")


@query(f"WITH {S}, {POLICIES}, {SCORED}, {THRESHOLD.format(g='policy', t='''(SELECT policy, label, round(score, 9) AS score FROM sc WHERE split = 'dev')''', b='(0.01::DOUBLE), (0.05::DOUBLE)')} SELECT * FROM th")
def i10_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and warn levels of each policy, refitted at 1 % and 5 % of the benign dev rows."""
    return E.thresholds(rounded(scored(spark, sf_dir), "score").filter("split = 'dev'"), ["policy"], [0.01, 0.05])


REASON_MAP = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in V.REASONS.items()) + "}"


@query(f"""WITH {S}, {POLICIES}, {SCORED}, r AS (SELECT sc.item_id, policy, warn, score, list(p ORDER BY list_position(questions, question)) AS ps, any_value(questions) AS qs FROM sc JOIN s ON s.item_id = sc.item_id AND list_contains(questions, question) GROUP BY sc.item_id, policy, warn, score),
x AS (SELECT item_id, policy, list_filter(list_transform(qs, lambda q, i: CASE WHEN ps[i] >= 0.8::DOUBLE THEN {REASON_MAP}[q] END), lambda z: z IS NOT NULL) AS sure, score >= warn AS near, {REASON_MAP}[qs[list_position(ps, list_max(ps))]] AS label, list_max(ps) AS best FROM r)
SELECT item_id, policy, concat_ws('|', CASE WHEN len(sure) > 0 THEN array_to_string(sure, '|') WHEN near THEN 'closest: ' || label || ' (' || printf('%.2f', best) || ')' END,
 CASE item_id % 5 WHEN 0 THEN 'hidden content: unicode_tags' WHEN 2 THEN 'not fully scanned: content longer than the detector''s chunk limit; the rest was not scored' WHEN 4 THEN 'hidden content: zero_width|not fully scanned: image text not read (OCR failed)' END) AS reasons FROM x""")
def e25_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.reasons(F.col("signals"), F.col("questions"), F.col("score"), F.col("warn"), flags_of(F.col("item_id")))
    return scored(spark, sf_dir).select("item_id", "policy", F.array_join(found, "|").alias("reasons"))


@query(None)
def k2_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a paused scanner lets pass, for each user's calls in order: an outage pauses for a
    minute, and a call in a pause is not scanned, so it cannot extend it."""
    from palisade.streaming.state import breaker

    return breaker(tables(spark, sf_dir, "events")["events"].withColumn("outage", F.col("event_type") == "error"), "user_id", 60.0).select("event_id", "user_id", "paused")


@query(f"""WITH {S}, {AGGREGATORS}, {AUC.format(g='name, ordinal', t='''(SELECT * FROM ag WHERE split = 'dev')''')}, b AS (SELECT arg_max(name, (auc, -ordinal)) AS name FROM au),
 {THRESHOLD.format(g='name', t='''(SELECT name, label, score FROM ag WHERE split = 'dev' AND name = (SELECT name FROM b))''', b='(0.02::DOUBLE)')}
SELECT th.name, threshold, {CONFUSION} FROM (SELECT name, label, threshold, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS f FROM ag JOIN th USING (name) WHERE split = 'test') AS th GROUP BY th.name, threshold""")
def m1_fit_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best aggregator on dev, its threshold at a 2 % budget, and what it does on test."""
    rows = E.aggregators(signals(spark, sf_dir), ["item_id", "split", "label"])
    dev = rows.filter("split = 'dev'")
    chosen = E.best(rounded(E.auc(dev, ["name", "ordinal"]), "auc").withColumn("g", F.lit(0)), ["g"]).select("name")
    cut = E.thresholds(dev.join(F.broadcast(chosen), "name"), ["name"], [0.02]).select("name", "threshold")  # one row
    return E.confusion(rows.filter("split = 'test'").join(F.broadcast(cut), "name"), ["name", "threshold"], F.col("score") >= F.col("threshold"))


@query(f"WITH {S}, {POLICIES}, {SCORED}, v AS (SELECT policy, label, {BENCH_VERDICT} AS verdict FROM sc) SELECT policy, label, count(*) FILTER (verdict = 'block') / count(*)::DOUBLE AS blocked, count(*) FILTER (verdict = 'warn') / count(*)::DOUBLE AS flagged, count(*) FILTER (verdict = 'pass') / count(*)::DOUBLE AS passed FROM v GROUP BY 1, 2")
def m2_compare_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bench_verdicts(spark, sf_dir)
    share = lambda v: F.count_if(F.col("verdict") == v) / F.count(F.lit(1))
    return rows.groupBy("policy", "label").agg(share("block").alias("blocked"), share("warn").alias("flagged"), share("pass").alias("passed"))


@query("WITH " + S + f", {POLICIES}, {SCORED}, sl AS (" + " UNION ALL ".join(f"SELECT policy, '{n}' AS slice, label, round(score, 9) AS score FROM sc WHERE ({c})" for n, c in SLICES.items()) + f"), {AUC.format(g='policy, slice', t='sl')} SELECT policy, slice, auc FROM au")
def m3_variants_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in SLICES.items()]))
    rows = rounded(scored(spark, sf_dir), "score").select("policy", F.explode(of).alias("slice"), "label", "score")
    return rounded(E.auc(rows, ["policy", "slice"]), "auc").select("policy", "slice", "auc")
