"""Further joins, ranks and the comparison reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.functions import markup
from palisade.functions import provenance as P
from palisade.functions import text as X
from palisade.operators import evaluation as E
from palisade.plans.evaluating import AUC, BENCH_VERDICT, POLICIES, SCORED, THRESHOLD, S, bench_verdicts, rounded, scored
from palisade.plans.inputs import calls, signals, tables
from palisade.plans.registry import query
from palisade.plans.scanning import MODE, ROOTS, C, quoted


@query(f"WITH {S} SELECT a.item_id, round(abs(a.p - b.p), 9) AS d FROM s a JOIN s b USING (item_id) WHERE a.question = 'override' AND b.question = 'covert'")
def c6_scorer_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers item by item; both come from one pass over the signals."""
    rows = signals(spark, sf_dir).filter("question IN ('override', 'covert')").groupBy("item_id")
    of = lambda q: F.max(F.when(F.col("question") == q, F.col("p")))
    return rows.agg(F.round(F.abs(of("override") - of("covert")), 9).alias("d"))


@query(f"WITH {C}, r AS (SELECT unnest([{', '.join(map(quoted, ROOTS))}]) AS root) SELECT event_id, root FROM c, r WHERE tool = 'read_file' AND (argument = root OR CASE WHEN starts_with(root, '/') THEN starts_with(argument, root || '/') ELSE ends_with(argument, '/' || root) END)")
def c10_paths_under_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with the configured roots that they are under."""
    roots = F.filter(F.array(*[F.lit(r) for r in ROOTS]), lambda r: P.under(F.col("argument"), r))
    return calls(spark, sf_dir).filter("tool = 'read_file'").select("event_id", F.explode(roots).alias("root"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def d17_distinct_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parts of each conversation in the order in which they come first."""
    firsts = tables(spark, sf_dir, "conversations")["conversations"].groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    parts = F.array_sort(F.collect_list(F.struct("first", "role")))  # a row for each role
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["role"]), ",").alias("roles"))


@query(f"WITH {S} SELECT question, item_id, avg(rn) OVER (PARTITION BY question, p) AS mean_rank FROM (SELECT question, item_id, p, row_number() OVER (PARTITION BY question ORDER BY p) AS rn FROM s)")
def f2_mean_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks with the mean of ties, from the counts of distinct scores."""
    return E.mean_ranks(signals(spark, sf_dir).select("question", "item_id", "p"), ["question"], "p").select("question", "item_id", "mean_rank")


@query("SELECT page_id, 'send the note ' || chr(97 + (page_id % 26)::INT) || chr(97 + (page_id % 26)::INT) || ' to me | and a comment here' AS text FROM pages")
def e14_script_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and comments of scripts that read as language."""
    pages = tables(spark, sf_dir, "pages")["pages"]
    letter = F.chr(97 + F.col("page_id") % 26)
    html = F.concat(F.lit('<script>var a = "send the note '), letter, letter, F.lit(' to me"; var b = "x-1-y-2-z-3"; // and a comment here\n</script>'))
    return pages.select("page_id", F.replace(markup.html_text(html)["text"], F.lit("[script/style text]: "), F.lit("")).alias("text"))


@query(f"WITH {S}, {AUC.format(g='split, question', t='(SELECT split, question, label, p AS score FROM s)')}, {THRESHOLD.format(g='question', t='''(SELECT question, label, p AS score FROM s WHERE split = 'dev')''', b='(0.02::DOUBLE)')} SELECT question, max(auc) FILTER (split = 'dev') AS dev_auc, max(auc) FILTER (split = 'test') AS test_auc, max(threshold) AS threshold FROM au JOIN th USING (question) GROUP BY question")
def m4_question_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question alone: AUC on both splits, and its threshold."""
    rows = signals(spark, sf_dir)
    found = rounded(E.auc(rows, ["question", "split"], "p"), "auc").groupBy("question")
    of = lambda s: F.max(F.when(F.col("split") == s, F.col("auc"))).alias(f"{s}_auc")
    return found.agg(of("dev"), of("test")).join(E.thresholds(rows.filter("split = 'dev'"), ["question"], [0.02], "p").select("question", "threshold"), "question")


@query(f"""WITH {S}, {POLICIES}, {SCORED}, r AS (SELECT policy, split, label, round(score, 9) AS score, block FROM sc), {THRESHOLD.format(g='policy', t='''(SELECT policy, label, score FROM r WHERE split = 'dev')''', b='(0.01::DOUBLE)')}
SELECT policy, level, sum(label * f) / nullif(sum(label), 0)::DOUBLE AS tpr, sum((1 - label) * f) / nullif(sum(1 - label), 0)::DOUBLE AS fpr
FROM (SELECT policy, label, level, CASE WHEN score >= CASE level WHEN 'shipped' THEN block ELSE threshold END THEN 1 ELSE 0 END AS f FROM r JOIN th USING (policy) CROSS JOIN (VALUES ('shipped'), ('refit')) AS l(level) WHERE split = 'test') GROUP BY policy, level""")
def m5_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy at its shipped block level and at a refitted one."""
    rows = rounded(scored(spark, sf_dir), "score").select("policy", "split", "label", "score", "block")
    refit = E.thresholds(rows.filter("split = 'dev'"), ["policy"], [0.01]).select("policy", "threshold")
    test = rows.filter("split = 'test'").join(F.broadcast(refit), "policy")  # a row for each policy
    test = test.select("policy", "label", "score", F.explode(F.create_map(F.lit("shipped"), F.col("block"), F.lit("refit"), F.col("threshold"))).alias("level", "at"))
    return E.confusion(test, ["policy", "level"], F.col("score") >= F.col("at")).select("policy", "level", "tpr", "fpr")


@query(f"WITH {S}, {POLICIES}, {SCORED}, v AS (SELECT policy, split, label, {BENCH_VERDICT} AS verdict FROM sc) SELECT policy, count(*) FILTER (label = 1 AND verdict = 'block') AS caught, count(*) FILTER (label = 1 AND verdict = 'pass') AS missed, count(*) FILTER (label = 0 AND verdict = 'block') AS wrong, count(*) AS n FROM v WHERE split = 'test' GROUP BY policy")
def m6_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bench_verdicts(spark, sf_dir).filter("split = 'test'").groupBy("policy")
    n = lambda label, v: F.count_if((F.col("label") == label) & (F.col("verdict") == v))
    return rows.agg(n(1, "block").alias("caught"), n(1, "pass").alias("missed"), n(0, "block").alias("wrong"), F.count(F.lit(1)).alias("n"))


@query(None)
def m7_window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword baseline over windows of several sizes: how many documents it hits, and windows read."""
    from palisade.operators import chunking
    from palisade.plans.inputs import items

    rows = items(spark, sf_dir).select("item_id", "text")
    sizes = [chunking.windows(rows, "text", n).select("item_id", F.lit(str(n)).alias("size"), "window") for n in (300, 600, 1200)]
    every = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(chunking.sentences(rows, "text").select("item_id", F.lit("sent").alias("size"), "window"))
    hits = every.groupBy("size", "item_id").agg(F.max(X.keyword_score(F.col("window"))).alias("p"), F.count(F.lit(1)).alias("n"))
    return hits.groupBy("size").agg(F.count_if(F.col("p") > 0).alias("hit"), F.sum("n").alias("windows"))
