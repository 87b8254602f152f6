"""From what came in to what may pass: tool results, prompts of scheduled jobs, and chat messages.

Contents are read and scored once for each digest, whatever the number of rows that have them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import prompts, reading
from palisade.functions import text as X
from palisade.functions import verdict as V
from palisade.functions.trusted import notice
from palisade.operators import chunking, scoring


@dataclass(frozen=True)
class Policy:
    questions: tuple[str, ...]
    agg: str
    block: float
    warn: float
    local_block: float | None = None


KEYWORDS = Policy(("keywords",), "max", 0.9, 0.7)


def policy_of(model: str) -> Policy:
    """The shipped policy of a model; a model without one is an error, never scored under another's levels."""
    for name, questions, agg, block, warn, local_block in V.POLICIES:
        if name == model:
            return Policy(tuple(questions), agg, block, warn, local_block)
    raise ValueError(f"there is no policy for {model!r}")


@dataclass(frozen=True)
class Settings:
    """closed: what could not be scored is withheld; warn_only: nothing is; block_incomplete: so is what was
    read in part."""

    closed: bool = False
    warn_only: bool = False
    block_incomplete: bool = False
    least_words: int = 3


def digest_of(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))  # never null, or joins by it would test the whole reading once more


def judged(rows: DataFrame, text: str, detector: str = "keywords", policy: Policy = KEYWORDS, chunks: str = "retry", released: DataFrame | None = None) -> DataFrame:
    """rows with digest, chars and words of the reading of `text`, flags, signals, score, verdict, reasons, failed,
    outage and complete; with `released` (digests), whether it is one of them. A text of too few words to say anything
    is scored like any other; blank ones have no signals.

    Each distinct text is read once, and each distinct reading scored once; rows meet the verdicts by the digest of
    their text, and are not read themselves."""
    rows = rows.withColumn("_raw", digest_of(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    texts = rows.groupBy("_raw").agg(F.first(text).alias("_text"))
    found = reading.read(texts, "_text", "read", "flags").drop("_text").withColumn("digest", digest_of(F.col("read")))
    found = found.repartition("_raw")  # the two uses below take the same columns of it, so it is computed once
    distinct = found.groupBy("digest").agg(F.first(F.struct("read", "_raw", "flags")).alias("one")).select("digest", "one.read")
    cut = chunking.chunks(distinct, "read", *chunking.CHUNKS[chunks]).select("digest", "pos", "chunk", F.col("truncated").alias("cut_off"))
    scored = scoring.merged(scoring.score_chunks(cut, "chunk", detector), "digest", "cut_off")
    found = found.withColumn("chars", F.char_length("read")).withColumn("words", X.words(F.col("read"))).drop("read").join(scored, "digest")
    if released is not None:
        passing = released.select(F.coalesce("digest", F.lit("")).alias("digest")).distinct().withColumn("released", F.lit(True))
        found = found.join(passing, "digest", "left").withColumn("released", F.coalesce("released", F.lit(False)))
    more = F.array_compact(F.array(F.when(F.col("cut_off"), "scan_truncated"), F.when(F.col("failed_chunks") > 0, "scan_incomplete")))
    found = found.withColumn("flags", F.concat("flags", more))
    questions = F.array(*[F.lit(q) for q in policy.questions])
    found = found.withColumn("score", V.policy_score(F.coalesce("signals", F.create_map().cast("map<string,double>")), questions, F.lit(policy.agg)))
    found = found.withColumn("verdict", V.decide(F.col("score"), F.lit(policy.block), F.lit(policy.warn), F.col("flags")))
    found = found.withColumn("reasons", V.reasons(F.col("signals"), questions, F.col("score"), F.lit(policy.warn), F.col("flags")))
    found = found.withColumn("failed", F.col("failed_chunks") == F.col("n_chunks")).withColumn("complete", ~V.has_any(F.col("flags"), list(V.INCOMPLETE))).drop("failed_chunks", "cut_off")
    return rows.drop(*[c for c in found.columns if c != "_raw"]).join(found, "_raw").drop("_raw")


def quarantine_id(day: Column, digest: Column) -> Column:
    return F.concat(F.lit("fw-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.substring(digest, 1, 6))


def scan_results(results: DataFrame, released: DataFrame, detector: str = "keywords", policy: Policy = KEYWORDS, settings: Settings = Settings()) -> DataFrame:
    """What happens to each tool result (tool, mode, text, ts, paused): results with action, quarantine_id, passed (the
    text that goes on: the result, or the notice in its place) and audit (the row of the scan log, as JSON without
    nulls; null where there is none). Results of a null mode are not read.

    released: the digests that are let pass."""
    skipped = results.filter("mode IS NULL").select("*", F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("quarantine_id"), F.col("text").alias("passed"), F.lit(None).cast("string").alias("audit"))
    rows = judged(results.filter("mode IS NOT NULL"), "text", detector, policy, released=released)
    return acted(rows, policy, settings).select(*results.columns, *ACTED).unionByName(skipped)


def scan_contents(calls: DataFrame, contents: DataFrame, key: str, released: DataFrame, detector: str = "keywords", policy: Policy = KEYWORDS, settings: Settings = Settings()) -> DataFrame:
    """The same for tool calls (key, tool, mode, ts, paused) whose results are kept once, in contents (key, text): a
    row for each call and content of a key, with its text. All contents are judged, and verdicts meet the calls by
    key, so texts are neither digested nor shuffled for each call."""
    found = judged(contents.select(key, "text"), "text", detector, policy, released=released)
    return acted(calls.join(found, key), policy, settings).select(*calls.columns, "text", *ACTED)


ACTED = ["action", "quarantine_id", "passed", "audit"]


def acted(rows: DataFrame, policy: Policy, settings: Settings) -> DataFrame:
    """Judged results (tool, mode, text, ts, paused) with the columns ACTED; null modes pass without a record."""
    level = F.lit(policy.local_block).cast("double")
    act = V.action(
        F.col("mode"), F.col("words"), F.lit(0), F.col("released"), F.col("paused"), F.col("failed"), F.col("verdict"), F.col("score"), level,
        ~F.col("complete"), F.lit(settings.closed), F.lit(settings.warn_only), F.lit(settings.block_incomplete), settings.least_words,
    )
    rows = rows.withColumn("action", act)
    blocked = F.col("action").startswith("blocked")
    said = F.when(F.col("action") == "blocked-unavailable", "unavailable").when(F.col("action") == "blocked-incomplete", "incomplete").otherwise(V.local_downgrade(F.col("verdict"), F.col("mode"), F.col("score"), level))
    rows = rows.withColumn("said", said).withColumn("quarantine_id", F.when(F.col("action").isin("blocked", "blocked-incomplete"), quarantine_id(F.col("ts"), F.col("digest"))))
    left = notice(F.col("tool"), F.col("said"), F.round("score", 4), F.col("reasons"), F.col("quarantine_id"))
    rows = rows.withColumn("passed", F.when(blocked, left).otherwise(F.col("text")))
    scanned = ~F.col("action").isin("passed-released", "passed-unscanned")
    log = F.to_json(F.struct(
        "tool", "mode", "chars", "action", F.when(scanned, F.col("said")).alias("verdict"), F.when(scanned, F.round("score", 4)).alias("score"),
        F.when(scanned & (F.size("reasons") > 0), F.col("reasons")).alias("reasons"), F.when(scanned, F.col("complete")).alias("complete"), "quarantine_id",
    ))
    return rows.withColumn("audit", F.when(F.col("action").isNotNull(), log))


def cron_verdict(verdict: Column, failed: Column) -> Column:
    return F.when(failed & (verdict != "injection"), "unavailable").otherwise(verdict)


def cron_blocks(said: Column, settings: Settings) -> Column:
    """Whether script output with this verdict is withheld; what could not be scored is where failing closes."""
    return ((said == "injection") | ((said == "unavailable") & F.lit(settings.closed))) & F.lit(not settings.warn_only)


def released_at(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows (digest, ts) with `released`: whether their content was on the list (digest, released_at) by then."""
    since = listed.groupBy("digest").agg(F.min("released_at").alias("since"))
    return rows.join(since, "digest", "left").withColumn("released", F.coalesce(F.col("since") < F.col("ts"), F.lit(False))).drop("since")


def scan_prompts(messages: DataFrame, key: list[str], detector: str = "keywords", policy: Policy = KEYWORDS, settings: Settings = Settings()) -> DataFrame:
    """messages (role, text) with `passed`: the prompt of a user, without the script blocks that are an injection or
    could not be scored; other messages as they are. key names a message."""
    users = messages.filter("role = 'user'")
    blocks = users.select(*key, F.explode(prompts.script_blocks("text")).alias("block")).select(*key, "block.*")
    found = judged(blocks, "body", detector, policy).withColumn("said", cron_verdict(F.col("verdict"), F.col("failed")))
    why = F.when(F.col("said") == "unavailable", F.array(F.lit("firewall unreachable"))).otherwise(F.col("reasons"))
    left = notice(F.lit("cron_script"), F.col("said"), F.round("score", 4), why, F.lit(None).cast("string"))
    gone = (F.col("words") >= settings.least_words) & cron_blocks(F.col("said"), settings)
    # the blocks of one prompt; chosen here and not by a filter, which would be pushed below the reading and repeat it
    lists = found.groupBy(*key).agg(F.collect_list(F.when(gone, F.struct("start", "stop", left.alias("notice")))).alias("withheld"))
    rows = messages.join(lists, key, "left")
    return rows.withColumn("passed", F.when(F.size("withheld") > 0, prompts.without_blocks("text", "withheld")).otherwise(F.col("text"))).drop("withheld")


def scan_messages(events: DataFrame, owners: list[str], detector: str = "keywords", policy: Policy = KEYWORDS, settings: Settings = Settings()) -> DataFrame:
    """Chat events (user_id, who, text, reply_to) with `passed`: the text, or what says that it was withheld. Owners'
    messages, short ones, and those that cannot be scored pass."""
    whole = F.concat_ws("\n", F.when(F.col("text") != "", F.col("text")), F.when(F.col("reply_to") != "", F.col("reply_to")))
    rows = judged(events.withColumn("whole", whole), "whole", detector, policy)
    theirs = ~F.col("user_id").cast("string").isin(owners) if owners else F.lit(True)
    withheld = theirs & (F.col("words") >= settings.least_words) & (F.col("verdict") == "injection") & F.lit(not settings.warn_only)
    return rows.select(*events.columns, F.when(withheld, prompts.gateway_text(F.coalesce("who", F.col("user_id").cast("string")), F.col("reasons"))).otherwise(F.col("text")).alias("passed"))


def with_sessions(calls: DataFrame) -> DataFrame:
    """Calls (tool, mode, session, ts, started_by: the command that a result names) with the mode of what started a
    background job: its output is from outside if a fetching command had started that session before, or if the
    result names one."""
    from palisade.functions.provenance import is_source_command

    starts = calls.filter(F.col("tool").isin("terminal", "execute_code") & (F.col("mode") == "external")).groupBy("session").agg(F.min("ts").alias("since"))
    rows = calls.join(starts, "session", "left")
    outside = (F.col("since") < F.col("ts")) | is_source_command(F.coalesce("started_by", F.lit("")))
    return rows.withColumn("mode", F.when((F.col("tool") == "process_manage") & outside, "external").otherwise(F.col("mode"))).drop("since")
