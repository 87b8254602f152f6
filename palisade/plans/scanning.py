"""Queries on texts and tool calls: words, reveal steps, chunks, routing, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import prompts, reading
from palisade.functions import provenance as P
from palisade.functions import text as X
from palisade.functions.trusted import NOTE
from palisade.operators import chunking, gate
from palisade.plans.inputs import ATTACK, CALLS_SQL, ITEMS_SQL, calls, items, tables
from palisade.plans.registry import query
from palisade.streaming import state

OPAQUE = r"(?:nostr:)?[A-Za-z0-9_\-+/=]{32,}"
I = f"i AS ({ITEMS_SQL})"  # noqa: E741
C = f"c AS ({CALLS_SQL})"
quoted = lambda s: "'" + s.replace("'", "''") + "'"
listed = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"
TAG_CHARS = "[\\x{E0000}-\\x{E007F}]"
Z, B, S = X.ZERO_WIDTH, X.BIDI, X.SOFT_HYPHEN
TAGS_OF = "array_to_string(list_filter(list_transform(regexp_extract_all(text, '" + TAG_CHARS + "'), lambda c: chr(unicode(c) - 917504)), lambda c: regexp_matches(c, '[ -~]')), '')"
UNHIDDEN = "translate(CASE WHEN regexp_matches(text, '" + TAG_CHARS + "') THEN array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) BETWEEN 917504 AND 917631 THEN chr(unicode(c) - 917504) ELSE c END), '') ELSE text END, '" + Z + B + S + "', '')"
NO_SPACE = "[\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"
WORDS = f"(len(regexp_extract_all({UNHIDDEN}, '\\p{{L}}{{2,}}')) + len(regexp_extract_all({UNHIDDEN}, '{NO_SPACE}')))"


@query(f"WITH {I} SELECT item_id, {WORDS}::INT AS n_words FROM i")
def b1_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", X.words(F.col("text")).cast("int").alias("n_words"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '\\p{L}{2,}'))::INT AS n_words FROM conversations WHERE len(regexp_extract_all(text, '\\p{L}{2,}')) >= 3")
def b2_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.words(F.col("text")).cast("int")
    return tables(spark, sf_dir, "conversations")["conversations"].select("conv_id", "turn", n.alias("n_words")).filter("n_words >= 3")


SOURCE = quoted("(?i)" + P.SOURCE_COMMAND)
TRUSTED = f"""(trim(argument) <> '' AND NOT regexp_matches(argument, '\\$\\(|`|<\\(') AND len(list_filter(
  list_transform(string_split_regex(regexp_replace(argument, '\\d*>&\\d+', ' ', 'g'), '&&|\\|\\||[;|&\\n]'), lambda s: regexp_replace(trim(s), '^(?:\\w+=\\S*(?:\\s+|$))+', '')),
  lambda s: NOT (s = '' OR CASE WHEN regexp_extract(string_split_regex(s, '\\s+')[1], '([^/]*)$', 1) = 'git'
    THEN coalesce(list_filter(string_split_regex(s, '\\s+')[2:], lambda w: NOT starts_with(w, '-'))[1], '') IN {listed(P.TRUSTED_GIT)}
    ELSE regexp_extract(string_split_regex(s, '\\s+')[1], '([^/]*)$', 1) IN {listed(P.TRUSTED_COMMANDS)} END))) = 0)"""
MODE = f"""CASE WHEN tool IN {listed(P.SKIPPED)} THEN NULL WHEN tool IN {listed(P.FIRST_PARTY)} THEN 'warn'
  WHEN starts_with(tool, 'mcp_') OR tool IN {listed(P.EXTERNAL)} OR (starts_with(tool, 'browser_') AND NOT contains(tool, 'vault')) THEN 'external'
  WHEN tool = 'terminal' THEN CASE WHEN regexp_matches(argument, {SOURCE}) THEN 'external' WHEN {TRUSTED} THEN 'warn' ELSE 'local' END
  WHEN tool = 'execute_code' THEN CASE WHEN regexp_matches(argument, {SOURCE}) OR regexp_matches(argument, {quoted(P.SOURCE_CODE)}) THEN 'external' ELSE 'local' END
  WHEN tool IN ('process_manage', 'read_file', 'search_files') THEN 'local' ELSE 'other' END"""


def routed(df: DataFrame) -> DataFrame:
    return df.withColumn("mode", P.mode(F.col("tool"), F.col("argument"), F.lit(False), F.lit(False)))


@query(f"WITH {C} SELECT event_id, tool, {MODE} AS mode FROM c")
def b3_route_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(calls(spark, sf_dir)).select("event_id", "tool", "mode")


@query(f"WITH {C} SELECT event_id, regexp_matches(argument, {SOURCE}) AS fetches, regexp_matches(argument, {quoted(P.SOURCE_CODE)}) AS network_code FROM c")
def b4_source_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("argument")
    return calls(spark, sf_dir).select("event_id", P.is_source_command(a).alias("fetches"), a.rlike(P.SOURCE_CODE).alias("network_code"))


@query(f"WITH {C} SELECT event_id, {TRUSTED} AS trusted FROM c")
def b5_trusted_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("event_id", P.is_trusted_command(F.col("argument")).alias("trusted"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents d WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0)")
def b7_resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to score: rows without a good score of the same text. Scores of every fifth row are of an older text."""
    todo = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    scored = todo.filter("doc_id % 3 = 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, "older").otherwise(F.col("sha")))
    return todo.join(scored, ["doc_id", "sha"], "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND NOT doc_id % 5 = 0")
def b8_prune_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id")
    return docs.filter("doc_id % 3 = 0").join(docs.filter("doc_id % 5 = 0"), "doc_id", "left_anti")


@query("SELECT t.doc_id FROM documents t WHERE t.doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 2 = 0 AND d.text = t.text)")
def b9_dev_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows whose text is in the dev split: by digest, so texts are not shuffled."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.filter("doc_id % 2 = 1").join(docs.filter("doc_id % 2 = 0").select("sha").distinct(), "sha", "left_semi").select("doc_id")


@query(f"WITH {I} SELECT item_id FROM i WHERE NOT (item_id % 13 = 0 OR length(text) = 0)")
def b11_error_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", F.when(F.col("item_id") % 13 == 0, "timeout").alias("error"), (F.char_length("text") == 0).alias("unscorable"))
    return rows.filter(~(F.col("error").isNotNull() | F.col("unscorable"))).select("item_id")


@query(f"SELECT page_id, regexp_matches(substring(html, 1, 5000), {quoted(X.HTML_MARK)}) AS is_html FROM pages UNION ALL SELECT -1 - doc_id, regexp_matches(substring(text, 1, 5000), {quoted(X.HTML_MARK)}) FROM documents")
def b12_html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "pages", "documents")
    rows = t["pages"].select("page_id", "html").union(t["documents"].select(-1 - F.col("doc_id"), "text"))
    return rows.select("page_id", X.looks_like_html(F.col("html")).alias("is_html"))


HEADS = ["89504e470d0a", "474946383961", "524946460000", "ffd8ffe00010", "3c68746d6c3e", "ff"]


@query("SELECT event_id, head IN ('89504e47', '47494638', '52494646') OR starts_with(head, 'ffd8') AS is_image FROM (SELECT event_id, substring(CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END, 1, 8) AS head FROM events)")
def b13_image_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("event_id") % 6 + 1).cast("int")))
    return tables(spark, sf_dir, "events")["events"].select("event_id", X.image_kind(data).alias("is_image"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup') AND user_id % 9 <> 0")
def b14_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are scanned: not of a pass-through type, not from an owner."""
    return tables(spark, sf_dir, "events")["events"].filter(~F.col("event_type").isin("error", "signup") & (F.col("user_id") % 9 != 0)).select("event_id")


RELEASED = "sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 17 = 0)"


@query(f"SELECT doc_id, {RELEASED} AS released FROM documents")
def b15_release_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    released = docs.filter("doc_id % 17 = 0").select("sha").distinct().withColumn("released", F.lit(True))
    return docs.join(released, "sha", "left").select("doc_id", F.coalesce("released", F.lit(False)).alias("released"))


ROOTS = ["/tmp/in1.txt", "/tmp/in7.txt", "/srv/spill", "in33.txt"]


@query(f"WITH {C}, r AS (SELECT unnest([{', '.join(map(quoted, ROOTS))}]) AS root) SELECT event_id, bool_or(argument = root OR CASE WHEN starts_with(root, '/') THEN starts_with(argument, root || '/') ELSE ends_with(argument, '/' || root) END) AS external FROM c, r WHERE tool = 'read_file' GROUP BY event_id")
def b16_external_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path is under one of the configured roots."""
    hit = F.exists(F.array(*[F.lit(r) for r in ROOTS]), lambda r: P.under(F.col("argument"), r))
    return calls(spark, sf_dir).filter("tool = 'read_file'").select("event_id", hit.alias("external"))


@query("SELECT doc_id, length(text) > 8 AND length(text) < 500 AS attack_pool, length(text) < 400 AS benign_pool, len(regexp_extract_all(text, '[\\x{0000}-\\x{024F}]')) > 0.97::DOUBLE * length(text) AS latin FROM documents")
def b17_length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    latin = F.regexp_count("text", F.lit(r"[\x{0000}-\x{024F}]")) > F.lit(0.97) * n
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", ((n > 8) & (n < 500)).alias("attack_pool"), (n < 400).alias("benign_pool"), latin.alias("latin"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) END, CASE WHEN o_orderkey % 2 = 0 THEN 'env' END, 'default') AS setting, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END, 1) IN (1, 2) AS switch FROM orders")
def b18_config_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting from the profile, else the environment, else the default; switches from their spellings."""
    k = F.col("o_orderkey")
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("off", "yes", "true", "0")]), (k % 4 + 1).cast("int"))
    switch = F.coalesce(F.when(k % 3 == 0, spelled), F.lit("on")).isin("1", "true", "yes", "on")
    return tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", F.coalesce(F.when(k % 3 == 0, F.lower("o_orderpriority")), F.when(k % 2 == 0, "env"), F.lit("default")).alias("setting"), switch.alias("switch"))


@query(f"""WITH {I}, t AS (SELECT *, {TAGS_OF} AS tags FROM i)
SELECT item_id, concat_ws(',', CASE WHEN trim(tags) <> '' THEN 'unicode_tags' END, CASE WHEN len(regexp_extract_all(text, '[{Z}]')) >= 8 THEN 'zero_width' END, CASE WHEN regexp_matches(text, '[{B}]') THEN 'bidi_override' END) AS flags,
  sha256(translate(regexp_replace(text, '{TAG_CHARS}', '', 'g'), '{Z + B}', '') || CASE WHEN trim(tags) <> '' THEN chr(10) || '[hidden unicode-tag text]: ' || tags ELSE '' END) AS text_sha FROM t""")
def e2_unicode_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return items(spark, sf_dir).select("item_id", F.array_join(X.unicode_flags(t), ",").alias("flags"), F.sha2(X.reveal_unicode(t), 256).alias("text_sha"))


DECODED = "list_filter(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9+/=]+'), lambda b: regexp_matches(b, '^[A-Za-z0-9+/]{{40,}}={{0,2}}$') AND length(rtrim(b, '=')) % 4 <> 1), lambda b: TRY(decode(from_base64(rtrim(b, '=') || repeat('=', ((4 - length(rtrim(b, '=')) % 4) % 4)::INT))))), lambda d: d IS NOT NULL AND length(d) >= 12 AND len(regexp_extract_all(d, '[^\\p{{C}}\\p{{Z}}]|[ \\n\\r\\t]')) > 0.95::DOUBLE * length(d) AND regexp_matches(d, '[A-Za-z]{{3,}}\\s+[A-Za-z]{{2,}}'))"


@query(f"WITH {I} SELECT item_id, array_to_string({DECODED.format('text')}, '|') AS decoded FROM i")
def e4_base64_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.array_join(X.decoded_base64(F.col("text")), "|").alias("decoded"))


@query(f"WITH {I} SELECT item_id, round(len(regexp_extract_all(text, '[^\\p{{C}}\\p{{Z}}]|[ \\n\\r\\t]')) / greatest(length(text), 1)::DOUBLE, 6) AS ratio FROM i")
def e5_printable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.round(X.printable_ratio(F.col("text")), 6).alias("ratio"))


PARTS = "list_filter(string_split_regex(regexp_replace({0}, '^nostr:', ''), '[_\\-+/=.]+'), lambda p: p <> '')"
PLAIN = f"len(list_filter({PARTS}, lambda p: regexp_matches(regexp_replace(p, '^[0-9]+|[0-9]+$', '', 'g'), '^(?:[A-Z]?[a-z]{{{{1,19}}}}|[A-Z]{{{{2,20}}}})$')))"
JOINED = f"(len({PARTS}) >= 3 AND len(regexp_extract_all({{0}}, '[0-9]')) * 10 <= len(regexp_extract_all({{0}}, '[A-Za-z0-9]')) AND {PLAIN} >= 3 AND {PLAIN} >= 0.75::DOUBLE * len({PARTS}))"
TOKENS = f"t AS (SELECT item_id, unnest(regexp_extract_all(text, {quoted(OPAQUE)})) AS token FROM i)"


@query(f"WITH {I}, {TOKENS} SELECT item_id, token, {JOINED.format('token')} AS joined FROM t")
def e6_joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = items(spark, sf_dir).select("item_id", F.explode(X.matches(F.col("text"), X.OPAQUE)).alias("token"))
    return tokens.select("item_id", "token", X.joined_words(F.col("token")).isNotNull().alias("joined"))


SHOWN = f"CASE WHEN {JOINED.format('x')} THEN array_to_string({PARTS.format('x')}, ' ') ELSE '[id:' || length(x) || ']' END"


@query(f"WITH {I}, s AS (SELECT item_id, string_split_regex(text, {quoted(OPAQUE)}) AS a, regexp_extract_all(text, {quoted(OPAQUE)}) AS b FROM i) SELECT item_id, sha256(array_to_string(list_transform(list_zip(a, list_transform(b, lambda x: {SHOWN})), lambda z: z[1] || coalesce(z[2], '')), '')) AS text_sha FROM s")
def e7_collapse_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.sha2(X.collapse_opaque(F.col("text")), 256).alias("text_sha"))


@query(f"WITH {I}, {TOKENS} SELECT item_id, CASE WHEN {JOINED.format('token')} THEN array_to_string({PARTS.format('token')}, ' ') ELSE token END AS restored FROM t")
def e8_restore_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = items(spark, sf_dir).select("item_id", F.explode(X.matches(F.col("text"), X.OPAQUE)).alias("token"))
    return tokens.select("item_id", X.restore_joined(F.col("token")).alias("restored"))


LINES = "unnest(string_split(coalesce(text, ''), chr(10))) AS line"
TOKS = "list_filter(string_split_regex(line, '\\s+'), lambda t: t <> '')"


@query(f"WITH l AS (SELECT doc_id, {LINES} FROM documents), t AS (SELECT doc_id, line, {TOKS} AS toks FROM l), n AS (SELECT doc_id, len(toks) AS n, len(list_filter(toks, lambda t: regexp_matches(t, '^\\p{{L}}+[.,:;!?)]?$'))) AS plain FROM t) SELECT doc_id, count(*) FILTER (plain >= 3 AND plain >= 0.5::DOUBLE * n) AS n_sentences FROM n GROUP BY doc_id")
def e9_natural_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that read as language."""
    lines = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(X.natural_language(F.col("line"))).alias("n_sentences"))


@query("SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS html_sha FROM pages")
def e12_normal_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "pages")["pages"].select("page_id", F.sha2(X.normal_space(F.col("html")), 256).alias("html_sha"))


@query("SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html || '<!-- note ' || page_id || ' -->', '(?s)<!--(.*?)-->', 1), lambda c: trim(c, chr(32) || chr(10) || chr(9) || chr(13))), lambda c: c <> ''), '|') AS comments FROM pages")
def e13_html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat("html", F.lit("<!-- note "), "page_id", F.lit(" -->"))
    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?s)<!--(.*?)-->"), F.lit(1)), chunking.trimmed), lambda c: c != "")
    return tables(spark, sf_dir, "pages")["pages"].select("page_id", F.array_join(found, "|").alias("comments"))


# two blocks for some: both end at the last closing fence, as a heading inside the output cannot end the first
PROMPT = "Daily.\n## Script Output\nUse it.\n\n```\n"
INNER, ENDED = "\n## Script Error\n```\n", "\n```\nThen report."
TWO = "(turn % 2 = 0)"


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as prompts of a scheduled job, some with a second heading in the output, every third with an attack."""
    rows = tables(spark, sf_dir, "conversations")["conversations"]
    attack = F.when(F.col("turn") % 3 == 0, F.lit(f" {ATTACK}")).otherwise("")
    text = F.concat(F.lit(PROMPT), "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(INNER), F.lit("more output here"))).otherwise(""), attack, F.lit(ENDED))
    return rows.withColumn("text", text)


BODY = f"text || CASE WHEN {TWO} THEN {quoted(INNER)} || 'more output here' ELSE '' END || CASE WHEN turn % 3 = 0 THEN ' {ATTACK}' ELSE '' END"


@query(f"SELECT conv_id, turn, 0 AS pos, {BODY} AS body FROM conversations UNION ALL SELECT conv_id, turn, 1, 'more output here' || CASE WHEN turn % 3 = 0 THEN ' {ATTACK}' ELSE '' END FROM conversations WHERE {TWO}")
def e17_cron_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of script blocks: each from its first fence to the last closing one."""
    rows = prompted(spark, sf_dir).select("conv_id", "turn", F.posexplode(prompts.script_blocks("text")).alias("pos", "block"))
    return rows.select("conv_id", "turn", "pos", "block.body")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents d WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0)")
def b7_resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to score: rows without a good score of the same text. Scores of every fifth row are of an older text."""
    todo = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    scored = todo.filter("doc_id % 3 = 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, "older").otherwise(F.col("sha")))
    return todo.join(scored, ["doc_id", "sha"], "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND NOT doc_id % 5 = 0")
def b8_prune_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id")
    return docs.filter("doc_id % 3 = 0").join(docs.filter("doc_id % 5 = 0"), "doc_id", "left_anti")


@query("SELECT t.doc_id FROM documents t WHERE t.doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 2 = 0 AND d.text = t.text)")
def b9_dev_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows whose text is in the dev split: by digest, so texts are not shuffled."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.filter("doc_id % 2 = 1").join(docs.filter("doc_id % 2 = 0").select("sha").distinct(), "sha", "left_semi").select("doc_id")


@query(f"WITH {I} SELECT item_id FROM i WHERE NOT (item_id % 13 = 0 OR length(text) = 0)")
def b11_error_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", F.when(F.col("item_id") % 13 == 0, "timeout").alias("error"), (F.char_length("text") == 0).alias("unscorable"))
    return rows.filter(~(F.col("error").isNotNull() | F.col("unscorable"))).select("item_id")


@query(f"SELECT page_id, regexp_matches(substring(html, 1, 5000), {quoted(X.HTML_MARK)}) AS is_html FROM pages UNION ALL SELECT -1 - doc_id, regexp_matches(substring(text, 1, 5000), {quoted(X.HTML_MARK)}) FROM documents")
def b12_html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "pages", "documents")
    rows = t["pages"].select("page_id", "html").union(t["documents"].select(-1 - F.col("doc_id"), "text"))
    return rows.select("page_id", X.looks_like_html(F.col("html")).alias("is_html"))


HEADS = ["89504e470d0a", "474946383961", "524946460000", "ffd8ffe00010", "3c68746d6c3e", "ff"]


@query("SELECT event_id, head IN ('89504e47', '47494638', '52494646') OR starts_with(head, 'ffd8') AS is_image FROM (SELECT event_id, substring(CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END, 1, 8) AS head FROM events)")
def b13_image_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("event_id") % 6 + 1).cast("int")))
    return tables(spark, sf_dir, "events")["events"].select("event_id", X.image_kind(data).alias("is_image"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup') AND user_id % 9 <> 0")
def b14_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are scanned: not of a pass-through type, not from an owner."""
    return tables(spark, sf_dir, "events")["events"].filter(~F.col("event_type").isin("error", "signup") & (F.col("user_id") % 9 != 0)).select("event_id")


RELEASED = "sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 17 = 0)"


@query(f"SELECT doc_id, {RELEASED} AS released FROM documents")
def b15_release_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    released = docs.filter("doc_id % 17 = 0").select("sha").distinct().withColumn("released", F.lit(True))
    return docs.join(released, "sha", "left").select("doc_id", F.coalesce("released", F.lit(False)).alias("released"))


ROOTS = ["/tmp/in1.txt", "/tmp/in7.txt", "/srv/spill", "in33.txt"]


@query(f"WITH {C}, r AS (SELECT unnest([{', '.join(map(quoted, ROOTS))}]) AS root) SELECT event_id, bool_or(argument = root OR CASE WHEN starts_with(root, '/') THEN starts_with(argument, root || '/') ELSE ends_with(argument, '/' || root) END) AS external FROM c, r WHERE tool = 'read_file' GROUP BY event_id")
def b16_external_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path is under one of the configured roots."""
    hit = F.exists(F.array(*[F.lit(r) for r in ROOTS]), lambda r: P.under(F.col("argument"), r))
    return calls(spark, sf_dir).filter("tool = 'read_file'").select("event_id", hit.alias("external"))


@query("SELECT doc_id, length(text) > 8 AND length(text) < 500 AS attack_pool, length(text) < 400 AS benign_pool, len(regexp_extract_all(text, '[\\x{0000}-\\x{024F}]')) > 0.97::DOUBLE * length(text) AS latin FROM documents")
def b17_length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    latin = F.regexp_count("text", F.lit(r"[\x{0000}-\x{024F}]")) > F.lit(0.97) * n
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", ((n > 8) & (n < 500)).alias("attack_pool"), (n < 400).alias("benign_pool"), latin.alias("latin"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) END, CASE WHEN o_orderkey % 2 = 0 THEN 'env' END, 'default') AS setting, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END, 1) IN (1, 2) AS switch FROM orders")
def b18_config_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting from the profile, else the environment, else the default; switches from their spellings."""
    k = F.col("o_orderkey")
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("off", "yes", "true", "0")]), (k % 4 + 1).cast("int"))
    switch = F.coalesce(F.when(k % 3 == 0, spelled), F.lit("on")).isin("1", "true", "yes", "on")
    return tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", F.coalesce(F.when(k % 3 == 0, F.lower("o_orderpriority")), F.when(k % 2 == 0, "env"), F.lit("default")).alias("setting"), switch.alias("switch"))


@query(f"""WITH {I}, t AS (SELECT *, {TAGS_OF} AS tags FROM i)
SELECT item_id, concat_ws(',', CASE WHEN trim(tags) <> '' THEN 'unicode_tags' END, CASE WHEN len(regexp_extract_all(text, '[{Z}]')) >= 8 THEN 'zero_width' END, CASE WHEN regexp_matches(text, '[{B}]') THEN 'bidi_override' END) AS flags,
  sha256(translate(regexp_replace(text, '{TAG_CHARS}', '', 'g'), '{Z + B}', '') || CASE WHEN trim(tags) <> '' THEN chr(10) || '[hidden unicode-tag text]: ' || tags ELSE '' END) AS text_sha FROM t""")
def e2_unicode_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return items(spark, sf_dir).select("item_id", F.array_join(X.unicode_flags(t), ",").alias("flags"), F.sha2(X.reveal_unicode(t), 256).alias("text_sha"))


DECODED = "list_filter(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9+/=]+'), lambda b: regexp_matches(b, '^[A-Za-z0-9+/]{{40,}}={{0,2}}$') AND length(rtrim(b, '=')) % 4 <> 1), lambda b: TRY(decode(from_base64(rtrim(b, '=') || repeat('=', ((4 - length(rtrim(b, '=')) % 4) % 4)::INT))))), lambda d: d IS NOT NULL AND length(d) >= 12 AND len(regexp_extract_all(d, '[^\\p{{C}}\\p{{Z}}]|[ \\n\\r\\t]')) > 0.95::DOUBLE * length(d) AND regexp_matches(d, '[A-Za-z]{{3,}}\\s+[A-Za-z]{{2,}}'))"


@query(f"WITH {I} SELECT item_id, array_to_string({DECODED.format('text')}, '|') AS decoded FROM i")
def e4_base64_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.array_join(X.decoded_base64(F.col("text")), "|").alias("decoded"))


@query(f"WITH {I} SELECT item_id, round(len(regexp_extract_all(text, '[^\\p{{C}}\\p{{Z}}]|[ \\n\\r\\t]')) / greatest(length(text), 1)::DOUBLE, 6) AS ratio FROM i")
def e5_printable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.round(X.printable_ratio(F.col("text")), 6).alias("ratio"))


PARTS = "list_filter(string_split_regex(regexp_replace({0}, '^nostr:', ''), '[_\\-+/=.]+'), lambda p: p <> '')"
PLAIN = f"len(list_filter({PARTS}, lambda p: regexp_matches(regexp_replace(p, '^[0-9]+|[0-9]+$', '', 'g'), '^(?:[A-Z]?[a-z]{{{{1,19}}}}|[A-Z]{{{{2,20}}}})$')))"
JOINED = f"(len({PARTS}) >= 3 AND len(regexp_extract_all({{0}}, '[0-9]')) * 10 <= len(regexp_extract_all({{0}}, '[A-Za-z0-9]')) AND {PLAIN} >= 3 AND {PLAIN} >= 0.75::DOUBLE * len({PARTS}))"
TOKENS = f"t AS (SELECT item_id, unnest(regexp_extract_all(text, {quoted(OPAQUE)})) AS token FROM i)"


@query(f"WITH {I}, {TOKENS} SELECT item_id, token, {JOINED.format('token')} AS joined FROM t")
def e6_joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = items(spark, sf_dir).select("item_id", F.explode(X.matches(F.col("text"), X.OPAQUE)).alias("token"))
    return tokens.select("item_id", "token", X.joined_words(F.col("token")).isNotNull().alias("joined"))


SHOWN = f"CASE WHEN {JOINED.format('x')} THEN array_to_string({PARTS.format('x')}, ' ') ELSE '[id:' || length(x) || ']' END"


@query(f"WITH {I}, s AS (SELECT item_id, string_split_regex(text, {quoted(OPAQUE)}) AS a, regexp_extract_all(text, {quoted(OPAQUE)}) AS b FROM i) SELECT item_id, sha256(array_to_string(list_transform(list_zip(a, list_transform(b, lambda x: {SHOWN})), lambda z: z[1] || coalesce(z[2], '')), '')) AS text_sha FROM s")
def e7_collapse_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.sha2(X.collapse_opaque(F.col("text")), 256).alias("text_sha"))


@query(f"WITH {I}, {TOKENS} SELECT item_id, CASE WHEN {JOINED.format('token')} THEN array_to_string({PARTS.format('token')}, ' ') ELSE token END AS restored FROM t")
def e8_restore_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = items(spark, sf_dir).select("item_id", F.explode(X.matches(F.col("text"), X.OPAQUE)).alias("token"))
    return tokens.select("item_id", X.restore_joined(F.col("token")).alias("restored"))


LINES = "unnest(string_split(coalesce(text, ''), chr(10))) AS line"
TOKS = "list_filter(string_split_regex(line, '\\s+'), lambda t: t <> '')"


@query(f"WITH l AS (SELECT doc_id, {LINES} FROM documents), t AS (SELECT doc_id, line, {TOKS} AS toks FROM l), n AS (SELECT doc_id, len(toks) AS n, len(list_filter(toks, lambda t: regexp_matches(t, '^\\p{{L}}+[.,:;!?)]?$'))) AS plain FROM t) SELECT doc_id, count(*) FILTER (plain >= 3 AND plain >= 0.5::DOUBLE * n) AS n_sentences FROM n GROUP BY doc_id")
def e9_natural_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that read as language."""
    lines = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(X.natural_language(F.col("line"))).alias("n_sentences"))


@query("SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS html_sha FROM pages")
def e12_normal_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "pages")["pages"].select("page_id", F.sha2(X.normal_space(F.col("html")), 256).alias("html_sha"))


@query("SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html || '<!-- note ' || page_id || ' -->', '(?s)<!--(.*?)-->', 1), lambda c: trim(c, chr(32) || chr(10) || chr(9) || chr(13))), lambda c: c <> ''), '|') AS comments FROM pages")
def e13_html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat("html", F.lit("<!-- note "), "page_id", F.lit(" -->"))
    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?s)<!--(.*?)-->"), F.lit(1)), chunking.trimmed), lambda c: c != "")
    return tables(spark, sf_dir, "pages")["pages"].select("page_id", F.array_join(found, "|").alias("comments"))


FENCED = "## Script Output\nUse it as context.\n\n```\n"


@query(f"SELECT conv_id, turn, regexp_extract({quoted(FENCED)} || text || chr(10) || '```' || chr(10) || 'Then report.', '(?s)## Script (?:Output|Error)\\n.*?```\\n(.*)\\n```\\n', 1) AS body FROM conversations WHERE role = 'user'")
def e17_cron_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of a script block: from its first fence to the last closing one."""
    prompt = F.concat(F.lit(FENCED), "text", F.lit("\n```\nThen report."))
    return tables(spark, sf_dir, "conversations")["conversations"].filter("role = 'user'").select("conv_id", "turn", F.regexp_extract(prompt, r"(?s)## Script (?:Output|Error)\n.*?```\n(.*)\n```\n", 1).alias("body"))


@query("SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'img' || doc_id || '.png' ELSE '' END) AS digest FROM documents")
def e19_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("img"), F.col("doc_id"), F.lit(".png")))).otherwise(F.array().cast("array<string>"))
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", X.content_digest(F.coalesce("text", F.lit("")), images).alias("digest"))


@query(f"""WITH {C}, t AS (SELECT event_id, unnest(list_concat(regexp_extract_all(argument, '(?:^|\\s)(?:-o|-O|--output|--output-document|-P|--directory-prefix)(?:=|\\s+)[''"]?([^\\s''";|&<>]+)', 1), regexp_extract_all(argument, '(?:>>?|\\|\\s*tee(?:\\s+-a)?)\\s*[''"]?([^\\s''";|&<>]+)', 1))) AS path FROM c WHERE {MODE} = 'external')
SELECT event_id, path FROM t WHERE NOT starts_with(path, '/dev/') AND NOT starts_with(path, '&')""")
def e21_written_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routed(calls(spark, sf_dir)).filter("mode = 'external'")
    return rows.select("event_id", F.explode(P.written_paths(F.col("argument"))).alias("path"))


FULL_WIDTH = "".join(c if c == " " else chr(ord(c) + 0xFEE0) for c in ATTACK)
OWN_NOTICE = f'{{"firewall":"blocked","verdict":"injection","score":0.5,"source":"web","reasons":["commands the reader"],"quarantine_id":"fw-20240101-abcdef","note":"{NOTE}"}}'
PAGE = f'<div style="display:none">{ATTACK}</div>'


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, some of them with full-width letters, as a page, with the library's own notice, or in its envelope."""
    i = F.col("item_id") % 13
    whole = (
        F.when(i == 1, F.concat("text", F.lit(" " + FULL_WIDTH)))
        .when(i == 2, F.concat(F.lit("<p>Note "), "item_id", F.lit(f"</p>{PAGE}")))
        .when(i == 3, F.concat("text", F.lit(f" {OWN_NOTICE} end")))
        .when(i == 4, F.concat(F.lit('<untrusted_tool_result source="web">'), "text", F.lit("</untrusted_tool_result>")))
        .otherwise(F.col("text"))
    )
    return items(spark, sf_dir).withColumn("text", whole)


# what is left of each of these before the native steps, and the reading: read AS (item_id, label, text, flags)
READ = f"""t AS (SELECT item_id, label, item_id % 13 AS k, CASE item_id % 13 WHEN 1 THEN text || ' {ATTACK}' WHEN 2 THEN '' WHEN 3 THEN text || '   end' WHEN 4 THEN ' ' || regexp_replace(text, '^[ \t\n\r\f\x0b]+', '') || ' ' ELSE text END AS text FROM i),
r AS (SELECT *, {TAGS_OF} AS tags, translate(regexp_replace(text, '{TAG_CHARS}', '', 'g'), '{Z + B}', '') AS clean FROM t),
d0 AS (SELECT *, CASE WHEN k = 2 THEN 'Note ' || item_id || chr(10) || '[hidden html content]: {ATTACK}' ELSE clean || CASE WHEN trim(tags) <> '' THEN chr(10) || '[hidden unicode-tag text]: ' || tags ELSE '' END END AS body FROM r),
d1 AS (SELECT *, {DECODED.format('body')} AS found FROM d0),
d2 AS (SELECT *, body || array_to_string(list_transform(found, lambda x: chr(10) || '[decoded base64]: ' || x), '') AS whole FROM d1),
d3 AS (SELECT *, string_split_regex(whole, {quoted(OPAQUE)}) AS a, regexp_extract_all(whole, {quoted(OPAQUE)}) AS b FROM d2),
read AS (SELECT item_id, label, array_to_string(list_transform(list_zip(a, list_transform(b, lambda x: {SHOWN})), lambda z: z[1] || coalesce(z[2], '')), '') AS text,
  concat_ws(',', CASE WHEN trim(tags) <> '' THEN 'unicode_tags' END, CASE WHEN len(regexp_extract_all(text, '[{Z}]')) >= 8 THEN 'zero_width' END, CASE WHEN regexp_matches(text, '[{B}]') THEN 'bidi_override' END,
    CASE WHEN k = 2 THEN 'html_hidden_text' END, CASE WHEN len(found) > 0 THEN 'base64_text' END) AS flags FROM d3)"""


@query(f"WITH {I}, {READ} SELECT item_id, sha256(text) AS text_sha, flags FROM read")
def e23_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole reading: first-party texts, invisible characters, composition, HTML, base64, opaque tokens."""
    rows = reading.read(reading.spread(planted(spark, sf_dir)), "text")
    return rows.select("item_id", F.sha2("text", 256).alias("text_sha"), F.array_join("flags", ",").alias("flags"))


def chunk_sql(size: int, overlap: int, most: int | None = None) -> str:
    step = size - overlap
    n = f"CASE WHEN length(t) <= {size} THEN 1 ELSE ceil((length(t) - {size}) / {step}::DOUBLE)::INT + 1 END"
    upto = n if most is None else f"least({n}, {most})"
    return f"SELECT doc_id, {n} AS n_chunks, {'false' if most is None else f'{n} > {most}'} AS truncated, pos::INT AS pos, sha256(substring(t, pos * {step} + 1, {size})) AS chunk_sha FROM (SELECT doc_id, t, unnest(range(0, {upto})) AS pos FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents))"


def chunk_query(spark: SparkSession, sf_dir: str, backend: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.chunks(docs, "text", *chunking.CHUNKS[backend]).select("doc_id", "n_chunks", "truncated", "pos", F.sha2("chunk", 256).alias("chunk_sha"))


@query(chunk_sql(12_000, 400))
def f1_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_query(spark, sf_dir, "jev")


@query(chunk_sql(6_000, 300, 6))
def f3_chunk_semif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_query(spark, sf_dir, "semif")


@query(chunk_sql(1_092, 200, 40))
def f3_chunk_laya(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_query(spark, sf_dir, "laya")


@query("SELECT doc_id, pos::INT AS pos, sha256(substring(t, pos * 400 + 1, 500)) AS window_sha FROM (SELECT doc_id, t, unnest(range(0, least(80, CASE WHEN length(t) <= 500 THEN 1 ELSE ceil(length(t) / 400::DOUBLE)::INT END))) AS pos FROM (SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN ' ' ELSE regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') END AS t FROM documents))")
def f4_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.windows(docs, "text", 500).select("doc_id", "pos", F.sha2("window", 256).alias("window_sha"))


@query("""WITH c AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 12000 THEN 1 ELSE ceil((length(t) - 12000) / 11600::DOUBLE)::INT + 1 END)) AS pos FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)),
k AS (SELECT doc_id, pos, regexp_replace(substring(t, pos * 11600 + 1, 12000), '^\\s+|\\s+$', '', 'g') AS t FROM c WHERE length(substring(t, pos * 11600 + 1, 12000)) > 2000),
p AS (SELECT doc_id, pos, t, unnest(range(0, CASE WHEN length(t) <= 2000 THEN 1 ELSE ceil((length(t) - 2000) / 1800::DOUBLE)::INT + 1 END)) AS piece FROM k)
SELECT doc_id, pos::INT AS chunk_pos, piece::INT AS pos, sha256(substring(t, piece * 1800 + 1, 2000)) AS piece_sha FROM p""")
def f5_retry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of over 2,000 characters that a scorer failed on, in smaller pieces."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    failed = chunking.chunks(docs, "text", *chunking.CHUNKS["jev"]).filter(F.char_length("chunk") > 2_000).select("doc_id", F.col("pos").alias("chunk_pos"), F.col("chunk").alias("part"))
    return chunking.chunks(failed, "part", *chunking.CHUNKS["retry"]).select("doc_id", "chunk_pos", "pos", F.sha2("chunk", 256).alias("piece_sha"))


@query("SELECT user_id, event_id, rn <= 8 AS scanned FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)")
def f6_first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight images of a result are scanned, the rest is flagged."""
    rows = tables(spark, sf_dir, "events")["events"].select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    last = chunking.first_of_group(rows, ["user_id"], ["at"], 8).groupBy("user_id").agg(F.max("at").alias("last"))
    return rows.join(last, "user_id").select("user_id", "event_id", (F.col("at") <= F.col("last")).alias("scanned"))


@query("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn LIMIT 40")
def f8_first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "conversations")["conversations"].select("conv_id", "turn", "text").orderBy("conv_id", "turn").limit(40)


@query("SELECT conv_id, array_to_string(list_transform(list(text ORDER BY turn)[1:5], lambda t: substring(t, 1, 200)), '|') AS revealed FROM conversations GROUP BY conv_id")
def f9_top_revealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = chunking.first_of_group(tables(spark, sf_dir, "conversations")["conversations"], ["conv_id"], ["turn"], 5)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 200).alias("text"))))  # five
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "|").alias("revealed"))


@query("SELECT doc_id FROM (SELECT doc_id, sha256(doc_id || '|7') AS h FROM documents) ORDER BY h LIMIT 100")
def f10_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 in the order of a seeded hash."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.concat("doc_id", F.lit("|7")), 256).alias("h"))
    return docs.orderBy("h").limit(100).select("doc_id")


@query(f"WITH {I} SELECT item_id, CAST(regexp_matches(text, {quoted('(?i)' + X.KEYWORDS)}) AS DOUBLE) AS p FROM i")
def h5_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", X.keyword_score(F.col("text")).alias("p"))


@query(f"""WITH {C}, m AS (SELECT *, {MODE} AS mode, CASE WHEN event_id % 36 = 5 THEN 'curl -s x.test' END AS started_by FROM c), s AS (SELECT session, min(ts) AS since FROM m WHERE mode = 'external' AND tool IN ('terminal', 'execute_code') GROUP BY session)
SELECT event_id, tool, CASE WHEN tool = 'process_manage' AND (coalesce(since < ts, false) OR started_by IS NOT NULL) THEN 'external' ELSE mode END AS mode FROM m LEFT JOIN s USING (session)""")
def c8_background_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output of a background job keeps the mode of the command that started it before."""
    named = F.when(F.col("event_id") % 36 == 5, "curl -s x.test")
    return gate.with_sessions(routed(calls(spark, sf_dir)).withColumn("started_by", named)).select("event_id", "tool", "mode")


@query(f"""WITH {C}, w AS (SELECT user_id, regexp_extract(argument, '-o (\\S+)', 1) AS path, min(ts) AS since FROM c WHERE {MODE} = 'external' AND regexp_matches(argument, '-o \\S+') GROUP BY 1, 2)
SELECT r.event_id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.path = r.argument AND w.since < r.ts) THEN 'external' ELSE 'local' END AS mode FROM c r WHERE r.tool = 'read_file'""")
def k3_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading a file that an earlier fetching command wrote is reading outside content."""
    rows = routed(calls(spark, sf_dir))
    written = rows.filter("mode = 'external'").select("ts", F.explode(P.written_paths(F.col("argument"))).alias("argument")).groupBy("argument").agg(F.min("ts").alias("since"))
    reads = rows.filter("tool = 'read_file'").join(written, "argument", "left")
    return reads.select("event_id", F.when(F.col("since") < F.col("ts"), "external").otherwise("local").alias("mode"))


@query("SELECT props, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY props, event_type")
def k4_log_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row for each body and action: the first."""
    return tables(spark, sf_dir, "events")["events"].groupBy("props", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT digest, count(*) AS uses, CASE WHEN any_value(n) > 2000 THEN count(*) ELSE 1 END AS scored, min(doc_id) AS scored_as FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest, length(text) AS n FROM documents) GROUP BY digest")
def k1_verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents, each scored once; a verdict over part of a content (here: of over 2,000 characters) is not
    used again."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), (F.coalesce(F.char_length("text"), F.lit(0)) <= 2_000).alias("complete"))
    return state.cached(docs, "digest", "complete", "doc_id")
