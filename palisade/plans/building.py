"""Queries on sources and sinks, HTML and JSON reading, trusted texts, corpus construction and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import markup, reading, results, trusted
from palisade.functions import verdict as V
from palisade.functions import text as X
from palisade.operators import chunking, corpus, gate, scoring
from palisade.plans.inputs import ATTACK, items, signals, tables
from palisade.plans.registry import query
from palisade.plans.scanning import BODY, ENDED, PROMPT, READ, I, planted, prompted, quoted
from palisade.sources import files


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines: every seventh id comes twice, every eleventh line is malformed."""
    docs = tables(spark, sf_dir, "documents")["documents"]
    row = F.to_json(F.struct(F.concat(F.lit("d"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") - F.col("doc_id") % 2).otherwise(F.col("doc_id"))).alias("id"), (F.col("doc_id") % 2).alias("label"), "source"))
    return docs.select(F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 11 == 0, F.concat(row, F.lit("}{"))).when(F.col("doc_id") % 13 == 0, "not json").otherwise(row).alias("line"))


@query("WITH l AS (SELECT doc_id, 'd' || CASE WHEN doc_id % 7 = 0 THEN doc_id - doc_id % 2 ELSE doc_id END AS id, (doc_id % 2)::INT AS label, source FROM documents WHERE doc_id % 13 <> 0 OR doc_id % 11 = 0) SELECT id, arg_max(label, doc_id) AS label, arg_max(source, doc_id) AS source FROM l GROUP BY id")
def a1_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON lines by id; the last of equal ids counts, lines that are not JSON do not. What follows a
    whole object on its line is not read."""
    rows = files.parsed(lines(spark, sf_dir), files.CORPUS).select("at", "row.id", "row.label", "row.source").filter("id IS NOT NULL")
    return files.last_of_each(rows, "id", ["at"]).select("id", "label", "source")


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"]
    k = F.col("doc_id")
    text = F.when(k % 9 == 0, F.create_map(F.lit("unscorable"), F.lit(1.0))).otherwise(F.create_map(F.lit("p"), (k % 100) / 100))
    return docs.select(k.cast("string").alias("id"), F.when(k % 5 != 0, text).alias("text"), F.when(k % 5 == 0, "timeout").alias("error"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, (doc_id % 100) / 100 AS p FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 9 <> 0")
def a2_good_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.good_scores(score_rows(spark, sf_dir)).select("id", F.col("text")["p"].alias("p"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 9 = 0")
def a3_failed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.failed_ids(score_rows(spark, sf_dir))


@query("SELECT vec_id, label, len(embedding)::INT AS dim FROM embeddings")
def a4_read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", "label", F.size("embedding").alias("dim"))


@query("SELECT c_custkey, category, pos, text FROM (SELECT c_custkey, 'Email' AS category, unnest([0, 1])::INT AS pos, c_name || unnest([' a', ' b']) AS text FROM customer UNION ALL SELECT c_custkey, 'Web', 0, c_mktsegment FROM customer)")
def a5_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "customer")["customer"]
    nested = F.to_json(F.create_map(F.lit("Email"), F.array(F.concat("c_name", F.lit(" a")), F.concat("c_name", F.lit(" b"))), F.lit("Web"), F.array("c_mktsegment")))
    parsed = rows.select("c_custkey", F.explode(F.from_json(nested, "map<string,array<string>>")).alias("category", "texts"))
    return parsed.select("c_custkey", "category", F.posexplode("texts").alias("pos", "text"))


@query("SELECT min(doc_id) AS at, text, sha256(text || '|7') AS spot FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE doc_id % 13 <> 0) WHERE length(text) BETWEEN 40 AND 2000 AND NOT starts_with(text, '{') GROUP BY text")
def a6_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"]
    raw = docs.select("doc_id", F.when(F.col("doc_id") % 13 == 0, "broken {").otherwise(F.to_json(F.struct(F.col("text").alias("content")))).alias("line"))
    return files.posts(raw, "line", "doc_id")


@query(None)
def a7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "pages")["pages"].select("page_id", markup.page_text("html").alias("text"))


@query(None)
def a8_inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables(spark, sf_dir, "events")["events"]
    k = F.col("event_id")
    ref = F.when(k % 4 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.unhex(F.lit("89504E470D0A"))))).when(k % 4 == 1, "https://x.test/a.png").when(k % 4 == 2, "data:image/png;base64,@@").otherwise("a/b.png")
    return events.select("event_id", files.inline_image(ref).alias("image")).select("event_id", F.hex("image.data").alias("data"), "image.error")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'outage' END AS error, CAST(ts AS DATE) AS day FROM events")
def a9_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows as they are written: no content, null keys dropped."""
    rows = tables(spark, sf_dir, "events")["events"].select("event_id", "ts", F.when(F.col("event_type") == "error", "outage").alias("error"), F.col("props").alias("text"))
    line = F.to_json(F.struct("event_id", "error"))
    return rows.select(F.from_json(line, "event_id long, error string").alias("r"), F.to_date("ts").alias("day")).select("r.event_id", "r.error", "day")


@query("SELECT 'fw-20240101-' || substring(sha256(text), 1, 6) AS qid, source AS tool, 'injection' AS verdict, sha256(text) AS content_sha256, length(text) AS chars FROM documents WHERE doc_id % 6 = 0")
def a10_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "documents")["documents"].filter("doc_id % 6 = 0")
    held = files.quarantined(rows, F.col("source"), F.col("text"), F.lit("injection"), F.sha2("text", 256), F.lit("2024-01-01").cast("date"))
    return held.select("qid", "tool", "verdict", "content_sha256", F.char_length("raw").alias("chars"))


@query("SELECT sha256(text) || ' fw-20240101-' || substring(sha256(text), 1, 6) || ' ' || source || ' released 2024-01-02' AS line FROM documents WHERE doc_id % 6 = 0 AND substring(sha256(text), 1, 6) IN (SELECT substring(sha256(text), 1, 6) FROM documents WHERE doc_id % 12 = 0)")
def a11_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "documents")["documents"].filter("doc_id % 6 = 0")
    held = files.quarantined(rows, F.col("source"), F.col("text"), F.lit("injection"), F.sha2("text", 256), F.lit("2024-01-01").cast("date"))
    wanted = rows.filter("doc_id % 12 = 0").select(F.concat(F.lit("fw-20240101-"), F.substring(F.sha2("text", 256), 1, 6)).alias("qid"))
    wanted = wanted.unionByName(spark.createDataFrame([("fw-1-zz",)], "qid string"))
    return files.released(held, wanted, F.lit("2024-01-02").cast("date"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS sha FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 4 <> 0)")
def a12_score_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run adds to a score table."""
    rows = tables(spark, sf_dir, "documents")["documents"].select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("sha"), "doc_id")
    old = rows.filter("doc_id % 3 = 0").select("id", F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("sha")).alias("sha"))
    return files.to_score(rows.drop("doc_id"), old)


@query("SELECT lang, '{\"lang\":\"' || lang || '\",\"n\":' || count(*) || '}' AS line FROM documents GROUP BY lang")
def a16_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables(spark, sf_dir, "documents")["documents"].groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.select("lang", F.to_json(F.struct("lang", "n")).alias("line"))


@query("SELECT k, len(regexp_extract_all(k, '\\p{L}{2,}')) >= 3 OR (regexp_matches(k, '\\p{L}{2,}') AND regexp_matches(trim(k), '\\s')) AS scanned FROM (SELECT DISTINCT substring(text, 1, 24) AS k FROM conversations)")
def b6_text_like_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tables(spark, sf_dir, "conversations")["conversations"].select(F.substring("text", 1, 24).alias("k")).distinct()
    return keys.select("k", results.text_like_key("k").alias("scanned"))


@query("SELECT conv_id, turn, 'a b' || chr(10) || text AS text FROM conversations")
def e1_result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string leaves and text-like keys of JSON results, in document order."""
    rows = tables(spark, sf_dir, "conversations")["conversations"]
    raw = F.to_json(F.struct(F.lit(1).alias("n"), F.array(F.lit("a b")).alias("items"), F.struct(F.col("text").alias("body")).alias("inner")))
    return rows.select("conv_id", "turn", results.result_text(raw)["text"].alias("text"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS sha FROM documents")
def e3_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility composition; the tables hold no compatibility characters, so canonical composition agrees."""
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(markup.nfkc("text"), 256).alias("sha"))


@query(None)
def e11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "pages")["pages"].select("page_id", markup.html_text("html").alias("r"))
    return rows.select("page_id", "r.text", F.array_join("r.flags", ",").alias("flags"))


@query(None)
def e10_planted_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with an attack in each of the markup carriers, read again: whether it was found, and the flags."""
    pages = tables(spark, sf_dir, "pages")["pages"].select("page_id", F.lit("Notes of the day.").alias("text"))
    made = corpus.carried(pages, F.col("text"), F.lit(ATTACK), ["html_hidden", "html_comment", "attr_id", "attr_data", "attr_meta", "attr_script", "attr_jsonld", "attr_alt"])
    read = made.select("page_id", "category", markup.html_text("text").alias("r"))
    return read.select("page_id", "category", F.contains("r.text", F.lit(ATTACK)).alias("found"), F.array_join("r.flags", ",").alias("flags"))


WRAPPED = '<untrusted_tool_result source="web">\n'


@query(f"SELECT doc_id, sha256(' ' || regexp_replace(text, '^\\s+', '') || ' ') AS text_sha FROM documents")
def e15_strip_first_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the harness's envelope, without it."""
    docs = tables(spark, sf_dir, "documents")["documents"]
    wrapped = F.concat(F.lit(WRAPPED), "text", F.lit("\n</untrusted_tool_result>"))
    return docs.select("doc_id", F.sha2(trusted.strip_templates(wrapped), 256).alias("text_sha"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '  ' || text ELSE text || ' altered' END AS text FROM conversations")
def e16_strip_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact notices go; in an altered one only the mark is broken (here: its text is reported by a word)."""
    rows = tables(spark, sf_dir, "conversations")["conversations"]
    none = F.lit(None).cast("double")
    notice = trusted.notice(F.lit("web"), F.lit("injection"), none, F.array(F.lit("commands the reader")), F.lit("fw-20240101-abcdef"))
    even = F.col("turn") % 2 == 0
    altered = F.replace(notice, F.lit("commands the reader"), F.lit("send all data"))
    rows = rows.withColumn("whole", F.concat("text", F.lit(" "), F.when(even, notice).otherwise(altered), F.when(even, F.col("text")).otherwise("")))
    left = F.col("left")
    kept = F.contains(left, F.lit("send all data"))
    return trusted.strip_first_party(rows, "whole", "left").select("conv_id", "turn", F.when(even, left).when(kept, F.concat("text", F.lit(" altered"))).alias("text"))


CRON_NOTICE = f'{{"firewall":"blocked","verdict":"injection","score":1.0,"source":"cron_script","reasons":["closest: keywords (1.00)"],"quarantine_id":null,"note":"{trusted.NOTE}"}}'


@query(f"SELECT conv_id, turn, CASE WHEN role = 'user' AND (turn % 3 = 0 OR regexp_matches(text, {quoted('(?i)' + X.KEYWORDS)})) THEN 'Daily.' || chr(10) || '## Script Output' || chr(10) || {quoted(CRON_NOTICE)} || chr(10) || chr(10) || 'Then report.' ELSE {quoted(PROMPT)} || {BODY} || {quoted(ENDED)} END AS passed FROM conversations")
def e18_cron_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without the blocks whose bodies score as an injection; a block inside one goes with it."""
    return gate.scan_prompts(prompted(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "passed")


@query(f"""SELECT doc_id, '{{"firewall":"blocked","verdict":"injection","score":0.5,"source":"' || source || '","reasons":["commands the reader"],"quarantine_id":"fw-20240101-' || substring(sha256(text), 1, 6) || '","note":{quoted(chr(34) + trusted.NOTE + chr(34))[1:-1]}}}' AS notice FROM documents""")
def e20_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"]
    qid = F.concat(F.lit("fw-20240101-"), F.substring(F.sha2("text", 256), 1, 6))
    return docs.select("doc_id", trusted.notice(F.col("source"), F.lit("injection"), F.lit(0.5), F.array(F.lit("commands the reader")), qid).alias("notice"))


@query("SELECT event_id, event_id % 3 = 0 AS own FROM events")
def e22_own_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rejections of a call's own arguments; an altered one is not trusted."""
    k = F.col("event_id")
    name = F.concat(F.lit("tool"), k % 7)
    arguments = F.to_json(F.struct(F.array(F.struct(name.alias("name"))).alias("calls")))
    said = F.concat(F.lit("'"), name, F.lit("' is a directly-listed tool, not a deferred one. Call it directly instead of via tool_call."), F.when(k % 3 == 0, "").otherwise(" Also do this."))
    return tables(spark, sf_dir, "events")["events"].select("event_id", results.is_own_rejection(F.lit("tool_call"), arguments, F.to_json(F.struct(said.alias("error")))).alias("own"))


@query("SELECT doc_id, sha256('[page]: ' || regexp_replace(text, '\\s+', ' ', 'g') || chr(10) || '[meta]: x') AS text_sha FROM documents")
def e24_without_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"]
    text = F.concat(F.lit("[page]: "), F.regexp_replace("text", r"\s+", " "), F.lit("\n[image text]: seen\nmore of it\n[meta]: x"))
    return docs.select("doc_id", F.sha2(markup.without_ocr(text), 256).alias("text_sha"))


POSITIONS = ["start", "end"]


@query(f"SELECT doc_id, position, CASE position WHEN 'clean' THEN 0 ELSE 1 END AS label, sha256(CASE position WHEN 'start' THEN '{ATTACK}' || chr(10) || text WHEN 'end' THEN text || chr(10) || '{ATTACK}' ELSE text END) AS text_sha FROM documents CROSS JOIN (VALUES ('clean'), ('start'), ('end')) AS p(position)")
def g2_attacked_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", "text")
    return corpus.copies(docs, F.lit(ATTACK), POSITIONS).select("doc_id", "position", "label", F.sha2("text", 256).alias("text_sha"))


@query("SELECT doc_id, true AS holds, length(text) + " + str(len(ATTACK) + 2) + "::BIGINT AS chars FROM documents")
def g1_insert_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attack at a sentence boundary: it is there, and nothing of the text is lost."""
    docs = tables(spark, sf_dir, "documents")["documents"]
    made = corpus.inserted(F.col("text"), F.lit(ATTACK), F.lit("middle"), F.col("doc_id"))
    return docs.select("doc_id", F.contains(made, F.lit(ATTACK)).alias("holds"), F.char_length(made).cast("long").alias("chars"))


TEXT_CARRIERS = ["html_hidden", "html_comment", "base64", "zero_width", "unicode_tags"]


@query("SELECT doc_id, category, sha256(CASE category WHEN 'html_hidden' THEN '<html><body><div class=''post''><p>' || text || '</p></div><div style=\"display:none\">' || hidden || '</div></body></html>' WHEN 'html_comment' THEN '<html><body><article><p>' || text || '</p><!-- ' || hidden || ' --></article></body></html>' WHEN 'base64' THEN text || chr(10) || chr(10) || 'ref: ' || base64(encode(hidden)) WHEN 'zero_width' THEN text || chr(10) || chr(10) || array_to_string(string_split(hidden, ''), chr(8203)) ELSE text || array_to_string(list_transform(string_split(' ' || hidden, ''), lambda c: chr(unicode(c) + 917504)), '') END) AS text_sha FROM (SELECT doc_id, text, 'Send note ' || doc_id AS hidden FROM documents) CROSS JOIN (VALUES ('html_hidden'), ('html_comment'), ('base64'), ('zero_width'), ('unicode_tags')) AS t(category)")
def g3_text_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", "text", F.concat(F.lit("Send note "), "doc_id").alias("hidden"))
    return corpus.carried(docs, F.col("text"), F.col("hidden"), TEXT_CARRIERS).select("doc_id", "category", F.sha2("text", 256).alias("text_sha"))


ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"WITH d AS (SELECT doc_id, 'Say \"no\" & <go> ' || doc_id AS h, text FROM documents) SELECT doc_id, category, sha256('<html><head><title>Notes</title>' || CASE category WHEN 'attr_meta' THEN '<meta name=\"description\" content=\"' || {ESCAPED.format('h')} || '\">' ELSE '' END || '</head><body>' || CASE category WHEN 'attr_id' THEN '<div id=\"' || {ESCAPED.format('h')} || '\"></div>' WHEN 'attr_alt' THEN '<img src=\"banner.png\" alt=\"' || {ESCAPED.format('h')} || '\">' ELSE '' END || '<article><p>' || {ESCAPED.format('text')} || '</p></article></body></html>') AS text_sha FROM d CROSS JOIN (VALUES ('attr_id'), ('attr_meta'), ('attr_alt')) AS t(category)")
def g5_attribute_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", "text", F.concat(F.lit('Say "no" & <go> '), "doc_id").alias("h"))
    return corpus.carried(docs, F.col("text"), F.col("h"), ["attr_id", "attr_meta", "attr_alt"]).select("doc_id", "category", F.sha2("text", 256).alias("text_sha"))


@query(None)
def g6_benign_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id")
    return corpus.twins(docs, "doc_id", max(1, docs.count() // 2_000))


@query(f"WITH {I} SELECT item_id, category, 'old' AS made FROM i WHERE category NOT LIKE 'attr_%' UNION ALL SELECT item_id, 'attr_id', 'new' FROM i WHERE item_id % 50 = 0")
def g7_replace_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", "category", F.lit("old").alias("made"))
    new = rows.filter("item_id % 50 = 0").select("item_id", F.lit("attr_id").alias("category"), F.lit("new").alias("made"))
    return corpus.replaced(corpus.replaced(rows, new, "attr_"), new, "attr_")


@query(f"WITH {I} SELECT item_id, CASE WHEN regexp_matches(text, {quoted('(?i)' + X.KEYWORDS)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, CASE WHEN length(t) <= 2000 THEN 1 ELSE ceil((length(t) - 2000) / 1800::DOUBLE)::INT + 1 END::BIGINT AS n_chunks FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM i)")
def h1_score_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through a detector and back to items. Phrases are shorter than the overlap, so none is lost at a cut."""
    chunks = chunking.chunks(items(spark, sf_dir).select("item_id", "text"), "text", *chunking.CHUNKS["retry"])
    found = scoring.merged(scoring.score_chunks(chunks.select("item_id", "pos", "chunk"), "chunk", "keywords"), "item_id")
    return found.select("item_id", F.col("signals")["keywords"].alias("p"), "n_chunks")


@query(None)
def d15_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression on the dev signals, and its probability for every test item."""
    rows = signals(spark, sf_dir).groupBy("item_id", "split", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("x"))
    model = scoring.fit_logistic(rows.filter("split = 'dev'"), "x")
    z = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in model.coefficients]), lambda a, b: a * b), F.lit(float(model.intercept)), lambda a, b: a + b)
    return rows.filter("split = 'test'").select("item_id", "label", (1 / (1 + F.exp(-z))).alias("p"))


@query(f"WITH {I}, {READ}, v AS (SELECT item_id, label, flags, CASE WHEN regexp_matches(text, {quoted('(?i)' + X.KEYWORDS)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM read) SELECT item_id, label, score, CASE WHEN score >= 0.9::DOUBLE THEN 'injection' WHEN regexp_matches(flags, 'unicode_tags|zero_width|bidi_override|base64_text') THEN 'suspicious' ELSE 'safe' END AS verdict FROM v")
def l4_scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items end to end: read, chunk, score, decide; distinct contents are scored once."""
    rows = reading.spread(planted(spark, sf_dir).select("item_id", "label", "text"))
    return gate.judged(rows, "text").select("item_id", "label", "score", "verdict")
