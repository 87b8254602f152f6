"""Building of labelled corpora: attacks put into texts, carriers that hide them, benign twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cut_of(text: Column, seed: Column) -> Column:
    """A sentence boundary of a text, in code points, picked by a seed; its end if there is none."""
    ends = F.split(text, r"(?<=[.!?])\s+")
    pick = F.pmod(F.xxhash64(seed), F.size(ends)).cast("int")
    before = F.array_join(F.slice(ends, 1, pick), "  ")
    return F.when(pick > 0, F.char_length(before)).otherwise(F.char_length(text))


def inserted(text: Column, attack: Column, position: Column, seed: Column) -> Column:
    """The attack at the start, the end or a sentence boundary ('middle') of a text."""
    at = F.least(cut_of(text, seed), F.char_length(text)).cast("int")
    middle = F.concat(F.substring(text, F.lit(1), at), F.lit(" "), attack, F.lit(" "), F.substring(text, at + 1, F.char_length(text)))
    return F.when(position == "start", F.concat(attack, F.lit("\n"), text)).when(position == "end", F.concat(text, F.lit("\n"), attack)).otherwise(middle)


def copies(rows: DataFrame, attack: Column, positions: list[str]) -> DataFrame:
    """A clean copy of each row and one attacked copy for each position: position, label, text."""
    at = F.explode(F.array(F.lit("clean"), *[F.lit(p) for p in positions])).alias("position")
    rows = rows.select("*", at).withColumn("label", (F.col("position") != "clean").cast("int"))
    return rows.withColumn("text", F.when(F.col("label") == 1, inserted(F.col("text"), attack, F.col("position"), F.col("text"))).otherwise(F.col("text")))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tagged(text: Column) -> Column:
    """ASCII as invisible tag characters."""
    code = lambda c: F.decode(F.concat(F.unhex(F.lit("F3A0")), F.unhex(F.hex(F.shiftright(F.ascii(c), 6) + 128)), F.unhex(F.hex(F.ascii(c).bitwiseAND(63) + 128))), "utf-8")
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[\\x00-\\x7f]"), F.lit(0)), code), "")


def spaced(text: Column) -> Column:
    """Zero-width spaces between all characters."""
    return F.array_join(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), "\u200b")


def page(visible: Column, head: Column | None = None, body: Column | None = None) -> Column:
    empty = F.lit("")
    return F.concat(F.lit("<html><head><title>Notes</title>"), head if head is not None else empty, F.lit("</head><body>"), body if body is not None else empty, F.lit("<article><p>"), escaped(visible), F.lit("</p></article></body></html>"))


def carriers(base: Column, hidden: Column) -> dict[str, Column]:
    """The text of each carrier."""
    around = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    quoted = F.to_json(F.struct(hidden.alias("msg")))
    article = F.to_json(F.struct(F.lit("Article").alias("@type"), hidden.alias("description")))
    return {
        "html_hidden": F.concat(F.lit("<html><body><div class='post'><p>"), base, F.lit('</p></div><div style="display:none">'), hidden, F.lit("</div></body></html>")),
        "html_comment": F.concat(F.lit("<html><body><article><p>"), base, F.lit("</p><!-- "), hidden, F.lit(" --></article></body></html>")),
        "unicode_tags": F.concat(base, tagged(F.concat(F.lit(" "), hidden))),
        "zero_width": F.concat(base, F.lit("\n\n"), spaced(hidden)),
        "base64": F.concat(base, F.lit("\n\nref: "), F.base64(F.encode(hidden, "utf-8"))),
        "attr_id": page(base, body=around('<div id="', escaped(hidden), '"></div>')),
        "attr_data": page(base, body=around('<section data-note="', escaped(hidden), '"></section>')),
        "attr_meta": page(base, head=around('<meta name="description" content="', escaped(hidden), '">')),
        "attr_script": page(base, body=around("<script>var cfg = ", quoted, ";</script>")),
        "attr_jsonld": page(base, head=around('<script type="application/ld+json">', article, "</script>")),
        "attr_alt": page(base, body=around('<img src="banner.png" alt="', escaped(hidden), '">')),
    }


def carried(rows: DataFrame, base: Column, hidden: Column, names: list[str]) -> DataFrame:
    """A row for each carrier: category and text."""
    made = carriers(base, hidden)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("category"), made[n].alias("carried")) for n in names])).alias("c")
    return rows.select("*", each).select(*[c for c in rows.columns if c != "text"], "c.category", F.col("c.carried").alias("text"))


def twins(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Pairs (one, other) of different rows: each row with the next one, by key, in its hash bucket. A row
    that is alone in its bucket has no twin. buckets should leave a few thousand rows in each."""
    rows = rows.select(F.col(key).alias("one"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b"))
    order = W.partitionBy("b").orderBy("one")
    last = F.first("one").over(W.partitionBy("b").orderBy("one").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("one", F.coalesce(F.lead("one").over(order), last).alias("other")).filter("one <> other")


def replaced(old: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """old without the rows whose category starts with prefix, and new: the same however often it runs."""
    return old.filter(~F.coalesce(F.col("category").startswith(prefix), F.lit(False))).unionByName(new, allowMissingColumns=True)
