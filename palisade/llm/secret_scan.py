"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: an or of sets that must
all occur, in lower case, in any text that the rule can match. The index holds, for each trigram that
some rule names and for each block of documents, the posting list of the documents that contain it.
A rule's candidates are the intersections of its postings, block by block; only they are matched
against the expression. A rule without mandatory trigrams scans every document.

Positions come from the texts between the matches: the start of a match is the length of all pieces
and matches before it, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as c
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import identified, scanned, text_of, tidy


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: A match counts if this group of it has at least this many code points.
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A word in ASCII letters of either case, the same to every engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base rules in the order in which they are listed. Runs of one character class are
# matched as a whole, so the least length stands in the expression where no shorter match could hide
# a longer one.
BASE = [
    Rule("assign", f"({'|'.join(map(either_case, ['password', 'passwd', 'secret', 'token', 'api_?key']))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
#: Further kinds; their spans follow the base kinds' where they start together.
MORE = [
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
#: Bounds on what a derivation carries: strings of a stretch, and alternatives of a query.
STRINGS, ALTERNATIVES = 64, 64
ALL: list[frozenset[str]] = [frozenset()]


def absorbed(query: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without the alternatives that another one includes."""
    out: list[frozenset[str]] = []
    for q in sorted(set(query), key=lambda q: (len(q), sorted(q))):
        if not any(o <= q for o in out):
            out.append(q)
    return out


def both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """a and b. Where that has too many alternatives, one of the two alone: weaker, so still sound."""
    joint = absorbed([x | y for x, y in product(a, b)])
    return joint if len(joint) <= ALTERNATIVES else min(a, b, key=len)


def of_strings(strings: set[str]) -> list[frozenset[str]]:
    return absorbed([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def members(items) -> set[str] | None:
    """The characters of a class, in lower case, if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is c.LITERAL:
            out.add(chr(value).lower())
        elif op is c.RANGE and value[1] - value[0] < STRINGS:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def strings_of(op, value) -> set[str] | None:
    """The strings that an element matches, in lower case, if they are few and known."""
    if op is c.LITERAL:
        return {chr(value).lower()}
    if op is c.IN:
        return members(value)
    if op is c.SUBPATTERN:
        return strings_of_all(value[3])
    if op is c.BRANCH:
        parts = [strings_of_all(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and value[1] == 1:
        inner = strings_of_all(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def strings_of_all(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        one = strings_of(op, value)
        if one is None or len(out) * len(one) > STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def query_of(op, value) -> list[frozenset[str]]:
    """What an element demands that has no short list of strings."""
    if op is c.SUBPATTERN:
        return query_of_all(value[3])
    if op is c.BRANCH:
        parts = absorbed([q for x in value[1] for q in query_of_all(x)])
        return parts if len(parts) <= ALTERNATIVES else ALL
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] > 0:
        return query_of_all(value[2])
    return ALL


def query_of_all(items) -> list[frozenset[str]]:
    out, stretch = ALL, {""}
    for op, value in items:
        one = strings_of(op, value)
        if one is not None and len(stretch) * len(one) <= STRINGS:
            stretch = {a + b for a in stretch for b in one}
            continue
        out = both(out, of_strings(stretch))
        stretch = one if one is not None else {""}
        if one is None:
            out = both(out, query_of(op, value))
    return both(out, of_strings(stretch))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The alternatives of which any match has one, as sets of lower-case trigrams; [empty set] if
    nothing is mandatory."""
    return query_of_all(_parser.parse(regex))


def trigram_index(docs: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """block, gram and docs (the posting list) of texts (uid, text); the grams are those that some
    rule names, as no others are ever looked up."""
    low = docs.select("uid", F.lower("text").alias("low"))
    found = low.select("uid", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))).alias("gram"))
    return found.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), "gram").agg(F.collect_list("uid").alias("docs"))


def candidates(spark: SparkSession, index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """uid and kinds: the rules whose trigram queries a document meets."""
    terms = [(kind, at, g, len(q)) for kind, query in queries.items() for at, q in enumerate(query) for g in sorted(q)]
    table = spark.createDataFrame(terms, "kind string, at int, gram string, need int")  # the rules' own size
    lists = index.join(F.broadcast(table), "gram").groupBy("block", "kind", "at", "need").agg(F.collect_list("docs").alias("lists"))
    lists = lists.filter(F.size("lists") == F.col("need"))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return lists.select("kind", F.explode(common).alias("uid")).groupBy("uid").agg(F.collect_set("kind").alias("kinds"))


def spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, end>> of the rule's matches in a text."""
    regex = F.lit(rule.regex)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    groups = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else hits
    between = F.split(text, rule.regex, -1)
    lengths = F.zip_with(F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda p, h: F.struct(F.char_length(p).alias("gap"), F.char_length(h).alias("n"))), groups, lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), (F.char_length(g) >= rule.least).alias("ok")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.when(x["ok"], F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"))))).otherwise(a["out"]).alias("out"))
    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def scan(spark: SparkSession, docs: DataFrame, rules: list[Rule], block: int = 512) -> DataFrame:
    """doc_id, and for each rule an array<struct<start, end>> named after its kind, for each row of docs.

    Null texts count as empty and have no spans; repeated rows and null ids get a row each; an empty table
    gives no rows; further columns are not read, whatever their names.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ALL}
    docs = scanned(spark, docs)
    rows = identified(docs, [docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")])
    if indexed:
        grams = sorted({g for q in indexed.values() for alternative in q for g in alternative})
        index = trigram_index(rows, grams, max(1, -(-docs.count() // block)))
        # texts are dealt by row once and not sorted: the candidates' side is hashed
        rows = rows.join(candidates(spark, index, indexed).hint("shuffle_hash"), "uid", "left")
    columns = []
    for r in rules:
        found = spans(r, F.col("text"))
        empty = F.array().cast("array<struct<start:int,end:int>>")
        wanted = F.array_contains(F.col("kinds"), r.kind) if r.kind in indexed else F.lit(True)
        columns.append(F.when(wanted & F.col("text").rlike(r.regex), found).otherwise(empty).alias(r.kind))
    return rows.select("doc_id", *columns)


def joined(kinds: list[str]) -> Column:
    """The spans of kinds as kind:start:end, by start, then in the order of kinds."""
    def tagged(at: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    every = F.concat(*[tagged(at, kind) for at, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@tidy
def secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, their digest, and all spans as text."""
    base = [r.kind for r in BASE]
    found = scan(spark, docs, [*BASE, *MORE])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(F.encode(joined(base), "utf-8"), 256).alias("base_sha256"), joined([r.kind for r in [*BASE, *MORE]]).alias("spans"))
