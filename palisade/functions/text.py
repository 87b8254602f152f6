"""Text functions as native columns: words, invisible Unicode, base64, opaque tokens, natural language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that are not shown, and the thresholds of the reveal steps.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u180e"
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
SOFT_HYPHEN = "\u00ad"
TAGS = r"[\x{E0000}-\x{E007F}]"
LEAST_ZERO_WIDTH = 8
BASE64_RUN = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])"
LEAST_DECODED, LEAST_PRINTABLE = 12, 0.95
OPAQUE = r"(?:nostr:|(?<![A-Za-z0-9_\-+/=]))[A-Za-z0-9_\-+/=]{32,}"
#: What any opaque token or run of base64 begins with.
LONG_RUN = r"(?<![A-Za-z0-9_\-+/=])[A-Za-z0-9_\-+/=]{32}"
JOINER = r"[_\-+/=.]+"
PLAIN_WORD = r"^(?:[A-Z]?[a-z]{1,19}|[A-Z]{2,20})$"
SENTENCE_TOKEN = r"^\p{L}+[.,:;!?)]?$"
HTML_MARK = r"(?i)<(html|body|div|p|span|table|a |img |!--)"
NO_SPACE_SCRIPT = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
KEYWORDS = (
    r"ignore (all |any )?(the )?(previous|prior|above|earlier)|disregard (all |the )?(previous|prior|above)|forget (all |everything|your|previous)"
    r"|new instructions|system prompt|you are now|override|jailbreak|do anything now|developer mode|reveal (your|the) (prompt|instructions)"
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, so that steps can be stacked without growing like a tree."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def matches(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def tag_text(text: Column) -> Column:
    """The printable ASCII that tag characters spell."""
    spelled = F.transform(matches(text, TAGS), lambda c: F.chr(F.ascii(c) - 0xE0000))
    return F.array_join(F.filter(spelled, lambda c: c.rlike(r"[ -~]")), "")


def unhidden(text: Column) -> Column:
    """Tag characters as the ASCII they stand for, and no invisible characters. Runs of other
    characters stay whole, so the cost is in proportion to the text."""
    pieces = matches(text, TAGS + r"|[^\x{E0000}-\x{E007F}]+")
    read = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^" + TAGS + "$"), F.chr(F.ascii(p) - 0xE0000)).otherwise(p)), "")
    return F.when(ascii_only(text), text).otherwise(F.translate(F.when(text.rlike(TAGS), read).otherwise(text), ZERO_WIDTH + BIDI + SOFT_HYPHEN, ""))


def words(text: Column) -> Column:
    """Words a model can read: runs of two letters or more, and each character of a script without
    spaces. The text is taken to be in NFKC."""
    read = unhidden(text)
    return F.regexp_count(read, F.lit(r"\p{L}{2,}")) + F.regexp_count(read, F.lit(NO_SPACE_SCRIPT))


def unicode_flags(text: Column) -> Column:
    hidden = F.when(text.rlike(TAGS), F.trim(tag_text(text)) != "").otherwise(False)
    found = F.array_compact(F.array(F.when(hidden, "unicode_tags"), F.when(F.regexp_count(text, F.lit(f"[{ZERO_WIDTH}]")) >= LEAST_ZERO_WIDTH, "zero_width"), F.when(text.rlike(f"[{BIDI}]"), "bidi_override")))
    return F.when(ascii_only(text), F.array().cast("array<string>")).otherwise(found)


def shown(text: Column) -> Column:
    """The text without tag characters and other invisible ones."""
    return F.when(ascii_only(text), text).otherwise(F.translate(F.regexp_replace(text, TAGS, ""), ZERO_WIDTH + BIDI, ""))


def with_tag_text(clean: Column, text: Column) -> Column:
    """clean, and after it what the tag characters of text spell."""
    spelled = F.when(~ascii_only(text), tag_text(text))
    return let(spelled, lambda tags: F.when(F.trim(tags) != "", F.concat(clean, F.lit("\n[hidden unicode-tag text]: "), tags)).otherwise(clean))


def reveal_unicode(text: Column) -> Column:
    """The text without invisible characters, and what tag characters spell after it."""
    return with_tag_text(shown(text), text)


def printable_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]|[ \n\r\t]")) / F.greatest(F.char_length(text), F.lit(1))


def decoded_base64(text: Column) -> Column:
    """The readable texts that runs of base64 hold."""

    def read(run: Column) -> Column:
        bare = lambda b: F.concat(b, F.repeat(F.lit("="), F.pmod(-F.char_length(b), F.lit(4))))
        return let(F.regexp_replace(run, "=+$", ""), lambda b: F.when(F.pmod(F.char_length(b), F.lit(4)) != 1, F.try_to_binary(bare(b), F.lit("base64"))))

    raw = F.transform(matches(text, BASE64_RUN), read)
    texts = F.transform(F.filter(raw, lambda r: r.isNotNull() & F.is_valid_utf8(r.cast("string"))), lambda r: r.cast("string"))
    found = F.filter(texts, lambda t: (F.char_length(t) >= LEAST_DECODED) & (printable_ratio(t) > LEAST_PRINTABLE) & t.rlike(r"[A-Za-z]{3,}\s+[A-Za-z]{2,}"))
    return F.when(text.rlike(LONG_RUN), found).otherwise(F.array().cast("array<string>"))


def with_decoded(text: Column, found: Column) -> Column:
    return F.concat(text, F.array_join(F.transform(found, lambda d: F.concat(F.lit("\n[decoded base64]: "), d)), ""))


def reveal_base64(text: Column) -> Column:
    return with_decoded(text, decoded_base64(text))


def joined_words(token: Column) -> Column:
    """The parts of a token that is a sentence with its spaces replaced; null for other tokens."""
    digits, letters = F.regexp_count(token, F.lit("[0-9]")), F.regexp_count(token, F.lit("[A-Za-z0-9]"))

    def checked(parts: Column) -> Column:
        plain = F.size(F.filter(parts, lambda p: F.regexp_replace(p, "^[0-9]+|[0-9]+$", "").rlike(PLAIN_WORD)))
        return F.when((F.size(parts) >= 3) & (digits * 10 <= letters), let(plain, lambda n: F.when((n >= 3) & (n >= F.lit(0.75) * F.size(parts)), parts)))

    return let(F.filter(F.split(F.regexp_replace(token, "^nostr:", ""), JOINER), lambda p: p != ""), checked)


def restore_joined(value: Column) -> Column:
    return F.when(~value.rlike(r"\s") & (value != ""), F.coalesce(F.array_join(joined_words(value), " "), value)).otherwise(value)


def collapse_opaque(text: Column) -> Column:
    """Long opaque tokens as [id:length], or as words where they are joined words."""
    between = F.split(text, OPAQUE, -1)
    shown = F.transform(matches(text, OPAQUE), lambda t: F.coalesce(F.array_join(joined_words(t), " "), F.concat(F.lit("[id:"), F.char_length(t).cast("string"), F.lit("]"))))
    collapsed = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(LONG_RUN), collapsed).otherwise(text)


def natural_language(value: Column, least: int = 3) -> Column:
    tokens = F.filter(F.split(value, r"\s+"), lambda t: t != "")
    plain = F.size(F.filter(tokens, lambda t: t.rlike(SENTENCE_TOKEN)))
    return (plain >= least) & (plain >= F.lit(0.5) * F.size(tokens))


def normal_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0b]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def looks_like_html(text: Column) -> Column:
    return F.substring(text, 1, 5000).rlike(HTML_MARK)


def keyword_score(text: Column) -> Column:
    return text.rlike("(?i)" + KEYWORDS).cast("double")


def content_digest(text: Column, images: Column) -> Column:
    return F.sha2(F.concat_ws("\n", text, images), 256)


def image_kind(data: Column) -> Column:
    """Whether bytes begin like a PNG, GIF, RIFF or JPEG file."""
    head = F.hex(F.substring(data, 1, 4))
    return head.isin("89504E47", "47494638", "52494646") | head.startswith("FFD8")


def visible_text(text: Column) -> Column:
    """The native steps of a reading, for text that is composed and not HTML: see reading.read for all."""
    return let(let(reveal_unicode(text), reveal_base64), collapse_opaque)
