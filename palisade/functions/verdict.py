"""Scores, verdicts, reasons and actions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags, reasons, and the shipped policies.
HIDING = ["base64_text", "bidi_override", "html_attribute_text", "image_low_contrast_text", "image_small_text", "jpeg_trailing_data", "unicode_tags", "zero_width"]
INCOMPLETE = {
    "image_unreadable": "image could not be decoded",
    "ocr_failed": "image text not read (OCR failed)",
    "ocr_unavailable": "image text not read (no OCR engine)",
    "scan_incomplete": "part of the content could not be scored",
    "scan_truncated": "content longer than the detector's chunk limit; the rest was not scored",
}
REASONS = {
    "addressed_ai": "instructions addressed to an AI",
    "choice_kind": "reads as an instruction aimed at an AI",
    "covert": "asks for covert action or data disclosure",
    "imperative_to_reader": "commands the reader",
    "noul_injection": "reads as a planted prompt injection",
    "off_topic_task": "embedded unrelated command",
    "override": "tries to replace the reader's task",
    "respond_format": "dictates the reader's response",
}
QUESTIONS = ["addressed_ai", "override", "off_topic_task", "covert", "imperative_to_reader", "noul_injection", "choice_kind"]
POLICIES = [
    # policy, questions, agg, block, warn, local_block
    ("jev", ["off_topic_task", "choice_kind"], "max", 0.38, 0.2, 0.6),
    ("laya", ["imperative_to_reader", "noul_injection"], "mean", 0.9021131992340088, 0.6560733914375305, None),
    ("semif", ["override", "off_topic_task"], "mean", 0.7150382657874923, 0.20100727430535023, None),
    ("nimble:9b-q4_K_M", ["off_topic_task", "choice_kind"], "max", 0.5320056567126792, 0.3416625195818867, 0.8110460073217037),
    ("nimble:9b", ["off_topic_task", "choice_kind"], "max", 0.4581469495163182, 0.29366697355426435, 0.7896992261558472),
    ("rsi-jev-v6.1-vl-4b", ["off_topic_task", "choice_kind"], "max", 0.45258843898773193, 0.24201379716396332, 0.7757477760314941),
]
POLICY_SCHEMA = "policy string, questions array<string>, agg string, block double, warn double, local_block double"
SURE = 0.8


def policy_score(signals: Column, questions: Column, agg: Column, weights: Column | None = None, intercept: Column | float = 0.0) -> Column:
    """max, mean or logistic of the signals that the policy asks; a missing one counts 0, no question gives 0."""
    of = lambda q: F.coalesce(F.try_element_at(signals, q), F.lit(0.0))
    values = F.transform(questions, of)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    weigh = (lambda q: F.coalesce(F.try_element_at(weights, q), F.lit(0.0))) if weights is not None else (lambda q: F.lit(0.0))
    z = F.aggregate(F.transform(questions, lambda q: weigh(q) * of(q)), F.lit(intercept) if isinstance(intercept, float) else intercept, lambda a, x: a + x)
    found = F.when(agg == "logistic", 1 / (1 + F.exp(-z))).when(agg == "max", F.array_max(values)).otherwise(F.try_divide(total, F.size(values)))
    return F.when(F.size(questions) == 0, 0.0).otherwise(found)


def has_any(flags: Column, names: list[str]) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))


def decide(score: Column, block: Column, warn: Column, flags: Column, escalates: Column | bool = True) -> Column:
    """injection, suspicious or safe; hidden or unscanned content is never safe."""
    hidden = has_any(flags, HIDING) & (F.lit(escalates) if isinstance(escalates, bool) else escalates)
    return F.when(score >= block, "injection").when((score >= warn) | hidden | has_any(flags, list(INCOMPLETE)), "suspicious").otherwise("safe")


def label_of(question: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), question), question)


def reasons(signals: Column, questions: Column, score: Column, warn: Column, flags: Column) -> Column:
    """The questions that are sure, or the closest one near the threshold; then hidden and unscanned parts."""
    of = lambda q: F.coalesce(F.try_element_at(signals, q), F.lit(0.0))
    sure = F.transform(F.filter(questions, lambda q: (of(q) >= SURE) & q.isin(list(REASONS))), label_of)
    best = F.array_max(F.transform(questions, of))
    closest = F.get(F.filter(questions, lambda q: of(q) == best), F.lit(0))  # the first of equals
    near = F.when((F.size(sure) == 0) & (score >= warn), F.array(F.concat(F.lit("closest: "), label_of(closest), F.lit(" ("), F.format_number(of(closest), 2), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    hidden = F.transform(F.filter(flags, lambda f: f.isin(HIDING)), lambda f: F.concat(F.lit("hidden content: "), f))
    texts = F.create_map(*[F.lit(x) for kv in INCOMPLETE.items() for x in kv])
    missing = F.transform(F.filter(F.array_distinct(flags), lambda f: f.isin(list(INCOMPLETE))), lambda f: F.concat(F.lit("not fully scanned: "), F.element_at(texts, f)))
    return F.concat(sure, near, hidden, missing)


def p_yes(kind: Column, noul: Column, probabilities: Column) -> Column:
    """One probability of an answer: the value itself, the share of "injection", or that of the last rubric."""
    last = F.array_max(F.transform(F.map_keys(probabilities), lambda k: F.try_to_number(k, F.lit("999")).cast("int")))
    return (
        F.when(kind == "noul", noul)
        .when(kind == "choice", F.coalesce(F.try_element_at(probabilities, F.lit("injection")), F.lit(0.0)))
        .otherwise(F.try_element_at(probabilities, last.cast("string")))
    )


def local_downgrade(verdict: Column, mode: Column, score: Column, local_block: Column) -> Column:
    return F.when((mode == "local") & (verdict == "injection") & (F.round(score, 4) < local_block), "suspicious").otherwise(verdict)


def action(mode: Column, words: Column, images: Column, released: Column, paused: Column, failed: Column, verdict: Column, score: Column, local_block: Column, incomplete: Column, closed: Column, warn_only: Column, block_incomplete: Column, least_words: int = 3, trusted: Column | None = None) -> Column:
    """What happens to a result: the first rule that holds; null is passed without a record."""
    enforce = (mode != "warn") & ~warn_only
    withhold = closed & enforce
    final = local_downgrade(verdict, mode, score, local_block)
    return (
        F.when(mode.isNull(), F.lit(None).cast("string"))
        .when(trusted if trusted is not None else F.lit(False), "passed-trusted")
        .when((words < least_words) & (images == 0), F.lit(None).cast("string"))
        .when(released, "passed-released")
        .when(paused & ~withhold, "passed-unscanned")
        .when(failed & (verdict != "injection"), F.when(withhold, "blocked-unavailable").otherwise("passed-unavailable"))
        .when((final == "injection") & enforce, "blocked")
        .when(incomplete & enforce & block_incomplete, "blocked-incomplete")
        .when(final.isin("injection", "suspicious"), "flagged")
        .otherwise("passed")
    )


def status_class(status: Column) -> Column:
    """What a scorer's status means: retry, split the input, refuse the input, or an outage."""
    return F.when(status == 200, "ok").when(status.isin(429, 502, 503, 504), "retry").when(status == 500, "split").when(status.isin(400, 413, 422), "input").otherwise("outage")


def over_limit(images: Column, most: int) -> Column:
    """struct<verdict, score, reason> for a result with more images than are scanned."""
    reason = F.concat(F.lit("not fully scanned: "), images - most, F.lit(f" images over the limit of {most}"))
    return F.struct(F.lit("suspicious").alias("verdict"), F.lit(None).cast("double").alias("score"), reason.alias("reason"))
