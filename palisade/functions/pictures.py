"""What an OCR engine has read from a picture, as text and flags; option probabilities of a marker model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least words for the flags, and metadata that says nothing.
LEAST_SMALL, LEAST_FAINT = 5, 5
CAMERA = ("exif Make:", "exif Model:", "exif Software:")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def picture_text(plain: Column, small: Column, faint: Column, faint_words: Column, metadata: Column, engine: Column) -> Column:
    """struct<text, flags> of the passes over a picture: plain and faint text, small lines, how many words only the
    faint pass has, metadata lines, and the engine's name ("none" without one)."""
    lines = F.array_distinct(small)
    said = F.exists(metadata, lambda m: ~F.coalesce(*[F.when(m.startswith(c), True) for c in CAMERA], F.lit(False)))
    is_small, is_faint = F.size(lines) > 0, faint_words >= LEAST_FAINT
    part = lambda holds, label, text: F.when(holds, F.concat(F.lit(f"[{label}]: "), text))
    parts = F.array_compact(F.array(part(plain != "", "image text", plain), part(is_small, "small image text", F.array_join(lines, " ")), part(is_faint, "faint image text", faint), part(said, "image metadata", F.array_join(metadata, "\n"))))
    many = F.aggregate(lines, F.lit(0), lambda n, x: n + word_count(x)) >= LEAST_SMALL
    tail = F.exists(metadata, lambda m: m.startswith("trailing data"))
    signs = [(is_small & many, "image_small_text"), (is_faint, "image_low_contrast_text"), (said, "image_metadata_text"), (tail, "jpeg_trailing_data"), (engine == "none", "ocr_unavailable")]
    return F.struct(F.array_join(parts, "\n").alias("text"), F.array_compact(F.array(*[F.when(holds, flag) for holds, flag in signs])).alias("flags"))


def with_fallback(text: Column, flags: Column, fallback: Column) -> Column:
    """struct<text, flags>: where no local engine read a picture, what a service read in its place."""
    unread = F.array_contains(flags, "ocr_unavailable") | F.array_contains(flags, "ocr_failed")
    use = unread & fallback.isNotNull()
    added = F.when(fallback != "", F.concat_ws("\n", F.when(text != "", text), F.concat(F.lit("[image text]: "), fallback))).otherwise(text)
    return F.struct(F.when(use, added).otherwise(text).alias("text"), F.when(use, F.filter(flags, lambda f: ~f.isin("ocr_unavailable", "ocr_failed"))).otherwise(flags).alias("flags"))


def last_option(logits: Column, temperature: float = 1.0) -> Column:
    """The probability of the last of some options, from the logits at their markers."""
    top = F.array_max(logits)
    weigh = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.element_at(weigh, -1) / F.aggregate(weigh, F.lit(0.0), lambda a, x: a + x)
