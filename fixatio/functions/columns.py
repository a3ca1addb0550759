"""Column builders: plain Spark expressions, no Python row functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixatio import model as M


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Text or number to DOUBLE; what does not parse, and NaN, become NULL."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def flag(c: str | Column) -> Column:
    """Blink flag. Missing counts as true, as does any non-empty, non-false text or number."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(~text.isin("false", "0", "0.0"), F.lit(True))


def clean_text(c: str | Column, markers=M.NULL_MARKERS) -> Column:
    return F.when(~col(c).isin(*markers), col(c))


def real_image(c: str | Column = "image") -> Column:
    """Image id, or NULL when the sample shows none."""
    return clean_text(c, M.NO_IMAGE_MARKERS)


def scene_type(c: str | Column = "scene_index") -> Column:
    return F.when(F.pmod(col(c), F.lit(2)) != 0, "stimulus").otherwise("fixation_cross")


def valence(category: str | Column = "category", labels: str | Column = "labels") -> Column:
    """Category decides neutral; otherwise whole labels, negative before positive."""
    lower = F.transform(F.coalesce(col(labels), F.array().cast("array<string>")), F.lower)

    def has(words):
        return F.arrays_overlap(lower, F.array(*[F.lit(w) for w in words]))

    return (
        F.when(F.trim(F.coalesce(col(category), F.lit(""))) == "neutral", "neutral")
        .when(F.coalesce(has(M.NEGATIVE_LABELS), F.lit(False)), "negative")
        .when(F.coalesce(has(M.POSITIVE_LABELS), F.lit(False)), "positive")
        .otherwise("other")
    )


def _ladder(score: Column, uppers, values, closed: bool = True) -> Column:
    """values[i] for scores up to uppers[i] (or below uppers[i] + 1 when not closed)."""
    out = F.when(score.isNull(), None)
    for upper, value in zip(uppers, values):
        out = out.when(score <= upper if closed else score < upper + 1, value)
    return out.otherwise(values[-1])


def severity(score: str | Column, bands: M.Bands) -> Column:
    """Band label of a whole-number score; NULL stays NULL."""
    return _ladder(col(score), bands.uppers, bands.labels)


def severity_of_mean(score: str | Column, bands: M.Bands) -> Column:
    """Band label of a fractional mean score: each band reaches up to the next whole number."""
    return _ladder(col(score), bands.uppers, bands.labels, closed=False)


def severity_class(score: str | Column, bands: M.Bands) -> Column:
    return _ladder(col(score), bands.uppers, list(range(len(bands.labels))))


def three_bands(score: str | Column) -> Column:
    """Coarse bands used for trial-signal displays: up to 4, up to 14, above."""
    return _ladder(col(score), (4, 14), ("minimal", "moderate", "severe"))


def band_order(label: str | Column, bands: M.Bands) -> Column:
    """Position of a band label, for ordered reports."""
    return F.array_position(F.array(*[F.lit(x) for x in bands.labels]), col(label)) - 1


def is_case(score: str | Column, bands: M.Bands) -> Column:
    return (col(score) >= bands.cutoff).cast("int")


def extreme_label(score: str | Column, bands: M.Bands) -> Column:
    """1 for the high end, 0 for the low end, NULL between."""
    return F.when(col(score) >= bands.high_extreme, 1).when(col(score) <= bands.low_extreme, 0)


def stars(p: str | Column) -> Column:
    return (
        F.when(col(p) < 0.001, "***").when(col(p) < 0.01, "**").when(col(p) < 0.05, "*")
        .when(col(p).isNotNull(), "n.s.")
    )


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is not positive."""
    return F.when(col(b) > 0, col(a) / col(b))


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col(c))))


def in_view(x: str | Column, y: str | Column, margin: float = 0.1) -> Column:
    """Gaze point on screen, give or take the margin (open bounds)."""
    lo, hi = -margin, 1 + margin
    return (col(x) > lo) & (col(x) < hi) & (col(y) > lo) & (col(y) < hi)


def safe_timestamp(c: str | Column) -> Column:
    return F.try_to_timestamp(col(c))


def tidy(c: str | Column, digits: int = 9) -> Column:
    """Rounded double without negative zero, for stable comparison of results."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)
