"""Number rules that differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A question set: fixed values.
QUESTIONS = 20
POINTS = 5


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity (Spark rounds halves away from zero)."""
    return F.floor(x + 0.5)


def fixed_decimals(x: Column, digits: int) -> Column:
    """Rounded to so many decimals by the double's exact value, halves up in size.

    ``round`` works on the shortest decimal text instead and differs where that
    text ends in 5. Only a double that is the nearest one to a half is in doubt;
    which side of it it lies on is the sign of an exact product by parts.
    """
    scale = 10.0**digits
    size = F.abs(x)
    below = F.floor(size * scale)
    half = (below + 0.5) / scale
    spread = half * 134217729.0
    high = spread - (spread - half)
    past = (high * (2 * scale) - (below * 2.0 + 1.0)) + (half - high) * (2 * scale)
    up = (size > half) | ((size == half) & (past >= 0))
    return F.signum(x) * F.when(up, below + 1).otherwise(below) / scale


def set_score(correct: Column) -> Column:
    """Correct answers of a set, truncated and clamped to 0..20; what is not finite counts 0."""
    number = correct.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(finite, F.greatest(F.lit(0), F.least(F.lit(QUESTIONS), whole))).otherwise(0).cast("int")


def points(correct: Column) -> Column:
    return set_score(correct) * POINTS


def win_rate(correct: Column, questions: Column | int = QUESTIONS) -> Column:
    """Per cent; 0 when there were no questions."""
    questions = questions if isinstance(questions, Column) else F.lit(questions)
    return F.coalesce(F.try_divide(correct * 100.0, questions), F.lit(0.0))


def nonnegative(text: Column) -> Column:
    """A finite number from 0 up, else null; empty text is no number."""
    number = F.trim(text).try_cast("double")
    return F.when((F.length(text) > 0) & (number >= 0) & ~F.isnan(number) & (number < F.lit(float("inf"))), number)


def whole_in(x: Column, low: int, high: int) -> Column:
    """True if x is a whole number in the range; null counts as false."""
    return F.coalesce((x >= low) & (x <= high) & (x == F.floor(x)), F.lit(False))


def aspect_bucket(aspect: Column) -> Column:
    """Bucket of width-to-height ratios, 13 % wide."""
    return round_half_up(F.ln(aspect) / F.ln(F.lit(1.13))).cast("int")


def stride_positions(span: Column, window: Column, step: Column) -> Column:
    """Starts of windows along a span, a step apart, the last position always included."""
    last = span - window
    regular = F.filter(F.sequence(F.lit(0).cast("int"), F.greatest(last, F.lit(0)).cast("int"), step.cast("int")), lambda p: p < last)
    return F.when(last <= 0, F.array(F.lit(0).cast("int"))).otherwise(F.concat(regular, F.array(last.cast("int"))))


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, width, height)."""
    wide = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    shared = wide * high
    return F.try_divide(shared, a["width"] * a["height"] + b["width"] * b["height"] - shared)


def polygon_area(points_: Column) -> Column:
    """Shoelace area of an array of (x, y), the last vertex joined to the first."""
    n = F.size(points_)
    nxt = F.concat(F.slice(points_, 2, F.greatest(n - 1, F.lit(0))), F.slice(points_, 1, 1))
    cross = F.zip_with(points_, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c)) / 2
