"""Column functions: rounding, arrays, guards, paths, geometry. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_div(a: Column, b: Column) -> Column:
    """The integer nearest to a / b, halves up, for a >= 0, b > 0: in integers, so it never rounds a float."""
    return F.call_function("div", 2 * a + b, 2 * b).cast("long")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def clip(x: Column, low, high) -> Column:
    """``x`` within [low, high]; null stays null, which ``least`` and ``greatest`` would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low))


def even_sample(n: Column, k: int) -> Column:
    """Distinct positions of ``k`` evenly spaced samples of 0..n-1, ends included, truncated."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("long")))


def three_points(n: Column) -> Column:
    """First, middle and last position."""
    return F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2).cast("long"), (n - 1).cast("long")))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def is_vector(v: Column, width: int) -> Column:
    """Whether ``v`` has ``width`` finite values."""
    return F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def checked_vector(v: Column, width: int) -> Column:
    """``v``, or an error if it isn't a finite vector of ``width`` values."""
    return F.when(is_vector(v, width), v).otherwise(F.raise_error(F.lit(f"a vector of {width} finite values is asked for")))


def checked_positive(x: Column, what: str) -> Column:
    return F.when(x > 0, x).otherwise(F.raise_error(F.lit(f"{what} must be positive")))


def max_abs_step(v: Column, before: Column) -> Column:
    """The largest change of any channel."""
    return F.array_max(F.zip_with(doubles(v), doubles(before), lambda a, b: F.abs(a - b)))


def lerp(a: Column, b: Column, w: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + w * (y - x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_abs_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def hue_gap(a: Column, b: Column) -> Column:
    """Distance of hues on a circle of 180."""
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def chunk_path(chunk: Column, file: Column) -> Column:
    return F.format_string("data/chunk-%03d/file-%03d.parquet", chunk, file)


def archive_member(uri: Column) -> tuple[Column, Column]:
    """(archive, member) of ``zip://archive#member``; empty if it isn't one, or if the member leaves the archive."""
    pattern = r"^zip://([^#]+)#((?!/)(?!.*\.\.).+)$"
    return F.regexp_extract(uri, pattern, 1), F.regexp_extract(uri, pattern, 2)


def byte_range(header: Column, size: Column) -> Column:
    """start and end (inclusive) of an HTTP byte range within ``size`` bytes; null if it can't be served."""
    first, last = (F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k), F.lit("")).cast("long") for k in (1, 2))
    start = F.coalesce(first, F.greatest(size - last, F.lit(0).cast("long")))
    end = F.when(first.isNull(), size - 1).otherwise(F.least(F.coalesce(last, size - 1), size - 1))
    return F.when((start <= end) & (start < size), F.struct(start.alias("start"), end.alias("end")))


def is_slug(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A[a-z0-9-]+\z"), F.lit(False))


def outside_box(x: Column, y: Column, cx: Column, cy: Column, half_x: Column, half_y: Column, angle: Column, radius: Column) -> Column:
    """Whether a point is further than ``radius`` from an oriented box."""
    u = F.cos(angle) * (x - cx) + F.sin(angle) * (y - cy)
    v = -F.sin(angle) * (x - cx) + F.cos(angle) * (y - cy)
    dx, dy = F.greatest(F.abs(u) - half_x, F.lit(0.0)), F.greatest(F.abs(v) - half_y, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy) > radius


def overlap_ratio(both: Column, either: Column) -> Column:
    return F.when(either > 0, both / either).otherwise(0.0)
