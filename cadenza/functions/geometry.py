"""Column functions on pixels, boxes and poses, as rows hold them. A null in gives a null out, but where a docstring says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import half_even


def odd_size(base: int, width: Column, reference: int = 424) -> Column:
    """A kernel size that grows with the image's width from ``base`` at ``reference``: rounded half to even, at least ``base``, and odd."""
    size = F.greatest(F.lit(base).cast("long"), half_even(width * base / reference))
    return size + 1 - size % 2


def crop_box(x: Column, y: Column, radius: int, width: Column, height: Column) -> Column:
    """Half-open box of ``radius`` pixels around the nearest pixel, inside the image."""
    cx, cy = half_even(x), half_even(y)
    return F.struct(
        F.greatest(cx - radius, F.lit(0)).alias("left"),
        F.greatest(cy - radius, F.lit(0)).alias("top"),
        F.least(cx + radius + 1, width).alias("right"),
        F.least(cy + radius + 1, height).alias("bottom"),
    )


def rescaled_query(t: Column, y: Column, x: Column, height: Column, width: Column, resolution: int) -> Column:
    """A (t, y, x) query in an image of ``resolution`` pixels a side."""
    return F.struct(t.alias("t"), (y * (resolution / height)).alias("y"), (x * (resolution / width)).alias("x"))


def is_red(hue: Column, saturation: Column, value: Column) -> Column:
    """Fixed values for hue of 0 to 180, saturation and value of 0 to 255."""
    return ((hue < 12) | (hue > 170)) & (saturation > 120) & (value > 70)


def entry_side(touches_left: Column, touches_right: Column) -> Column:
    """0 (left) or 1 (right) if a region touches that edge alone; null if both or neither."""
    return F.when(touches_left != touches_right, F.when(touches_left, 0).otherwise(1))


def seed_frame(contact: Column, last_seen: Column, fps: float) -> Column:
    """Frame to start tracking at: 0.1 s before the contact, or before the last sight of the object; 0 at least, and without either."""
    return F.greatest(F.coalesce(contact, last_seen, F.lit(0)) - round(fps * 0.1), F.lit(0)).cast("long")


def packed_bits(flags: Column) -> Column:
    """Bytes (0 to 255) of a boolean array, first flag in the highest bit, the last byte filled up with zeros."""
    n = F.size(flags)
    each = F.sequence(F.lit(0), F.greatest(F.ceil(n / 8).cast("int") - 1, F.lit(0)))
    out = F.transform(each, lambda k: sum(F.when(F.get(flags, (k * 8 + j).cast("int")), 128 >> j).otherwise(0) for j in range(8)))
    return F.when(n > 0, out).otherwise(F.array().cast("array<int>"))


def unpacked_bits(packed: Column, n: Column) -> Column:
    """The first ``n`` flags of packed bytes."""
    flags = F.flatten(F.transform(packed, lambda b: F.array(*[b.bitwiseAND(F.lit(128 >> j)) > 0 for j in range(8)])))
    return F.slice(flags, F.lit(1), n.cast("int"))


def motion_bound(joint_steps: Column, grip_step: Column, reach_m: float) -> Column:
    """Metres that no point of an arm exceeds over an edge: joints in degrees at full reach, the grip in half millimetres."""
    return F.aggregate(joint_steps, F.lit(0.0), lambda a, d: a + F.abs(d)) * (math.pi / 180 * reach_m) + F.abs(grip_step) / 2000


def substeps(bound: Column, margin: float) -> Column:
    """Poses to test on an edge so that none moves over half the margin: 1 at least."""
    return F.greatest(F.ceil(bound / (margin / 2)), F.lit(1)).cast("long")


def body_box(x: Column, y: Column, z: Column, half_width: float = 0.12, depth: float = 0.20, half_height: float = 0.035) -> Column:
    """Box that a drawer's body takes up behind its handle, in the drawer's axes."""
    return F.struct((x - depth).alias("back"), x.alias("front"), (y - half_width).alias("near"), (y + half_width).alias("far"), (z - half_height).alias("low"), (z + half_height).alias("high"))


def in_box(x: Column, y: Column, z: Column, box: Column) -> Column:
    return x.between(box["back"], box["front"]) & y.between(box["near"], box["far"]) & z.between(box["low"], box["high"])


def file_stem(path: Column) -> Column:
    """The last part of a path without query, fragment and extension."""
    return F.regexp_extract(path, r"([^/?#]*?)(?:\.[^./?#]*)?(?:[?#].*)?$", 1)
