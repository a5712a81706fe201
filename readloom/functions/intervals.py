"""Closed-interval algebra as column expressions.

An interval is a pair of columns (start, end), or a struct with fields s and e; a block list is an array of such structs,
sorted and disjoint. Everything here is built from built-in functions and stays in the JVM. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<s:bigint,e:bigint>"


def iv(s: Column | str, e: Column | str) -> Column:
    """Interval struct of two columns."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (s, e))
    return F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["e"] >= b["s"]) & (a["s"] <= b["e"])


def overlap(a: Column, b: Column) -> Column:
    """Common part; inverted if there is none."""
    return iv(F.greatest(a["s"], b["s"]), F.least(a["e"], b["e"]))


def overlaps_at_least(a: Column, b: Column, delta: int = 0) -> Column:
    """Overlap by delta bases, or the interval that ends first lies inside the other."""
    return overlaps(a, b) & overlaps_enough(a, b, delta)


def overlaps_enough(a: Column, b: Column, delta: int = 0) -> Column:
    """overlaps_at_least for intervals that are known to overlap."""
    inside = F.when(a["e"] < b["e"], a["s"] >= b["s"]).otherwise(a["s"] <= b["s"])
    reach = F.when(a["e"] < b["e"], a["e"] - b["s"] + 1).otherwise(b["e"] - a["s"] + 1)
    return inside | (reach >= delta)


def intersection_len(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]) + 1)


def left_of(a: Column, b: Column) -> Column:
    return a["e"] < b["s"]


def equal_ranges(a: Column, b: Column, delta: int = 0) -> Column:
    return (F.abs(a["s"] - b["s"]) <= delta) & (F.abs(a["e"] - b["e"]) <= delta)


def covers_end(big: Column, small: Column) -> Column:
    return (big["s"] <= small["s"]) & (small["s"] <= big["e"]) & (big["e"] <= small["e"])


def covers_start(big: Column, small: Column) -> Column:
    return (small["s"] <= big["s"]) & (big["s"] <= small["e"]) & (small["e"] <= big["e"])


def contains(big: Column, small: Column) -> Column:
    return (big["s"] <= small["s"]) & (small["e"] <= big["e"])


def contains_well_inside(big: Column, small: Column, delta: int = 1) -> Column:
    return (big["s"] <= small["s"] - delta) & (small["e"] + delta <= big["e"])


def contains_approx(big: Column, small: Column, delta: int = 1) -> Column:
    return contains_well_inside(big, small, -delta)


def max_range(a: Column, b: Column) -> Column:
    return iv(F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"]))


def interval_len(a: Column) -> Column:
    return a["e"] - a["s"] + 1


# ---------------------------------------------------------------- block lists


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def region(blocks: Column) -> Column:
    """From the start of the first block to the end of the last; null for an empty list."""
    return F.when(F.size(blocks) > 0, iv(F.element_at(blocks, 1)["s"], F.element_at(blocks, -1)["e"]))


def total_length(blocks: Column) -> Column:
    return _sum(F.transform(blocks, interval_len))


def sum_to_point(blocks: Column, pos: Column) -> Column:
    """Bases before a position."""
    return _sum(F.transform(blocks, lambda b: F.greatest(F.lit(0).cast("bigint"), F.least(b["e"] + 1, pos) - b["s"])))


def sum_from_point(blocks: Column, pos: Column) -> Column:
    """Bases behind a position."""
    return _sum(F.transform(blocks, lambda b: F.greatest(F.lit(0).cast("bigint"), b["e"] - F.greatest(b["s"] - 1, pos))))


def common_length(a: Column, b: Column) -> Column:
    """Bases that two block lists share."""
    return _sum(F.transform(a, lambda x: _sum(F.transform(b, lambda y: intersection_len(x, y)))))


def jaccard(a: Column, b: Column) -> Column:
    both = common_length(a, b)
    return both / (total_length(a) + total_length(b) - both)


def coverage_fraction(read: Column, isoform: Column) -> Column:
    """Part of a read's bases that lie in an isoform's blocks."""
    return common_length(read, isoform) / total_length(read)


def outside_fraction(read: Column, span: Column) -> Column:
    """Part of a read's bases outside an interval."""
    return F.lit(1.0) - _sum(F.transform(read, lambda b: intersection_len(b, span))) / total_length(read)


def merge_blocks(a: Column, b: Column) -> Column:
    """Union of two block lists; blocks that overlap (not those that only touch) become one."""
    empty = F.array().cast(f"array<{BLOCK}>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(iv(last["s"], F.greatest(last["e"], x["e"]))))
        return F.when(F.coalesce(last["e"] >= x["s"], F.lit(False)), joined).otherwise(F.concat(done, F.array(iv(x["s"], x["e"]))))

    return F.aggregate(F.array_sort(F.concat(a, b)), empty, step)


def junctions(blocks: Column) -> Column:
    """Gaps between neighbouring blocks; blocks that touch have none."""
    n = F.size(blocks)
    pairs = F.zip_with(F.slice(blocks, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(blocks, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: iv(a["e"] + 1, b["s"] - 1))
    return F.filter(pairs, lambda j: j["s"] <= j["e"])


def exons_from_junctions(span: Column, introns: Column) -> Column:
    """Inverse of junctions: blocks of a span between introns."""
    starts = F.concat(F.array(span["s"]), F.transform(introns, lambda i: i["e"] + 1))
    ends = F.concat(F.transform(introns, lambda i: i["s"] - 1), F.array(span["e"]))
    return F.zip_with(starts, ends, iv)


def preceding_exon(exons: Column, intron: Column) -> Column:
    return F.try_element_at(F.filter(exons, lambda x: x["e"] < intron["s"]), F.lit(-1))


def following_exon(exons: Column, intron: Column) -> Column:
    return F.try_element_at(F.filter(exons, lambda x: x["s"] > intron["e"]), F.lit(1))


def truncate(blocks: Column, first: Column, last: Column) -> Column:
    """Blocks clipped to [first, last]; a null bound does not clip."""
    lo, hi = F.coalesce(first, F.lit(-(1 << 62))), F.coalesce(last, F.lit(1 << 62))
    kept = F.filter(blocks, lambda b: (b["e"] > lo) & (b["s"] < hi))
    return F.transform(kept, lambda b: iv(F.greatest(b["s"], lo), F.least(b["e"], hi)))


def find_interval(blocks: Column, pos: Column) -> Column:
    """Index from 0 of the last block that starts at or before a position, -1 outside the list's span."""
    span = region(blocks)
    at = F.size(F.filter(blocks, lambda b: b["s"] <= pos)) - 1
    return F.when(span.isNull() | (pos < span["s"]) | (pos > span["e"]), -1).otherwise(at)


def find_interval_back(blocks: Column, pos: Column) -> Column:
    """Index from 0 of the first block that ends at or behind a position, -1 outside the list's span."""
    span = region(blocks)
    at = F.size(F.filter(blocks, lambda b: b["e"] < pos))
    return F.when(span.isNull() | (pos < span["s"]) | (pos > span["e"]), -1).otherwise(at)


def blocks_to_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat_ws("-", b["s"].cast("string"), b["e"].cast("string"))), ",")


def text_to_blocks(text: Column) -> Column:
    parts = F.transform(F.split(text, ","), lambda p: F.split(p, "-"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(f"array<{BLOCK}>")).otherwise(F.transform(parts, lambda p: iv(p[0], p[1])))


def list_to_text(values: Column) -> Column:
    return F.when(F.size(values) == 0, ".").otherwise(F.array_join(F.transform(values, lambda v: v.cast("string")), ","))


# ---------------------------------------------------------------- feature profiles (1 present, -1 absent, 0 unknown, -2 outside)


def _pairs(a: Column, b: Column, lo: Column | None, hi: Column | None) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return pairs if lo is None else F.slice(pairs, lo + 1, F.greatest(hi - lo, F.lit(0)))


def profile_distance(a: Column, b: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Positions in [lo, hi) that differ where both are known."""
    return F.size(F.filter(_pairs(a, b, lo, hi), lambda p: (p["x"] != 0) & (p["y"] != 0) & (p["x"] != p["y"])))


def profile_equal(isoform: Column, read: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """The read agrees wherever it knows."""
    return F.forall(_pairs(isoform, read, lo, hi), lambda p: (p["y"] == 0) | (p["x"] == p["y"]))


def both_present(a: Column, b: Column) -> Column:
    return F.size(F.filter(_pairs(a, b, None, None), lambda p: (p["x"] == 1) & (p["y"] == 1)))


def has_common_feature(a: Column, b: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    return F.exists(_pairs(a, b, lo, hi), lambda p: (p["x"] == 1) & (p["y"] == 1))


def all_present(isoform: Column, read: Column) -> Column:
    return F.forall(_pairs(isoform, read, None, None), lambda p: (p["x"] != 1) | (p["y"] == 1))


def mask_profile(read: Column, truth: Column) -> Column:
    return F.zip_with(read, truth, lambda x, y: F.when(y == 1, x).otherwise(0))


def blocks_of_profile(features: Column, profile: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(features.alias("f"), profile.alias("p")), lambda z: z["p"] == 1), lambda z: z["f"])


def known_range(profile: Column) -> tuple[Column, Column]:
    """(lo, hi) of the profile without unknown positions at its ends; an all-unknown profile gives (size, 0)."""
    n = F.size(profile)
    first = F.array_min(F.filter(F.transform(profile, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()))
    last = F.array_max(F.filter(F.transform(profile, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull()))
    return F.coalesce(first, n), F.coalesce(last + 1, F.lit(0))


def left_truncated(read: Column, isoform: Column) -> Column:
    a, b = F.array_position(read, 1), F.array_position(isoform, 1)
    return (a == 0) | (b == 0) | (a > b)


def right_truncated(read: Column, isoform: Column) -> Column:
    a, b = F.array_position(F.reverse(read), 1), F.array_position(F.reverse(isoform), 1)
    return (a == 0) | (b == 0) | (a > b)


def closest(values: Column, target: Column) -> Column:
    """The value nearest to a target; the first of equals."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - target).alias("d"), i.alias("i"), v.alias("v"))))["v"]
