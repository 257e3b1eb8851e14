"""Column functions for labels, paths, flags and feature names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of the classes.
ALIASES = {"empty": "empty", "static": "static_presence", "static_presence": "static_presence", "presence": "static_presence", "movement": "movement"}

#: The descriptors of a window, in the order of the feature vector.
DESCRIPTORS = ("mean", "std", "min", "max", "peak_to_peak", "energy", "mean_abs_diff", "max_abs_diff", "diff_energy", "std_diff", "slope")


def label(name: Column) -> Column:
    """The class that a name stands for, or null."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(name)))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")


def label_of_path(path: Column) -> Column:
    """The class named by the parent folder, or else by the start of the file name; null if neither names one."""
    parts = path_parts(path)
    start = F.regexp_extract(F.lower(F.element_at(parts, -1)), "^(static_presence|movement|presence|static|empty)", 1)
    return F.coalesce(label(F.try_element_at(parts, F.lit(-2))), label(start))


def part_starting(path: Column, start: str) -> Column:
    """The first part of the path that starts so, in lower case (sessions, quadrants); null without one."""
    return F.try_element_at(F.filter(F.transform(path_parts(path), F.lower), lambda p: p.startswith(start)), F.lit(1))


def safe_name(text: Column, fallback: str = "unnamed") -> Column:
    """A name for a path: runs of other characters than letters, digits, _ and - become _, which is trimmed at both ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def flags(bits: Column) -> Column:
    """The fields of a packet's flags: bandwidth, signal mode, space-time coding, first word invalid, low bits of the rate."""
    at = lambda shift, mask: F.shiftright(bits, shift).bitwiseAND(mask)
    return F.struct(at(0, 1).alias("bandwidth"), at(1, 3).alias("sig_mode"), at(3, 1).alias("stbc"), at(4, 1).alias("first_word_invalid"), at(5, 7).alias("mcs_low"))


def packets_of(seconds: Column, rate: Column, least: int = 2) -> Column:
    """Seconds at a rate as a number of packets, halves to even, `least` at least."""
    return F.greatest(F.lit(least), F.bround(seconds * rate).cast("int"))


def stratum(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def feature_channel(index: Column) -> Column:
    return F.floor(index / len(DESCRIPTORS)).cast("int")


def feature_name(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DESCRIPTORS)), (index % len(DESCRIPTORS) + 1).cast("int"))


def group_id(source: Column, *otherwise: Column) -> Column:
    """The source file, or where it is null or empty the other parts by `|`."""
    return F.coalesce(F.nullif(source, F.lit("")), F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in otherwise]))
