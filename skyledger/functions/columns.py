"""Column helpers shared by the operators: lookups, JSON that is one value or a list, ARNs, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions import fixed

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def lookup(mapping: dict, key: Column) -> Column:
    """Constant map lookup; a missing or null key gives null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def tactic_of(technique: Column) -> Column:
    return lookup({k: v[1] for k, v in fixed.TECHNIQUES.items()}, technique)


def tactic_rank(tactic: Column) -> Column:
    return F.coalesce(lookup({t: i for i, t in enumerate(fixed.TACTIC_ORDER)}, tactic), F.lit(99))


def is_read_action(event: Column) -> Column:
    return event.rlike("^(" + "|".join(fixed.READ_PREFIXES) + ")")


def utc_clock(us: str) -> Column:
    """Epoch microseconds as a timestamp that prints UTC clock time whatever the session time zone is."""
    return F.to_utc_timestamp(F.timestamp_micros(us), F.current_timezone())


def tail(c: Column, sep: str = "/") -> Column:
    return F.substring_index(c, sep, -1)


def arn_account(arn: Column) -> Column:
    """Fifth colon-separated part of an ARN, null when absent or empty."""
    return blank_to_null(F.try_element_at(F.split(arn, ":"), F.lit(5)))


def json_field(doc: Column, name: str) -> Column:
    """Raw JSON text of one top-level field: objects and arrays as text, strings without quotes."""
    return F.from_json(doc, f"`{name}` STRING")[name]


def json_list(text: Column) -> Column:
    """A JSON value that may be a scalar or an array, as an array of strings; null gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array_compact(F.array(text)))


def glob_to_like(pattern: Column) -> Column:
    """IAM glob to LIKE: ``*`` any run, ``?`` one character, everything else literal (escape ``!``)."""
    p = F.replace(pattern, F.lit("!"), F.lit("!!"))
    p = F.replace(p, F.lit("%"), F.lit("!%"))
    p = F.replace(p, F.lit("_"), F.lit("!_"))
    p = F.replace(p, F.lit("*"), F.lit("%"))
    return F.replace(p, F.lit("?"), F.lit("_"))


def glob_matches(pattern: Column, value: Column) -> Column:
    return F.like(value, glob_to_like(pattern), F.lit("!"))


def any_glob_matches(patterns: Column, value: Column) -> Column:
    return F.exists(patterns, lambda p: one_glob_matches(p, value))


def one_glob_matches(pattern: Column, value: Column) -> Column:
    """Glob test that only pays for LIKE where the pattern has an inner wildcard."""
    literal = ~(F.contains(pattern, F.lit("*")) | F.contains(pattern, F.lit("?")))
    return (F.when(pattern == "*", True).when(literal, pattern == value).otherwise(glob_matches(pattern, value)))


def literal_prefix(pattern: Column) -> Column:
    """Part of a glob before its first wildcard."""
    return F.regexp_extract(pattern, r"^([^*?]*)", 1)


def ipv4_to_long(ip: Column) -> Column:
    """Dotted IPv4 to an integer, null when it is not one."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.cast("bigint"))
    valid = ip.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & ~F.exists(parts, lambda x: x > 255)
    return F.when(valid, parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3])
