"""One compiler from rule conditions to Columns, for filters, alert rules, lifecycle rules and graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"==": "eq", "equals": "eq", "!=": "ne", ">": "gt", ">=": "gte", "ge": "gte", "<": "lt", "<=": "lte", "le": "lte", "greater_than": "gt", "less_than": "lt"}


def condition(column: Column, operator: str, value) -> Column:
    """A boolean that is never null: a missing field or a value of another type is false."""
    op = ALIASES.get(operator, operator)
    if op in ("gt", "gte", "lt", "lte"):
        c = column.try_cast("double")
        v = float(value)
        out = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    elif op == "eq":
        out = column == value
    elif op == "ne":
        out = column != value
    elif op == "in":
        out = column.isin(list(value)) if len(value) else F.lit(False)
    elif op == "contains":
        out = F.contains(column.cast("string"), F.lit(value))
    elif op == "starts_with":
        out = F.startswith(column.cast("string"), F.lit(value))
    elif op == "ends_with":
        out = F.endswith(column.cast("string"), F.lit(value))
    elif op == "has_tag":
        out = F.array_contains(column, value)
    elif op == "matches":
        out = column.cast("string").rlike(value)
    else:
        raise ValueError(f"unknown operator {operator}")
    return F.coalesce(out, F.lit(False))


def all_of(conditions: list[tuple[str, str, object]]) -> Column:
    """The conjunction of (field, operator, value) conditions; true for none."""
    return reduce(lambda a, b: a & b, [condition(F.col(f), o, v) for f, o, v in conditions], F.lit(True))


def equals(values: dict) -> Column:
    """Equality on each column of a mapping."""
    return all_of([(k, "eq", v) for k, v in values.items()])


def first_match(rules: list[tuple[str, list[tuple[str, str, object]]]], default: str | None = None) -> Column:
    """Name of the first rule whose conditions all hold."""
    out = None
    for name, conditions in rules:
        out = F.when(all_of(conditions), name) if out is None else out.when(all_of(conditions), name)
    return F.lit(default) if out is None else out.otherwise(default)


def required(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def length_between(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(c).between(low, high), F.lit(False))


def in_range(c: Column, low: float, high: float) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+([/?#]\S*)?$"), F.lit(False))


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"), F.lit(False))


def is_port(c: Column) -> Column:
    return F.coalesce(c.try_cast("int").between(1, 65535), F.lit(False))


def is_one_of(c: Column, values: list) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def is_duration(c: Column) -> Column:
    """Numbers with units, as 1h30m or 250ms."""
    return F.coalesce(c.rlike(r"^[+-]?([0-9]+(\.[0-9]+)?(ns|us|ms|s|m|h))+$"), F.lit(False))


def has_extension(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(c, r"(\.[A-Za-z0-9]+)$", 1)).isin([a.lower() for a in allowed]), F.lit(False))


def has_pattern(c: Column, p: str) -> Column:
    return F.coalesce(c.rlike(p), F.lit(False))


def only_if(when: Column, rule: Column) -> Column:
    """A rule that counts only where a condition holds."""
    return ~F.coalesce(when, F.lit(False)) | rule


def globbed(name: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a glob of `include` (none: any) matches a whole name and none of `exclude` does. Stars do not stop at slashes."""
    import fnmatch

    hit = lambda globs: reduce(lambda a, b: a | b, [name.rlike("(?s)^" + fnmatch.translate(g).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$") for g in globs], F.lit(False))
    return F.coalesce(name.isNotNull() & (hit(include) if include else F.lit(True)) & ~hit(exclude), F.lit(False))
