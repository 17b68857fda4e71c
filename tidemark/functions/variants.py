"""Values inside JSON, on VARIANT: inside the JVM, without a schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIST, _OBJECT = "array<variant>", "map<string,variant>"


def _members(step: str) -> Callable[[Column], Column]:
    """What gives an array of what one step of a path leads to from a value."""
    return lambda value: _step(value, step)


def _step(value: Column, step: str) -> Column:
    elements, members = value.try_cast(_LIST), value.try_cast(_OBJECT)
    none = F.array().cast(_LIST)
    if step == "*":
        return F.coalesce(elements, F.map_values(members), none)
    out = F.when(F.map_contains_key(members, F.lit(step)), F.array(F.element_at(members, F.lit(step))))
    if step.isascii() and step.isdigit():
        place = F.lit(min(int(step), (1 << 31) - 1))
        out = out.when(F.size(elements) > place, F.array(F.get(elements, place)))
    return out.otherwise(none)


def json_values(text: Column, path: str) -> Column:
    """Array of the values, as variants, at a dotted path in which ``*`` stands for every element or member and a number for an
    element. Members come by name. A null text, and one that is no JSON, has none; a JSON null is a value.
    """
    document = F.try_parse_json(text)
    now = F.when(document.isNotNull(), F.array(document)).otherwise(F.array().cast(_LIST))
    for step in path.split("."):
        now = F.flatten(F.transform(now, _members(step)))
    return now


def as_texts(values: Column) -> Column:
    """Strings as they are, other values as JSON."""
    return F.transform(values, lambda x: F.coalesce(x.try_cast("string"), F.to_json(x)))
