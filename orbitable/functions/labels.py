"""Text functions: spec parsing, combination labels, natural order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_integer(name: Column) -> Column:
    """First run of digits in a name, NULL when there is none."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits != "", digits.cast("bigint"))


def natural_order(name: str) -> list[Column]:
    """Sort keys: first integer in the name, names without digits last, then the name."""
    return [first_integer(F.col(name)).asc_nulls_last(), F.col(name).asc()]


def int_list(text: Column) -> Column:
    """'1,2,3' -> [1, 2, 3]."""
    return F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda s: F.try_to_number(s, F.lit("999999999")).cast("int"))


def nested_int_list(text: Column) -> Column:
    """'1,2 4,5' -> [[1, 2], [4, 5]]; groups are separated by space, '-' or '_'."""
    return F.transform(F.split(F.trim(text), r"[\s\-_]+"), int_list)


def frame_spec(atoms: Column) -> Column:
    """[o..., y, plane] -> struct(origin set, y atom, plane atom): the last two are y and plane."""
    return F.struct(
        F.slice(atoms, 1, F.size(atoms) - 2).alias("origin"),
        F.element_at(atoms, -2).alias("y"),
        F.element_at(atoms, -1).alias("plane"),
    )


def combo_key(names: Column) -> Column:
    """Order-insensitive key of a feature combination."""
    return F.array_join(F.array_sort(names), "|")


def tuple_text_to_names(text: Column) -> Column:
    """\"('a', 'b-2')\" -> ['a', 'b-2']; text without quotes is one name.

    A quoted token may hold commas and brackets.
    """
    quoted = F.regexp_extract_all(text, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    unquoted = F.transform(quoted, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))
    bare = F.array(F.trim(text))
    return F.when(F.size(quoted) > 0, unquoted).otherwise(bare)


def feature_label(*parts) -> Column:
    return F.concat_ws("_", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def parse_spec_value(value) -> list[list[int]]:
    """One spec value (text '1,2 4,5', int list or nested list) -> list of int lists.

    The spec has a handful of values, so it is read on the driver.
    """
    if value is None or value == "" or value == []:
        return []
    if isinstance(value, (int, float)):
        return [[int(value)]]
    if isinstance(value, str):
        groups = [g for g in re.split(r"[\s\-_]+", value.strip()) if g]
        return [[int(x) for x in g.split(",") if x] for g in groups]
    if all(isinstance(v, (int, float)) for v in value):
        return [[int(v) for v in value]]
    out = []
    for group in value:
        flat: list[int] = []
        for item in group if isinstance(group, (list, tuple)) else [group]:
            flat.extend(int(i) for i in (item if isinstance(item, (list, tuple)) else [item]))
        out.append(flat)
    return out
