"""Category names: `type/root-cause[/subcategory]`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.params import VALID_PREFIXES


def report_category(name: Column) -> Column:
    """All segments but the last one when there are three or more."""
    parts = F.split(name, "/")
    return F.when(F.size(parts) >= 3,
                  F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(name)


def subcategory(name: Column) -> Column:
    parts = F.split(name, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(F.lit(""))


def list_category(name: Column) -> Column:
    """The category list groups by the first two segments."""
    return F.substring_index(name, "/", 2)


def has_valid_prefix(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [name.startswith(p) for p in VALID_PREFIXES])


def slug(text: Column) -> Column:
    """All words in lower case, joined by hyphens: different errors stay apart."""
    return F.array_join(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), "-")


def compose(kind: Column, root_cause: Column, systemic: Column, test_id: Column) -> Column:
    """Only isolated test flakes and bugs carry the failing test as a third segment."""
    root = F.when((kind == "test-flake") & systemic, F.concat(F.lit("systemic-"), root_cause)) \
            .otherwise(root_cause)
    scoped = kind.isin("test-flake", "bug") & ~systemic & (test_id != "")
    return F.concat_ws("/", kind, root, F.when(scoped, test_id))
