"""Theme flags over one delimited theme string."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_themes(themes: Column) -> Column:
    return F.lower(F.coalesce(themes, F.lit("")))


def matches_any(themes: Column, patterns: Sequence[str]) -> Column:
    """True where any pattern is found.

    Patterns without special characters are searched as bytes, which costs half of
    a regular expression; the others form one alternation.
    """
    plain = [p for p in patterns if re.fullmatch(r"[\w ,;:/-]+", p)]
    special = [p for p in patterns if p not in plain]
    tests = [F.contains(themes, F.lit(p)) for p in plain]
    if special:
        tests.append(themes.rlike("|".join(special)))
    return reduce(lambda a, b: a | b, tests)


def theme_flags(themes: Column, lists: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """0/1 columns by name, ready for ``withColumns``."""
    return {name: matches_any(themes, patterns).cast("int") for name, patterns in lists.items()}
