"""URL expressions built on the generic URI grammar.

``parse_url`` drops ports and user names, keeps letter case and raises on bad
input, so the parts are taken with one pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import text

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)"


def _tidy(url: Column) -> Column:
    """Outer whitespace and inner tabs or line ends are not part of a URL."""
    return F.regexp_replace(text.strip(url), r"[\t\r\n]", "")


def _has_bad_brackets(authority: Column) -> Column:
    return F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]"))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, without ``www.``, query, fragment and last slashes.

    Blank becomes null; a URL with an unpaired bracket in its host is only
    lower-cased.
    """
    tidy = _tidy(url)
    scheme = F.lower(F.regexp_extract(tidy, _PARTS, 1))
    authority = F.lower(F.regexp_extract(tidy, _PARTS, 2))
    path = F.regexp_replace(F.regexp_extract(tidy, _PARTS, 3), "(?<!/)/+$", "")
    joined = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.regexp_replace(authority, r"^//www\.", "//"),
        path,
    )
    return F.when(
        tidy != "",
        F.when(_has_bad_brackets(authority), F.lower(tidy)).otherwise(joined),
    )


def domain_of(url: Column) -> Column:
    """Lower-case authority, ``www.`` kept; empty without one."""
    authority = F.lower(F.regexp_extract(_tidy(url), _PARTS, 2))
    return F.when(~_has_bad_brackets(authority), F.substr(authority, F.lit(3)))


def is_navigation(url: Column, pattern: str = fv.NAVIGATION_URL) -> Column:
    """True for author, tag, category, search and topic pages; null counts as no."""
    return F.coalesce(url, F.lit("")).rlike(f"(?i){pattern}")
