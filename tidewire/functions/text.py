"""Text expressions: whitespace, encoding repair, quality ratios, word counts.

Java regular expressions treat ``\\s`` and ``\\b`` as ASCII unless told
otherwise, so the whitespace set is written out and word rules carry ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import fixed_values as fv

# Unicode whitespace; the four separators U+001C to U+001F count as well.
SPACE = r"[\s\x1C-\x1F]"
SPACE_CHARACTERS = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
)
LETTERS = r"\p{L}"
OTHER_LETTERS = r"[\xAA\xB5\xBA\u0100-\x{10FFFF}]&&\p{L}"


def collapse_whitespace(text: Column) -> Column:
    """Runs of any Unicode whitespace become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; looks at the ends only."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def has_visible(text: Column) -> Column:
    """True where a character other than whitespace exists."""
    return text.rlike(r"(?U)[^\s\x1C-\x1F]")


def clean_extracted(text: Column) -> Column:
    """Collapse whitespace; text with nothing left is null."""
    return F.nullif(collapse_whitespace(text), F.lit(""))


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def clean_article(text: Column) -> Column:
    """Byte-order marks (also broken ones) become blanks, then collapse."""
    marks = [(fv.BYTE_ORDER_MARK, " "), (fv.BROKEN_BYTE_ORDER_MARK, " ")]
    return collapse_whitespace(_replace_all(text, marks))


def fix_encoding(text: Column, mapping: Mapping[str, str] = fv.MOJIBAKE) -> Column:
    """Undo known wrong decodings, longest first so that no rule hides another."""
    pairs = sorted(mapping.items(), key=lambda p: -len(p[0]))
    return collapse_whitespace(_replace_all(text, pairs))


def _share_of(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.when(whole.isNotNull(), F.lit(0.0)))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{LETTERS}]+", ""))


def alpha_ratio(text: Column) -> Column:
    """Letters per character; 0 for empty text."""
    return _share_of(_letters(text), F.length(text))


def latin_ratio(text: Column) -> Column:
    """Letters A-Z, a-z and À-ÿ per letter; 0 without letters.

    The letters outside that range are counted, as most texts have none.
    """
    others = F.length(text) - F.length(F.regexp_replace(text, f"[{OTHER_LETTERS}]+", ""))
    return _share_of(_letters(text) - others, _letters(text))


def noise_ratio(text: Column) -> Column:
    """Share of characters that usually come from a broken byte-order mark."""
    clean = _replace_all(text, [(c, "") for c in fv.NOISE_CHARS])
    return _share_of(F.length(text) - F.length(clean), F.length(text))


def quality_flag(alpha: Column, noise: Column) -> Column:
    """``encoding_noise`` outranks ``low_alpha``; everything else is ``ok``."""
    return (
        F.when(noise > fv.NOISY_SHARE, "encoding_noise")
        .when(alpha < fv.LOW_ALPHA, "low_alpha")
        .otherwise("ok")
    )


def is_english(lang: Column, latin: Column, flag: Column) -> Column:
    english = (lang == "en") & (latin >= fv.MIN_LATIN) & (flag == "ok")
    return F.coalesce(english, F.lit(False))


def count_word(text: Column, word: str) -> Column:
    """Whole-word, case-insensitive occurrences."""
    return F.regexp_count(text, F.lit(rf"(?iU)\b\Q{word}\E\b"))


def count_substring(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    return F.regexp_count(text, F.lit(rf"\Q{needle}\E"))


def has_junk(
    text: Column,
    words: Mapping[str, int] = fv.JUNK_WORDS,
    marker: str = fv.JUNK_MARKER,
    separator: str = fv.JUNK_SEPARATOR,
    max_separators: int = fv.MAX_SEPARATORS,
) -> Column:
    """True where a menu word, a spreadsheet error or a separator repeats too often."""
    rules = [count_word(text, w) > n for w, n in words.items()]
    rules.append(F.contains(F.lower(text), F.lit(marker.lower())))
    rules.append(count_substring(text, separator) > max_separators)
    return F.coalesce(reduce(lambda a, b: a | b, rules), F.lit(False))


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def text_digest(text: Column) -> Column:
    """A short stand-in for the text as a grouping key; null stays null."""
    return F.sha2(text, 256)
