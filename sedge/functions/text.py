"""Text expressions (STR-1..9, STR-11, FLT-10, FLT-14); built-in functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text breaks into lines: the same places as Python's str.splitlines.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85  ]"
#: Import and re-export statements with `from`, and require calls; `(?dU)` gives Python's `.`, `\\s` and line rules.
JS_IMPORT = r"""(?dU)(?:(?:import|export)\s+.*?\s+from\s+|require\()["']([^"']+)["']"""


def lines(text: Column) -> Column:
    """Lines without their breaks; no last empty line; none for an empty text; null for null."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strict_utf8(content: Column) -> Column:
    """The text, or null if the bytes aren't valid UTF-8 (SRC-5)."""
    return F.when(F.is_valid_utf8(content.cast("string")), universal_newlines(content.cast("string")))


def any_keyword(text: Column, words: Iterable[str]) -> Column:
    """Some word is a substring of the lower-cased text."""
    return F.exists(F.array(*map(F.lit, sorted(words))), lambda w: F.lower(text).contains(w))


def strip(text: Column) -> Column:
    """Python's str.strip."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def last_word(text: Column) -> Column:
    return F.element_at(F.split(strip(text), r"(?U)[\s\x1c-\x1f]+"), -1)


def names_word(text: Column, word: Column) -> Column:
    """word stands in text between word boundaries, in any case."""
    return F.regexp_like(text, F.concat(F.lit("(?iU)\\b\\Q"), word, F.lit("\\E\\b")))


def truncated(text: Column, most: int, marker: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def js_imports(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JS_IMPORT), 1)
