"""Text functions that jobs need and Spark has with other edge cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(text: Column) -> Column:
    """Split at runs of white space: empty strings at the end go, one at the start stays.

    An empty text is one empty word; a text of white space only has no word.
    """
    trimmed = F.regexp_replace(text, r"\s+$", "")
    parts = F.when(text.rlike(r"^\s+$"), F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))
    return F.when(text.rlike(r"\s"), parts).otherwise(F.array(text))


def split_words_py(text: str) -> list[str]:
    """The same on a plain string."""
    import re

    parts = re.split(r"\s+", text) if re.search(r"\s", text) else [text]
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    return [] if parts == [""] and text != "" else parts
