"""Column names from a header row. Only the header line is handled here."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ParseError(ValueError):
    """A problem with the file itself; the message is meant for the user."""


# Messages shown to the user.
NO_HEADER = "The file has no header row. The first row must contain column names."
NO_ROWS = "The file has a header row but no data rows."


def _joined_words(title: str) -> str:
    """The ASCII letters and digits of each word of a title, words joined by one underscore."""
    plain = unicodedata.normalize("NFKD", title.lower()).encode("ascii", "ignore").decode("ascii")
    words = ("".join(filter(str.isalnum, w)) for w in re.split("[- _\t\n\r\f\v]", plain))
    return "_".join(filter(None, words))


def normalized_names(headers: list[str | None]) -> list[tuple[str, str]]:
    """``(name, original)`` per header: ASCII snake case, unique by a running suffix."""
    titles = [h.strip() if h else "" for h in headers]
    bare = [_joined_words(t) for t in titles]
    # An empty name tells its place, one that begins with a digit gets a letter in front.
    bare = [f"c_{b}" if b[:1].isdigit() else b or f"column_{k + 1}" for k, b in enumerate(bare)]
    earlier = [bare[:k].count(b) for k, b in enumerate(bare)]
    names = [f"{b}_{n + 1}" if n else b for b, n in zip(bare, earlier)]
    return [(name, title or name) for name, title in zip(names, titles)]


def normalize_columns(df: DataFrame, headers: list[str | None] | None = None) -> DataFrame:
    """The frame renamed, each original header kept as column metadata."""
    names = normalized_names(list(df.columns) if headers is None else headers)
    return df.toDF(*(f"_{i}" for i in range(len(names)))).select(
        *(F.col(f"_{i}").alias(name, metadata={"original_name": original}) for i, (name, original) in enumerate(names))
    )
