"""Helpers shared by the training-data operators: table reading and lineage cuts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: White space of the word and normalisation rules, as a Java and a Python class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["LATIN_LETTERS", "SPACE", "BoundedCache", "classes_alike", "free_name", "materialize", "plain_latin", "table", "whole_text"]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where the frame has a column of that name in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def whole_text(text_col: str = "text"):
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


#: The letters of Latin-1, as a class body.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: Latin-1 without the numbers that are no digits and the separators that aren't Unicode white space.
_LATIN = bytes(b for b in range(256) if chr(b) not in "²³¹¼½¾\x1c\x1d\x1e\x1f")


def plain_latin(text: str) -> bool:
    """Whether a text is Latin-1 of which letters, ASCII digits and white space are all that needs telling apart."""
    try:
        return not text.encode("latin-1").translate(None, _LATIN)
    except UnicodeEncodeError:
        return False


_ALIKE: set[str] = set()


def classes_alike(text: str) -> bool:
    """Whether Python's ``re`` classes each character of a text as Unicode's letter, number and space properties do.

    Letters, decimal digits, marks, punctuation and symbols are; other numbers,
    the separators U+001C to U+001F and code points newer than Python's tables
    are not.
    """
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    new = set(text) - _ALIKE
    for c in new:
        kind = unicodedata.category(c)
        if kind in ("No", "Nl", "Cn", "Co", "Cs") or "\x1c" <= c <= "\x1f":
            return False
        _ALIKE.add(c)
    return True


class BoundedCache(dict):
    """A dict of at most ``2 * size`` entries: when the young half is full it becomes the old one, whose entries come back on use."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def find(self, key):
        """The entry of a key that the young half lacks, or None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
