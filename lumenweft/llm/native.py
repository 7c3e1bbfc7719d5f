"""Expressions on whole texts that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweft.llm.common import BLANKS

_BLANKS = BLANKS.decode()


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it and wherever the plan moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = 5) -> Column:
    """The number of words that lie in a window of ``window`` words found twice or more in the same row.

    Windows are hashed (64 bits). Only rows that repeat a window at all sort their windows; a word counts once.
    """

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(x.h == F.get(s, k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False)))
        at = F.array_sort(F.transform(twice, lambda x: x.i))
        return let(at, lambda at: F.aggregate(F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window))), F.lit(0), lambda n, x: n + x))

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)).otherwise(0)

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
        return F.when(F.size(h) >= window, let(windows, of_windows)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")
