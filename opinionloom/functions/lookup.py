"""Dictionary lookups inside the row.

A map column is searched key by key, so a dictionary of thousands of words is
spread over many small maps: one array slot per hash value, a handful of words
in each. The table is a literal of the plan, which is why its size is checked.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest dictionary that may travel inside the plan; larger ones are joined.
MAX_INLINE = 50_000


def word_table(values: Mapping[str, int]) -> Column:
    if len(values) > MAX_INLINE:
        raise ValueError(f"dictionary of {len(values)} words is too large to inline; pass a DataFrame")
    n_slots = max(1, len(values) // 4)
    slots: list[dict[str, int]] = [{} for _ in range(n_slots)]
    for word, value in values.items():
        slots[zlib.crc32(word.encode()) % n_slots][word] = value
    return F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,int>>")


def word_value(word: Column, values: Mapping[str, int]) -> Column:
    """The value of `word`, or NULL when it is not in the dictionary."""
    if not values:
        return F.lit(None).cast("int")
    n_slots = max(1, len(values) // 4)
    return F.try_element_at(F.get(word_table(values), (F.crc32(word) % n_slots).cast("int")), word)


def number_list(values: Iterable[int]) -> Column:
    """A literal array, parsed once by the optimizer."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<int>")


def is_listed(word: Column, listed: Iterable[str]) -> Column:
    """Membership in a bounded word list (a hash set inside the plan)."""
    options = list(listed)
    return word.isin(options) if options else F.lit(False)


def inline_or_none(df: DataFrame, limit: int = MAX_INLINE) -> list | None:
    """The rows of a dictionary table when it is small enough to inline, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
