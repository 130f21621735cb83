"""Maps read from JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries_of(c: Column) -> Column:
    """Entries of a map in written order; of a key written twice, the last one.

    Spark's JSON reader keeps repeated keys, and building a map from them again is an error, so
    one such record would stop the job. Only those records pay for the search.
    """
    entries, keys = F.map_entries(c), F.map_keys(c)

    def is_last(entry: Column, index: Column) -> Column:
        later = F.slice(keys, index + 2, F.size(keys))
        return ~F.array_contains(later, entry["key"])

    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeated, F.filter(entries, is_last)).otherwise(entries)
