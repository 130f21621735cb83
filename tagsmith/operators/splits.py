"""Train and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.operators.ordering import last_rows_cut


def in_test_part(key: Column, test_size: float = 0.2, seed: int = 42) -> Column:
    """True for about `test_size` of the keys, the same ones on every run and machine.

    The first eight hex digits of a hash of seed and key are compared as text.
    """
    limit = format(int(test_size * 2**32), "08x")
    text = F.coalesce(key.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
    return F.substring(digest, 1, 8) < limit


def random_split(df: DataFrame, key: str, test_size: float = 0.2,
                 seed: int = 42) -> tuple[DataFrame, DataFrame]:
    test = in_test_part(F.col(key), test_size, seed)
    return df.filter(~test), df.filter(test)


def time_split(df: DataFrame, date_col: str, key_col: str,
               n_splits: int = 5) -> tuple[DataFrame, DataFrame]:
    """Last fold in time: test is the last n // (n_splits + 1) rows, train all before.

    The cut is found once; both parts are then plain filters that reach the scan.
    """
    date, key = last_rows_cut(df, date_col, key_col, n_splits + 1)
    late = (F.col(date_col) > date) | ((F.col(date_col) == date) & (F.col(key_col) >= key))
    return df.filter(~late), df.filter(late)
