"""Reading one mailbox, and building filters from what is asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many values a membership is a literal list; beyond it, a semi-join.
LITERAL_VALUES = 1000


def scoped(df: DataFrame, mailbox, column: str = "mailbox_id") -> DataFrame:
    """The rows of one mailbox; without a mailbox there are none."""
    return df.limit(0) if mailbox is None else df.where(F.col(column) == F.lit(mailbox))


def match(df: DataFrame, conditions: dict) -> DataFrame:
    """Rows that meet every condition: a value is equality, None is IS NULL, a list is membership and an empty list nothing."""
    for name, wanted in conditions.items():
        if wanted is None:
            df = df.where(F.col(name).isNull())
        elif isinstance(wanted, (list, tuple, set, frozenset)):
            values = list(wanted)
            if not values:
                return df.limit(0)
            if len(values) <= LITERAL_VALUES:
                df = df.where(F.col(name).isin(values))
            else:
                kind = df.schema[name].dataType.simpleString()
                listed = df.sparkSession.createDataFrame([(v,) for v in values], f"__value {kind}").distinct()
                df = df.join(listed, F.col(name) == F.col("__value"), "left_semi")
        else:
            df = df.where(F.col(name) == F.lit(wanted))
    return df


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def keyset_before(time_col: str, id_col: str, before_time, before_id) -> Column:
    """Rows older than a place in newest-first order: a comparison of (time, id), written so that the bound on the time reaches the scan."""
    time, at, number = F.col(time_col), F.lit(before_time).cast("timestamp_ntz"), F.lit(before_id)
    return (time <= at) & ((time < at) | (F.col(id_col) < number))


def newest(df: DataFrame, time_col: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` newest rows (1 to 1000), ties by id; a top-k, not a sort."""
    if not 1 <= n <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    return df.orderBy(F.desc(time_col), F.desc(id_col)).limit(n)
