"""DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presented(df: DataFrame, *order) -> DataFrame:
    """Presentation order for a *small, bounded* report (rows per location,
    month, category, segment ...): gather the already aggregated rows into one
    partition with a tiny shuffle and sort them there. A global ``orderBy``
    would add a range-partitioning sample job; the aggregation before this
    stays fully parallel. Not for outputs that grow with the data (those are
    left unordered) and not for top-k (``orderBy().limit()`` plans TakeOrdered).
    """
    return df.repartition(1).sortWithinPartitions(*order)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach every column of a one-row aggregate to each row of ``df`` as an
    uncorrelated scalar subquery: evaluated once (Spark merges subqueries over
    the same input), no join and no pairing of rows."""
    cols = one_row.columns
    if len(cols) == 1:
        return df.select("*", one_row.scalar().alias(cols[0]))
    # one subquery for all columns: a struct, its fields read back (the
    # identical subquery expressions are reused, so it is evaluated once)
    packed = one_row.select(F.struct(*cols).alias("_row")).scalar()
    return df.select("*", *[packed.getField(c).alias(c) for c in cols])
