"""Row numbers over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.sources.shared import stored


def row_numbers(rows: DataFrame, order: str, name: str, strip_rows: int = 100_000) -> DataFrame:
    """Numbers from 1 by ``order`` (unique): rows are dealt to ranges, numbered there, and offset by the ranges before.

    Spark draws the range bounds from a sample. The dealt rows are a table, so that counting and numbering see the same
    ranges; the table of ranges has a row for each ``strip_rows`` rows and is all that a single window sees.
    """
    cuts = max(1, -(-rows.count() // strip_rows))
    dealt = stored(rows.repartitionByRange(cuts, order).withColumn("__strip", F.spark_partition_id()))
    sizes = dealt.groupBy("__strip").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__strip")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__strip").orderBy(order))
    return dealt.withColumn("__own", own).join(starts, "__strip").withColumn(name, F.col("__start") + F.col("__own")).drop("__strip", "__own", "__start")


def numbers_within(rows: DataFrame, group: str, order: str, name: str, strip_rows: int = 100_000) -> DataFrame:
    """Numbers from 1 by ``order`` inside each ``group`` ((group, order) is unique). A group may be as large as the table:
    the whole table is numbered in ranges, and each group subtracts what comes before it."""
    keyed = rows.withColumn("__key", F.struct(group, order))
    numbered = row_numbers(keyed, "__key", "__all", strip_rows)
    first = stored(numbered.groupBy(group).agg((F.min("__all") - 1).alias("__first")))
    return numbered.join(first, group).withColumn(name, (F.col("__all") - F.col("__first")).cast("int")).select(*rows.columns, name)
