"""Ordered lookups that do not put a whole key into one task.

A window over (key, order) sorts each key in one task, which a hot key makes
long.  Here each key is cut into segments of its order; windows run inside the
segments, and one small row per segment carries values across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_previous(df: DataFrame, keys: list[str], order: list[str], segment: Column, values: dict[str, Column], *, inclusive: bool = False) -> DataFrame:
    """``df`` with, for each name of ``values``, its latest non-null value in earlier rows of the key.

    ``segment`` must not decrease along ``order``.  ``inclusive`` counts the
    row itself.  Rows that tie in ``order`` come in no fixed order, so make
    it unique.  Null keys form a key of their own.
    """
    rows = df.withColumn("__seg", segment).withColumns({f"__v_{n}": c for n, c in values.items()})
    inside = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rank = F.struct(*order)
    ends = rows.groupBy(*keys, "__seg").agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), rank)).alias(f"__e_{n}") for n in values]
    )
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__seg").alias("__s"),
        *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values],
    )
    same = F.col("__seg").eqNullSafe(F.col("__s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    rows = rows.withColumns({f"__i_{n}": F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in values})
    return rows.join(ends, same, "left").select(*df.columns, *[F.coalesce(f"__i_{n}", f"__c_{n}").alias(n) for n in values])


def running_sum(df: DataFrame, keys: list[str], order: list[str], segment: Column, amount: Column, name: str, *, inclusive: bool = False) -> DataFrame:
    """``df`` with ``name``, the sum of ``amount`` over the earlier rows of the key (and the row itself), by sums of two levels.

    ``segment`` must not decrease along ``order``; make ``order`` unique.
    """
    rows = df.withColumns({"__seg": segment, "__amount": F.coalesce(amount, F.lit(0)).cast("bigint")})
    inside = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "__seg").agg(F.sum("__amount").alias("__held"))
    ends = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__seg").alias("__s"), F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__base"))
    same = F.col("__seg").eqNullSafe(F.col("__s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    rows = rows.withColumn("__in", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    return rows.join(ends, same, "left").select(*df.columns, (F.col("__in") + F.coalesce("__base", F.lit(0))).alias(name))
