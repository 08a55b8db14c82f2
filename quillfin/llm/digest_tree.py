"""Tree-merge of sorted digest runs, on DataFrame operations only.

Every input partition yields runs: one row a distinct key with the number of its rows and
the identifier that stays. Runs merge ``fan_in`` at a time in rounds, so a key that holds a
third of all rows reaches any task as ``fan_in`` rows at most; the root then travels down
the same tree to every run. No round gathers more than the distinct keys of its slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs that an input partition is dealt into, so that one partition's copies spread too.
SUBRUNS = 4


def with_run(df: DataFrame) -> DataFrame:
    """Add ``_run`` to rows with a number ``_uid`` each. Stage the result before use."""
    return df.withColumn("_run", F.spark_partition_id().cast("long") * SUBRUNS + F.pmod("_uid", F.lit(SUBRUNS)))


def merge_runs(rows: DataFrame, keys: list[str], id_col: str, path: str, *, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """``rows`` (staged, of :func:`with_run`) with ``_keep`` (struct id, _uid) and ``_size``.

    keys: digest columns and what verifies them (length, an independent hash): rows are
    equal only if all agree, at every level of the tree. keep: 'largest' or 'smallest'
    identifier; rows that repeat an identifier are told apart by ``_uid``. Null
    identifiers rank lowest for 'largest' and highest for 'smallest'.
    """
    if keep == "largest":
        best = F.max
        ident = F.struct(F.col(id_col).alias("id"), F.col("_uid").alias("uid"))
    else:
        best = F.min
        ident = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_uid").alias("uid"))
    runs = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    level = rows.groupBy(*keys, F.col("_run").alias("_g")).agg(best(ident).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    levels = [common.stage(level, f"{path}/level0")]
    while runs > 1:
        up = levels[-1].groupBy(*keys, F.floor(F.col("_g") / fan_in).cast("long").alias("_g"))
        levels.append(common.stage(up.agg(best("_keep").alias("_keep"), F.sum("_size").alias("_size")), f"{path}/level{len(levels)}"))
        runs = -(-runs // fan_in)
    down = levels.pop()
    while levels:
        own = levels.pop().select(*keys, "_g", F.floor(F.col("_g") / fan_in).cast("long").alias("_up"))
        down = own.join(down.withColumnRenamed("_g", "_up"), [*keys, "_up"]).drop("_up")
    return rows.join(down.withColumnRenamed("_g", "_run"), [*keys, "_run"])
