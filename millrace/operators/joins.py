"""Join strategies: guarded broadcast, and full or conditional salting against skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Auto-broadcast limit, hard ceiling of a broadcast relation, and default cap of results at the driver.
AUTO_BROADCAST = 10 * 1024**2
BROADCAST_CEILING = 8 * 1024**3
DRIVER_RESULT_CAP = 1024**3
#: Longest list of hot keys that is put into the plan as literals.
KEY_LIST = 1000
#: Room that a broadcast hot key is reckoned with.
HOT_KEY_BYTES = 64


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a relation's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def choose_join(small: DataFrame, limit: int = AUTO_BROADCAST, driver_cap: int = DRIVER_RESULT_CAP) -> str:
    """``broadcast`` if the estimated size fits limit, driver cap and ceiling, else ``merge``."""
    return "broadcast" if plan_bytes(small) <= min(limit, driver_cap, BROADCAST_CEILING) else "merge"


def guarded_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", limit: int = AUTO_BROADCAST) -> DataFrame:
    """Join that broadcasts ``small`` only if it is small enough."""
    return big.join(small.hint(choose_join(small, limit)), list(on), how)


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left lookup whose misses get default values."""
    joined = guarded_join(big, small, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def hot_keys(df: DataFrame, key: str, above: int) -> DataFrame:
    """Keys with more than ``above`` rows: (key, count).  Counted with partial sums, so skew costs nothing."""
    return df.groupBy(key).count().where(F.col("count") > above)


def salt_of(df: DataFrame, n: int, row_key: Sequence[str] | None = None, seed: int | None = None) -> Column:
    """Salt 0..n-1: a hash of the row (or of ``row_key``), or random with a seed."""
    if seed is not None:
        return F.floor(F.rand(seed) * n).cast("int")
    return F.pmod(F.xxhash64(*(row_key or df.columns)), F.lit(n)).cast("int")


def _check(how: str) -> None:
    if how not in ("inner", "left"):
        raise ValueError(f"salting replicates the right side, so a {how} join would repeat or miss rows")


def salted_join(big: DataFrame, small: DataFrame, key: str, n: int = 16, how: str = "inner", row_key: Sequence[str] | None = None, seed: int | None = None) -> DataFrame:
    """Every key is dealt over ``n`` salts; the small side is repeated ``n`` times.

    Both sides are shuffled and sorted: the estimate by which Spark broadcasts leaves
    out the repetition, so it would send ``n`` times what its limit allows.
    """
    _check(how)
    left = big.withColumn("__salt", salt_of(big, n, row_key, seed))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right.hint("merge"), [key, "__salt"], how).drop("__salt")


def conditional_salted_join(big: DataFrame, small: DataFrame, key: str, above: int, n: int = 16, how: str = "inner", row_key: Sequence[str] | None = None, seed: int | None = None) -> DataFrame:
    """Only keys with more than ``above`` rows are salted, and only their rows of ``small`` repeated.

    Up to KEY_LIST hot keys become literals of the plan; more are joined to both
    sides as a flag, broadcast if their number allows, so it is not limited.
    """
    _check(how)
    hot = hot_keys(big, key, above).select(key)
    listed = [r[0] for r in hot.limit(KEY_LIST + 1).collect()]
    if len(listed) <= KEY_LIST:
        is_hot = F.coalesce(F.col(key).isin(listed), F.lit(False)) if listed else F.lit(False)
        left, right = big.withColumn("__hot", is_hot), small.withColumn("__hot", is_hot)
    else:
        # A join on the skewed key is what salting is to avoid, so the flags are broadcast if their size allows.
        flags = hot.withColumn("__hot", F.lit(True))
        flags = flags.hint("broadcast") if flags.count() * HOT_KEY_BYTES <= min(DRIVER_RESULT_CAP, BROADCAST_CEILING) else flags
        left, right = (d.join(flags, key, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False))) for d in (big, small))
    left = left.withColumn("__salt", F.when(F.col("__hot"), salt_of(big, n, row_key, seed)).otherwise(0)).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def busiest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows under the busiest value of ``keys``: max_rows."""
    return df.groupBy(*keys).count().agg(F.max("count").alias("max_rows"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def vanished(target: DataFrame, source_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target`` whose key is no longer in the source."""
    return target.join(source_keys.select(*keys), list(keys), "left_anti")


def not_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is NOT IN the only column of ``keys``, by SQL's rules for null.

    A null among the keys leaves no row; a null in ``column`` stays only if there
    are no keys.  Otherwise it is an anti-join, which shuffles where a null-aware one
    would have to broadcast.
    """
    key = keys.columns[0]
    n, known = keys.agg(F.count("*"), F.count(key)).first()
    if not n:
        return df
    if known < n:
        return df.where(F.lit(False))
    return df.where(F.col(column).isNotNull()).join(keys.select(F.col(key).alias(column)), column, "left_anti")
