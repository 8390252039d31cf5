"""Each row next to its successor in a global order, with one shuffle and no global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that a range should hold, how many ranges there may be (beyond a terabyte they hold more, which streams
#: through a task), and how many are cut by quantiles before ranges are cut evenly.
RANGE_BYTES = 16 << 20
RANGES = 1 << 16
QUANTILES = 4096
_FAN = 64
_LEAST = -(1 << 63)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted `bounds` are at or below the key, found in two steps of about 64 comparisons."""
    if not bounds:
        return F.lit(0)
    chunks = [bounds[i : i + _FAN] for i in range(0, len(bounds), _FAN)]
    heads = F.array(*(F.lit(c[0]) for c in chunks))
    all_chunks = F.array(*(F.array(*map(F.lit, c)) for c in chunks))
    chunk = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(all_chunks, F.greatest(chunk, F.lit(1))), lambda b: b <= key))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * _FAN + inside)


def with_successors(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """`rows` with `__last`, sorted so that each row not marked `__last` is followed, in its partition, by
    its successor: rows go by `key` (integer, nulls first; ties by `payload`) into ranges, and the first row of
    the next range is repeated, marked, at a range's end. After the last row comes the first.

    Only the ranges' bounds and first keys, a few numbers a partition, pass the driver.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(_LEAST))
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    count, size, cuts = rows.agg(F.count("*"), F.sum(F.octet_length(payload)), F.percentile_approx(k, shares, 20 * QUANTILES)).first()
    n = max(1, min(RANGES, -(-(size or 0) // RANGE_BYTES)))
    few = min(n, QUANTILES)
    bounds = sorted({cuts[i * QUANTILES // few - 1] for i in range(1, few)}) if count else []
    at = _range_of(k, bounds)
    each = -(-n // QUANTILES)  # even cuts inside a quantile, for very many ranges
    if each > 1:
        low = F.element_at(F.array(*map(F.lit, [bounds[0], *bounds])), at + 1)
        high = F.element_at(F.array(*map(F.lit, [*bounds, bounds[-1]])), at + 1)
        inside = F.floor((k - low).cast("double") / F.greatest(high - low, F.lit(1)).cast("double") * each)
        at = at * each + F.greatest(F.lit(0), F.least(inside, F.lit(each - 1)))
    ranged = rows.withColumn("__range", at.cast("int")).withColumn("__key", k)
    firsts = sorted((r, first) for r, first in ranged.groupBy("__range").agg(F.min("__key")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = rows.sparkSession.createDataFrame(before, "__key long, __before int")
    copies = F.when(F.col("__before").isNull(), F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("l")))).otherwise(
        F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("l")), F.struct(F.col("__before").alias("r"), F.lit(True).alias("l")))
    )
    # heads: one row of 12 bytes for each range, RANGES at most
    spread = ranged.join(F.broadcast(heads), "__key", "left").withColumn("__at", F.explode(copies)).select(*rows.columns, "__key", "__at.r", F.col("__at.l").alias("__last"))
    parts = max(1, (max(r for r, _ in firsts) + 1) if firsts else 1)
    return spread.repartitionById(parts, F.col("r")).sortWithinPartitions("r", "__last", "__key", payload).drop("__key", "r")
