"""Statistics used by several scores: rounding, percentiles, weighted means that pass over what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.graph import saved
from tidewell.operators.ranks import FEW, largest, running


def half_up(x: Column | str, digits: int = 0) -> Column:
    """x rounded with halves towards plus infinity (so -2.5 gives -2), null for null."""
    c, p = (F.col(x) if isinstance(x, str) else x), float(10**digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def percentile_of(df: DataFrame, keys: list[str], value: str, into: str, **how) -> DataFrame:
    """df with the mean-rank percentile of value among the rows of equal keys: 100 (below + equal / 2) / n.

    A null value has none. The counts are taken per distinct value first, and summed up in the order of values by
    `running`, so that no task holds a key of many rows or values.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_equal"))
    hist = running(hist, keys, value, "_equal", **how)
    rank = F.lit(100.0) * (F.col("_below") + F.lit(0.5) * F.col("_equal")) / F.col("_all")
    ranks = hist.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), rank.alias(into))
    same = F.col(value) == F.col("_v")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def _ranked(keys: list[str], values: list[str], at_once: int = 1 << 16):
    """A function over Arrow batches that are ordered by keys: rows with percentiles of values, whole keys at a time."""

    def percentiles(group, column):
        import numpy as np
        import pyarrow as pa

        known = np.flatnonzero(~np.asarray(column.is_null()))
        x, g = column.drop_null().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), group[known]
        order = np.lexsort((x, g))
        x, g = x[order], g[order]
        first = np.concatenate(([True], g[1:] != g[:-1]))[: len(g)]
        new = first | np.concatenate(([True], (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))))[: len(g)]
        starts = lambda at: (np.flatnonzero(at), np.cumsum(at) - 1)
        (of_key, key), (of_value, value) = starts(first), starts(new)
        below, equal = (of_value[value] - of_key[key]), np.diff(np.append(of_value, len(g)))[value]
        out, has = np.zeros(len(group)), np.zeros(len(group), bool)
        out[known[order]] = 100.0 * (below + 0.5 * equal) / np.diff(np.append(of_key, len(g)))[key]
        has[known] = True
        return pa.array(out, mask=~has)

    def groups(table):
        import numpy as np

        new = np.zeros(table.num_rows, bool)
        for k in keys:
            code = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    def ranked(table, group):
        table = table.combine_chunks()
        for v in values:
            table = table.append_column(f"p_{v}", percentiles(group, table.column(v).combine_chunks()))
        return table.to_batches()

    def run(batches):
        import pyarrow as pa

        held, n, wait = [], 0, at_once
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= wait:
                table = pa.Table.from_batches(held)
                group = groups(table)
                done = int(group.searchsorted(group[-1]))  # the last key may go on
                if done:
                    yield from ranked(table.slice(0, done), group[:done])
                held, n = table.slice(done).to_batches(), n - done
                wait = max(at_once, 2 * n)
        if n:
            table = pa.Table.from_batches(held)
            yield from ranked(table, groups(table))

    return run


def percentiles_of(df: DataFrame, row: str, keys: list[str], values: list[str], most: int | None = None, few: int = FEW, **how) -> DataFrame:
    """df with p_<value> for each of values, as percentile_of has it; row names the rows, most the rows of the largest
    key, where that is known.

    If no key has more than a few rows, they are shuffled once, and tasks order the values of a key at a time. Else the
    values are laid out one below the other, ranked together and turned back into columns, so that one aggregation, one
    order and two joins do for any number of them, and no task holds a key. Both ways give the same.
    """
    if most is None:
        df = saved(df)
        most = largest(df, keys)
    if most <= few:
        schema = T.StructType(df.schema.fields + [T.StructField(f"p_{v}", T.DoubleType()) for v in values])
        return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_ranked(keys, values), schema)
    long = df.select(row, *keys, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)])).alias("_x"))
    long = long.select(row, *keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v")).where("_v is not null")
    hist = running(long.groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_equal")), [*keys, "_m"], "_v", "_equal", few=few, **how)
    hist = hist.withColumn("_p", F.lit(100.0) * (F.col("_below") + F.lit(0.5) * F.col("_equal")) / F.col("_all")).drop("_equal", "_below", "_all")
    hist = hist.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_m").alias("_hm"), F.col("_v").alias("_hv"), "_p")
    same = (F.col("_m") == F.col("_hm")) & (F.col("_v") == F.col("_hv"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    wide = long.join(hist, same).groupBy(F.col(row).alias("_row")).agg(*[F.max(F.when(F.col("_m") == i, F.col("_p"))).alias(f"p_{v}") for i, v in enumerate(values)])
    return df.join(wide, F.col(row) == F.col("_row"), "left").drop("_row")


def weighted(parts: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(score, weight used): the weighted mean of the parts that are known, over the sum of their weights.

    With no part known the score is null and the weight 0. The score stays within 0 and 100.
    """
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    mass = sum((F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    return clamp(F.when(total > 0, mass / total)), total


def growth(current: Column, baseline: Column) -> Column:
    """100 r / (r + 1) for r = current / baseline; without a baseline 100 if anything is there, else 50."""
    r = current / baseline
    plain = F.when(current < 0, F.lit(0.0)).otherwise(F.lit(100.0) * r / (r + 1))
    empty = F.when(current > 0, F.lit(100.0)).otherwise(F.lit(50.0))
    return F.when(current.isNull() | baseline.isNull(), F.lit(None)).when(baseline <= 0, empty).otherwise(plain)


def order_statistics(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, Column]], **how) -> DataFrame:
    """(keys, one column for each of wanted): the element at a 0-based place among a key's sorted values, nulls left out.

    wanted names (value column, place), the place being an expression of _n, the number of values: floor(_n / 2) is the
    upper median. A key's values are counted first, so that running sums over its different values tell the place and
    no group is gathered. A key without values has nulls.
    """
    values = sorted({v for v, _ in wanted.values()})
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("v")) for v in values])).alias("_x"))
    hist = long.groupBy(*keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_rows"))
    hist = hist.withColumn("_k", F.when(F.col("_v").isNotNull(), F.col("_rows")).otherwise(0))
    hist = running(hist, [*keys, "_m"], "_v", "_k", **how).withColumnRenamed("_all", "_n")
    at = lambda v, place: F.max(F.when((F.col("_m") == v) & F.col("_v").isNotNull() & (F.col("_below") <= place) & (F.col("_below") + F.col("_k") > place), F.col("_v")))
    return hist.groupBy(*keys).agg(*[at(v, place).alias(name) for name, (v, place) in wanted.items()])


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], **how) -> DataFrame:
    """(keys, one column for each of wanted): the quantile p of (value column, p), between the two values around the place
    (n - 1) p in proportion; the median is that of 0.5. From counts, as order_statistics."""
    places = {}
    for name, (v, p) in wanted.items():
        at = (F.col("_n") - 1) * F.lit(p)
        places |= {f"_lo_{name}": (v, F.floor(at)), f"_hi_{name}": (v, F.ceil(at))}
    found = order_statistics(df, keys, places, **how)
    sizes = df.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]).agg(*[F.count(v).alias(f"_n_{v}") for v in sorted({v for v, _ in wanted.values()})])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    j = found.join(sizes, same)
    part = lambda v, p: (F.col(f"_n_{v}") - 1) * F.lit(p) - F.floor((F.col(f"_n_{v}") - 1) * F.lit(p))
    return j.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part(v, p)).alias(n) for n, (v, p) in wanted.items()])


def upper_median_at() -> Column:
    """The place of the upper median for order_statistics."""
    return F.floor(F.col("_n") / 2)


def low_quantile_at(p: float) -> Column:
    """The place of the lower nearest rank of p for order_statistics."""
    return F.floor((F.col("_n") - 1) * F.lit(p))


def concentration(df: DataFrame, key: str, owner: str, into: str = "concentration") -> DataFrame:
    """(key, into): the corrected Herfindahl index of the owners among a key's rows, 0 to 1.

    Rows without an owner count in n but in no share; if all lack one the index is unknown; a single row gives 1.
    """
    per = df.groupBy(key, owner).agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(owner).isNotNull(), F.col("c") * F.col("c"))).alias("squares"))
    h = (F.col("squares") / (F.col("n") * F.col("n")) - 1 / F.col("n")) / (1 - 1 / F.nullif(F.col("n"), F.lit(1)))
    return out.select(key, F.when(F.col("squares").isNull(), F.lit(None)).when(F.col("n") == 1, F.lit(1.0)).otherwise(clamp(h, 0.0, 1.0)).alias(into))


def label(score: Column, high: float = 0.75, medium: float = 0.45) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "low")
