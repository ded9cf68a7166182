"""Exact percentiles by distributed selection: no sort of all values.

Three scans, each of which leaves the driver and the shuffle a bounded table:

1. a quantile sketch (KLL, of a fixed size) brackets the wanted ranks of each
   group, with a margin of several times the sketch's error;
2. the values below each bracket are counted, and a second sketch divides the
   bracket into ``GRID`` steps, a few of which hold the wanted ranks;
3. only values in those steps (about a 20,000th of the rows) are counted one
   by one, and the ranks are read off their running counts.

The scans are one lazy plan: nothing runs before an action and nothing is
written. Groups are labels, few enough to be broadcast with their sketches;
those of whole columns are one row, attached as a scalar subquery.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svcops.functions.frames import with_scalars

#: The first sketch's rank error is about the 10,000th part of its rows.
ACCURACY = 10_000
#: Share of the rows taken on either side of a wanted rank.
MARGIN = 5 / ACCURACY
#: Steps of a bracket; the second sketch errs by an eighth of a step.
GRID = 100


def _size(accuracy: int) -> int:
    """The parameter of a KLL sketch that errs by one part in ``accuracy`` (its
    error is about 2.3 / k ** 0.9, 99 of 100 times), within what Spark allows."""
    return min(max(math.ceil((2.3 * accuracy) ** (1 / 0.9)), 8), 65_535)


def percentiles(df: DataFrame, group: str, value: str, shares: tuple[float, ...], name: str = "p") -> DataFrame:
    """One row per non-null ``group``: the interpolated percentiles of the
    non-null values as columns ``<name>0, <name>1, ...`` (as pandas and SQL's
    ``percentile_cont`` define them). Groups are few (labels)."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v0")).where("g IS NOT NULL AND v0 IS NOT NULL")
    found = _selected(rows, ["v0"], shares)
    return found.select(F.col("g").alias(group), *[F.col("v0_q")[i].alias(f"{name}{i}") for i in range(len(shares))])


def column_percentiles(df: DataFrame, values: tuple[str, ...], shares: tuple[float, ...]) -> DataFrame:
    """One row: for each of the ``values`` an array ``<value>_q`` of its
    percentiles; the columns are scanned together."""
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)])
    found = _selected(rows, [f"v{i}" for i in range(len(values))], shares, grouped=False)
    return found.select(*[F.col(f"v{i}_q").alias(f"{c}_q") for i, c in enumerate(values)])


def _selected(rows: DataFrame, values: list[str], shares: tuple[float, ...], grouped: bool = True) -> DataFrame:
    """``g`` (if grouped) and ``<value>_q``, an array with the percentile of each share."""
    by = ["g"] if grouped else []

    def beside(few: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(few), "g") if grouped else with_scalars(rows, few)

    targets = [(f"{v}_{i}", v, float(p)) for v in values for i, p in enumerate(shares)]

    def sketch(v: Column, at: list[float], accuracy: int) -> Column:
        """The quantiles ``at`` of the values, null where there are none. A sketch
        leaves NaN out; it is the largest value here, so it stands as infinity."""
        made = F.kll_sketch_agg_double(F.nanvl(v, F.lit(float("inf"))), F.lit(_size(accuracy)))
        got = F.kll_sketch_get_quantile_double(made, F.array(*[F.lit(float(x)) for x in at]))
        got = F.transform(got, lambda x: F.when(x == float("inf"), float("nan")).otherwise(x))
        return F.when(F.count(v) > 0, got)

    first = []
    for v in values:  # one sketch a column
        at = [min(max(p + m, 0.0), 1.0) for p in shares for m in (-MARGIN, MARGIN)]
        first += [F.count(v).alias(f"n_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), sketch(F.col(v), at, ACCURACY).alias(f"sketch_{v}")]
    one = rows.groupBy(*by).agg(*first)
    ends = []
    for k, (t, v, p) in enumerate(targets):
        i = 2 * (k % len(shares))
        few = F.col(f"n_{v}") * MARGIN < 3  # the margin must hold some ranks
        ends += [(F.when(few, F.col(f"min_{v}")).otherwise(F.col(f"sketch_{v}")[i]) if p > MARGIN else F.col(f"min_{v}")).alias(f"lo_{t}"),
                 (F.when(few, F.col(f"max_{v}")).otherwise(F.col(f"sketch_{v}")[i + 1]) if p < 1 - MARGIN else F.col(f"max_{v}")).alias(f"hi_{t}")]
    one = one.select(*by, *[f"n_{v}" for v in values], *ends)

    second = [F.max(f"n_{v}").alias(f"n_{v}") for v in values]
    grid = [i / GRID for i in range(GRID + 1)]
    for t, v, _ in targets:
        inside = (F.col(v) >= F.col(f"lo_{t}")) & (F.col(v) <= F.col(f"hi_{t}"))
        second += [F.max(f"lo_{t}").alias(f"lo_{t}"), F.max(f"hi_{t}").alias(f"hi_{t}"),
                   F.count_if(F.col(v) < F.col(f"lo_{t}")).alias(f"below_{t}"), F.count_if(inside).alias(f"inside_{t}"),
                   sketch(F.when(inside, F.col(v)), grid, 8 * GRID).alias(f"grid_{t}")]
    two = beside(one).groupBy(*by).agg(*second)

    kept = []
    for k, (t, v, p) in enumerate(targets):
        rank = (F.col(f"n_{v}") - 1) * F.lit(p)
        step = [(f(rank) - F.col(f"below_{t}")) / F.greatest(F.col(f"inside_{t}"), F.lit(1)) * GRID for f in (F.floor, F.ceil)]
        a, b = F.floor(step[0]).cast("int") - 2, F.ceil(step[1]).cast("int") + 2
        few = F.col(f"inside_{t}") < 3 * GRID
        from_ = F.when(few | (a <= 0), F.col(f"lo_{t}")).otherwise(F.get(f"grid_{t}", a))
        upto = F.when(few | (b >= GRID), F.col(f"hi_{t}")).otherwise(F.get(f"grid_{t}", b))
        kept.append(F.struct(F.lit(k).alias("k"), rank.alias("rank"), F.col(f"below_{t}").alias("below"), F.col(f"lo_{t}").alias("lo"),
                             from_.alias("a"), upto.alias("b")).alias(f"t_{t}"))
    three = beside(two.select(*by, *kept))
    # values of the bracket up to the wanted steps; those before the steps count as one
    held = [F.struct(F.col(f"t_{t}").alias("t"), F.col(v).alias("v")) for t, v, _ in targets]
    near = F.explode(F.filter(F.array(*held), lambda x: (x["v"] >= x["t"]["lo"]) & (x["v"] <= x["t"]["b"]))).alias("x")
    counted = three.select(*by, near).groupBy(
        *by, F.col("x.t.k").alias("k"), F.when(F.col("x.v") >= F.col("x.t.a"), F.col("x.v")).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.max("x.t.rank").alias("rank"), F.max("x.t.below").alias("below"))
    upto = F.sum("n").over(Window.partitionBy(*by, "k").orderBy(F.col("v").asc_nulls_first())) + F.col("below")
    ranked = counted.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("v")))

    picked = ranked.groupBy(*by, "k").agg(at(F.floor("rank")).alias("low"), at(F.ceil("rank")).alias("high"),
                                          F.max(F.col("rank") - F.floor("rank")).alias("rest"))
    sure = [F.coalesce(c, F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double")) for c in ("low", "high")]
    between = F.when(F.col("rest") == 0, sure[0]).otherwise(sure[0] + (sure[1] - sure[0]) * F.col("rest"))
    picked = picked.select(*by, "k", between.alias("q"))
    wide = []
    for v in values:
        own = [F.max(F.when(F.col("k") == k, F.col("q"))) for k, (_, w, _) in enumerate(targets) if w == v]
        wide.append(F.array(*own).alias(f"{v}_q"))
    out = picked.groupBy(*by).agg(F.count("k").alias("_found"), *wide)
    return out.where("_found > 0").drop("_found")  # a whole column without rows has no row
