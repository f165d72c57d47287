"""Problem 6: percentiles of very large columns by exact bisection, and counts that can be combined.

``bisect_percentiles`` keeps, for every group, the value intervals that still hold a wanted rank. A pass cuts
each interval at evenly spaced midpoints, counts the rows between them (combined on the map side), keeps the
part that holds the rank and drops all other rows, so that a pass reads a small part of what the one before
read. Ranks are resolved exactly, by values that occur, not by midpoints.

``rank_counts`` gives the additive form: counts per group and narrow value cell, which can be summed over
partitions, days or groups before ``percentiles_of_counts`` reads off percentiles with a bounded relative
error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.runtime import cut, looked_up

#: Interval tables of up to so many rows (some 100 bytes each) are sent to every task; larger ones are joined.
BROADCAST_ROWS = 200_000


def measured(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """Each id once, with only measured values: not null, finite and above zero; rows without id don't count."""
    v = F.col(value).cast("double")
    return (
        df.where(F.col(id_col).isNotNull() & (v > 0) & ~F.isnan(v) & (v < F.lit(float("inf"))))
        .withColumn(value, v)
        .dropDuplicates([id_col])
    )


def _scale(x: Column) -> Column:
    """An even scale for values of all sizes: logarithms on either side of zero, above those of the smallest double."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 746))


def _slot(x: Column, low: Column, high: Column, cuts: int) -> Column:
    """Number of the part of [low, high] that x is in; parts grow with the value where the interval is wide.

    The ends are never in the same part, and no interval of finite doubles needs more than some ten passes.
    """
    wide = ((low <= 0) & (high >= 0)) | (F.greatest(F.abs(low), F.abs(high)) / 4 > F.least(F.abs(low), F.abs(high)))
    even = (x / 2 - low / 2) / (high / 2 - low / 2)
    share = F.when(wide, (_scale(x) - _scale(low)) / (_scale(high) - _scale(low))).otherwise(even)
    return F.least(F.greatest(F.floor(share * cuts), F.lit(0)), F.lit(cuts - 1)).cast("int")


def bisect_percentiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    probabilities: list[float],
    cuts: int = 256,
    small: int = 64,
    passes: int = 40,
) -> DataFrame:
    """Exact percentiles per group: <groups>, probability, n_values, percentile.

    A percentile lies at position p * (n - 1) of the ordered values, between two of them in proportion. Null,
    NaN and infinite values don't count; a group key may be null and is then a group of its own; a group without any
    value gives no row; an empty table gives no rows. cuts is the number of parts an interval is cut into in
    a pass (255 midpoints, 8 bisections at once); an interval of at most small rows is ordered in place. No
    group is gathered in one task: a pass counts with partial aggregation, however large the group. Ranks that are
    still open after so many passes raise an error.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    rows = df.select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("__x")
    ).where((F.abs("__x") < F.lit(float("inf"))))  # neither null nor NaN nor infinite
    if not keys:
        rows, keys = rows.withColumn("__g0", F.lit(0)), ["__g0"]
    rows = cut(rows)
    ranges = cut(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high")
        )
    )
    position = F.col("__p") * (F.col("__n") - 1)
    # One row per live interval: the ranks it holds are counted from its own first value.
    live = cut(
        ranges.withColumn("__p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("__rank", F.explode(F.array(F.floor(position), F.ceil(position))))
        .groupBy(*keys, "__low", "__high", F.col("__n").alias("__rows"))
        .agg(F.sort_array(F.collect_set(F.struct(F.col("__rank").alias("at"), F.col("__rank").alias("rank")))).alias("__want"))
    )
    found = None
    for _ in range(passes):
        resolved, live = _settle(live, keys)
        found = resolved if found is None else found.unionByName(resolved)
        live = cut(live)
        left = live.agg(F.count(F.lit(1)).alias("n"), F.max("__rows").alias("rows")).first()
        if not left["n"]:
            break
        rows = _inside(rows, live, keys, left["n"])
        if left["rows"] <= small:
            found = found.unionByName(_ordered(rows, live, keys))
            break
        rows = cut(rows)
        live = cut(_narrowed(rows, live, keys, cuts))
    else:
        raise RuntimeError(f"ranks are still open after {passes} passes")
    found = cut(found)
    return _read_off(ranges, found, keys, groups, probabilities)


def _settle(live: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ranks at an end of their interval, or in one of a single value, are resolved; the others live on."""

    def known(w: Column) -> Column:
        return (F.col("__low") == F.col("__high")) | (w["at"] == 0) | (w["at"] == F.col("__rows") - 1)

    done = live.select(
        *keys, "__low", "__high", F.explode(F.filter("__want", known)).alias("w")
    ).select(
        *keys,
        F.col("w.rank").alias("__rank"),
        F.when(F.col("w.at") == 0, F.col("__low")).otherwise(F.col("__high")).alias("__value"),
    )
    rest = live.withColumn("__want", F.filter("__want", lambda w: ~known(w))).where(F.size("__want") > 0)
    return done, rest


def _inside(rows: DataFrame, live: DataFrame, keys: list[str], n_live: int) -> DataFrame:
    """The rows within a live interval of their group, with it; the intervals of a group don't overlap."""
    spans = live.groupBy(*keys).agg(F.collect_list(F.struct("__low", "__high")).alias("__spans"))
    if n_live <= BROADCAST_ROWS:
        near = rows.select(*keys, "__x").alias("r").join(F.broadcast(spans).alias("s"), _same_alias(keys), "inner")
        near = near.select(*[F.col(f"r.{k}").alias(k) for k in keys], "r.__x", "s.__spans")
    else:  # by one key that is never null, those of large groups apart
        key = F.to_json(F.struct(*keys)).alias("__key")
        near = looked_up(rows.select(key, *keys, "__x"), "__key", spans.select(key, "__spans")).where("__spans is not null")
    kept = near.select(*keys, "__x", F.get(F.filter("__spans", lambda s: F.col("__x").between(s["__low"], s["__high"])), F.lit(0)).alias("__span"))
    return kept.where("__span is not null").select(*keys, "__x", "__span.__low", "__span.__high")


def _same_alias(keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    return condition


def _narrowed(rows: DataFrame, live: DataFrame, keys: list[str], cuts: int) -> DataFrame:
    """The part of each live interval that holds a wanted rank, with its real ends and number of rows."""
    counted = (
        rows.withColumn("__slot", _slot(F.col("__x"), F.col("__low"), F.col("__high"), cuts))
        .groupBy(*keys, "__low", "__high", "__slot")
        .agg(F.count(F.lit(1)).alias("__rows"), F.min("__x").alias("__from"), F.max("__x").alias("__to"))
    )
    before = Window.partitionBy(*keys, "__low", "__high").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    on = [*keys, "__low", "__high"]
    joined = counted.alias("r").join(live.select(*on, "__want").alias("s"), _same_alias(on), "inner")
    return (
        joined.select(
            *[F.col(f"r.{k}").alias(k) for k in keys],
            F.col("__from").alias("__low"),
            F.col("__to").alias("__high"),
            "__rows",
            F.transform(
                F.filter(
                    "__want",
                    lambda w: (w["at"] >= F.col("__before")) & (w["at"] < F.col("__before") + F.col("__rows")),
                ),
                lambda w: F.struct((w["at"] - F.col("__before")).alias("at"), w["rank"].alias("rank")),
            ).alias("__want"),
        ).where(F.size("__want") > 0)
    )


def _ordered(rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of intervals of a few rows, read off their ordered values."""
    on = [*keys, "__low", "__high"]
    values = rows.groupBy(*on).agg(F.sort_array(F.collect_list("__x")).alias("__values"))
    joined = values.alias("r").join(live.select(*on, "__want").alias("s"), _same_alias(on), "inner")
    return joined.select(
        *[F.col(f"r.{k}").alias(k) for k in keys], "__values", F.explode("__want").alias("w")
    ).select(*keys, F.col("w.rank").alias("__rank"), F.get("__values", F.col("w.at").cast("int")).alias("__value"))


def _read_off(
    ranges: DataFrame, found: DataFrame, keys: list[str], groups: list[str], probabilities: list[float]
) -> DataFrame:
    by_rank = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_set(F.struct("__rank", "__value"))).alias("__values")
    )
    position = F.col("__p") * (F.col("__n") - 1)
    low = F.element_at("__values", F.floor(position))
    high = F.element_at("__values", F.ceil(position))
    joined = ranges.alias("r").join(by_rank.alias("s"), _same_alias(keys), "inner").select(
        *[F.col(f"r.{k}").alias(k) for k in keys],
        "__n",
        "__values",
        F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("__p"),
    )
    return joined.select(
        *[F.col(k).alias(g) for k, g in zip(keys, groups)],
        F.col("__p").alias("probability"),
        F.col("__n").alias("n_values"),
        (low + (high - low) * (position - F.floor(position))).alias("percentile"),
    )


def rank_counts(df: DataFrame, groups: list[str], value: str, relative_error: float = 0.005) -> DataFrame:
    """Additive counts: <groups>, cell, n_values, for positive values.

    A cell holds the values between two neighbouring powers of (1 + e) / (1 - e) with e the relative error.
    Tables of different partitions or days are combined by union and summing n_values per group and cell.
    Values that are null, not finite or not above zero don't count.
    """
    base = F.ln(F.lit((1 + relative_error) / (1 - relative_error)))
    v = F.col(value).cast("double")
    return (
        df.where((v > 0) & ~F.isnan(v) & (v < F.lit(float("inf"))))
        .groupBy(*groups, F.floor(F.ln(v) / base).cast("int").alias("cell"))
        .agg(F.count(F.lit(1)).alias("n_values"))
    )


def percentiles_of_counts(
    counts: DataFrame, groups: list[str], probabilities: list[float], relative_error: float = 0.005
) -> DataFrame:
    """<groups>, probability, n_values, percentile from combined counts, within the relative error.

    The percentile is that of the value at position ceil(p * n), at least the first. The interval of cells
    is narrowed to the one whose counts below and up to it enclose the rank. A group has as many rows here as
    it has cells, at most some thousand at any number of values.
    """
    summed = counts.groupBy(*groups, "cell").agg(F.sum("n_values").alias("__n"))
    order = Window.partitionBy(*groups).orderBy("cell")
    upto = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(*groups))
    ratio = (1 + relative_error) / (1 - relative_error)
    placed = summed.withColumn("__upto", upto).withColumn("n_values", total).withColumn(
        "probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    )
    rank = F.greatest(F.ceil(F.col("probability") * F.col("n_values")), F.lit(1))
    return placed.where((rank > F.col("__upto") - F.col("__n")) & (rank <= F.col("__upto"))).select(
        *groups,
        "probability",
        "n_values",
        (F.pow(F.lit(ratio), F.col("cell")) * F.lit(2 * ratio / (1 + ratio))).alias("percentile"),
    )
