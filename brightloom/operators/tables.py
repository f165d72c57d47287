"""Catalog and set algebra: paging, upserts, deletes, deduplication in order, profiles and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import strip
from brightloom.runtime import cut

NULL_TOKENS = ["", "null", "none", "nan", "n/a", "na"]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a listing; order must end in a key for pages to be stable."""
    return df.orderBy(*order).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key isn't in new, and the new rows; null keys never match."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def updated(df: DataFrame, where: Column, changes: dict[str, Column], allowed: set[str]) -> DataFrame:
    """The rows with the allowed changes made where the condition is true; other changes are ignored."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items() if c in allowed})


def first_of(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of every key in an order of columns; found by partial aggregation, so hot keys don't hurt.

    Null keys are keys like others; ties of the order take the smallest row.
    """
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min(rank).alias("__first")).select("__first.*").select(*df.columns)


def group_copies(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """Per stripped text: first_id, copies, and digest; null texts are one group."""
    key = F.md5(strip(F.col(text)))
    return df.groupBy(key.alias("digest")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, null_count, distinct_count, n_int, n_float, n_date and dtype.

    dtype, in this order: empty_or_null, datetime (over half look like dates), integer (over four fifths),
    float (over four fifths numeric), mixed_numeric_string (over half numeric), string. Null tokens don't count
    as values. All columns are profiled in one pass over the table.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("x")).select("x.column", strip(F.col("x.value")).alias("value"))
    empty = F.col("value").isNull() | F.lower("value").isin(NULL_TOKENS)
    real = F.when(~empty, F.col("value"))
    is_int = real.rlike(r"^[+-]?[0-9]+$")
    is_float = real.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    is_date = real.rlike(r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}")
    counts = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("null_count"), F.count_distinct(real).alias("distinct_count"),
        F.count_if(is_int).alias("n_int"), F.count_if(is_float & ~is_int).alias("n_float"), F.count_if(is_date).alias("n_date"),
    )
    values = F.col("n") - F.col("null_count")
    numeric = F.col("n_int") + F.col("n_float")
    dtype = (
        F.when(values == 0, "empty_or_null").when(F.col("n_date") > values * 0.5, "datetime").when(F.col("n_int") > values * 0.8, "integer")
        .when(numeric > values * 0.8, "float").when(numeric > values * 0.5, "mixed_numeric_string").otherwise("string")
    )
    return counts.withColumn("dtype", dtype)


def outlier_bounds(df: DataFrame, groups: list[str], value: str, accuracy: int = 100_000) -> DataFrame:
    """Per group: q1, q3 and the bounds 1.5 interquartile ranges outside them, by a mergeable bounded summary."""
    q = F.percentile_approx(value, [0.25, 0.75], accuracy)
    bounds = df.groupBy(*groups).agg(q.alias("q")).select(*groups, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return bounds.withColumn("low", F.col("q1") - iqr * 1.5).withColumn("high", F.col("q3") + iqr * 1.5)


def profile_issues(profiled: DataFrame) -> DataFrame:
    """column, issue, severity of a profile: missing values by their share, mixed types, and columns without values."""
    share = F.col("null_count") / F.greatest(F.col("n"), F.lit(1))

    def one(when: Column, issue: str, severity: Column) -> Column:
        return F.when(when, F.struct(F.lit(issue).alias("issue"), severity.alias("severity")))

    found = F.array_compact(
        F.array(
            one(F.col("null_count") > 0, "missing", F.when(share > 0.3, "high").when(share > 0.1, "medium").otherwise("low")),
            one(F.col("dtype") == "mixed_numeric_string", "mixed", F.lit("high")),
            one(F.col("dtype") == "empty_or_null", "empty", F.lit("high")),
        )
    )
    return profiled.select("column", F.explode(found).alias("x")).select("column", "x.issue", "x.severity")


def severity_counts(issues: DataFrame) -> DataFrame:
    """high, medium, low and total, one row, also for no issues."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count(F.lit(1)).alias("total"))


def imputed(df: DataFrame, column: str, groups: list[str], accuracy: int = 100_000) -> DataFrame:
    """df with nulls of a numeric column replaced by the lower median of the others in the row's group, by a mergeable bounded
    summary; a group without values keeps its nulls. Group keys may be null."""
    medians = df.where(F.col(column).isNotNull()).groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(F.percentile_approx(column, 0.5, accuracy).alias("__m"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    joined = df.join(medians, same, "left") if groups else df.join(F.broadcast(medians), how="left")
    return joined.select(*[F.coalesce(column, "__m").alias(column) if c == column else c for c in df.columns])


def most_common(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value that isn't null, the smallest of several; counts are combined before the shuffle."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("m")).select(F.col("m.v").alias(column), (-F.col("m.n")).alias("n"))


def imputed_common(df: DataFrame, column: str) -> DataFrame:
    """df with nulls of a column replaced by its most frequent value, one row that is broadcast."""
    common = F.broadcast(most_common(df, column).select(F.col(column).alias("__m")))
    return df.join(common, how="left").select(*[F.coalesce(column, "__m").alias(column) if c == column else c for c in df.columns])


def flattened(df: DataFrame, column: str) -> DataFrame:
    """df with a struct column's fields as columns <column>_<field>, one level deep; what is deeper stays as it is."""
    fields = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields])


def streaks(df: DataFrame, key: str, order: str, failed: Column, stretches: int | None = None) -> DataFrame:
    """<key>, n_failures, first_<order> of every run of consecutive failures of a key, by an order column.

    Keys and order are cut into stretches of about as many rows, at boundaries that Spark samples, however keys and values are
    spread; stretches: their number, as many as shuffle partitions if not given. Runs are found in each stretch of a key, and only
    those that touch an end of their stretch are joined over the stretches, so that a key of a third of all rows is
    worked on in many tasks. Rows without key or order are left out; of rows of equal order, failures come first.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(
        F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(failed, F.lit(False)).cast("int").alias("f")
    )
    by = ["k", "o", F.desc("f")]
    ranged = rows.repartitionByRange(stretches, *by) if stretches else rows.repartitionByRange(*by)
    rows = cut(ranged.withColumn("b", F.spark_partition_id()))  # cut, as a stretch must stay the same wherever it is read
    at = Window.partitionBy("k", "b").orderBy("o", F.desc("f"))
    size = F.count(F.lit(1)).over(Window.partitionBy("k", "b"))
    numbered = rows.withColumn("n", F.row_number().over(at)).withColumn("size", size)
    numbered = numbered.withColumn("run", F.col("n") - F.sum("f").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.where("f = 1").groupBy("k", "b", "run").agg(
        F.count(F.lit(1)).alias("n_failures"), F.min("o").alias("first"),
        (F.min("n") == 1).alias("at_start"), (F.max("n") == F.max("size")).alias("at_end"),
    )
    inner = runs.where("not at_start and not at_end").select("k", "n_failures", "first")
    by_stretch = Window.partitionBy("k").orderBy("b")
    places = rows.select("k", "b").distinct().withColumn("place", F.row_number().over(by_stretch))
    outer = runs.where("at_start or at_end").join(places, ["k", "b"])
    order_of = Window.partitionBy("k").orderBy("place", "first")
    goes_on = F.col("at_start") & F.lag("at_end").over(order_of) & (F.lag("place").over(order_of) == F.col("place") - 1)
    joined = outer.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn(
        "no", F.sum("new").over(order_of.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = joined.groupBy("k", "no").agg(F.sum("n_failures").alias("n_failures"), F.min("first").alias("first")).drop("no")
    return inner.unionByName(whole).select(F.col("k").alias(key), "n_failures", F.col("first").alias(f"first_{order}"))


def trend(df: DataFrame, day: str, value: str, span: int = 5) -> DataFrame:
    """Adds change_pct to the day before (0 where that isn't above zero) and trend over span days: up, down or flat."""
    order = Window.orderBy(day)
    before, first = F.lag(value).over(order), F.lag(value, span - 1).over(order)
    return df.withColumn("change_pct", F.when(before > 0, F.round((F.col(value) - before) / before * 100, 2) + 0.0).otherwise(0.0)).withColumn(
        "trend", F.when(first.isNull() | (F.col(value) == first), "flat").when(F.col(value) > first, "up").otherwise("down")
    )


def cache_split(df: DataFrame, key: str, cache: DataFrame) -> DataFrame:
    """df with is_cached: whether the cache, a table with the same key column, holds the row's key; null keys are never cached."""
    known = cache.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(known, key, "left").withColumn("is_cached", F.coalesce("__hit", F.lit(False))).drop("__hit")


def contains_names(df: DataFrame, text: str, names: DataFrame, name: str, most: int = 10_000) -> DataFrame:
    """df's rows with every name their text contains.

    Up to ``most`` names are sent to every task and sought in each text. More are joined on their first four
    characters with the four-character windows of the texts, and then compared.
    """
    known = names.select(F.col(name).alias("__name")).where(F.length("__name") > 0).distinct()
    few = known.limit(most + 1).collect()
    if len(few) <= most:
        listed = F.array(*[F.lit(r[0]) for r in sorted(few)]) if few else F.array().cast("array<string>")
        return df.withColumn(name, F.explode(F.filter(listed, lambda n: F.contains(F.col(text), n))))
    n = F.length(text)

    def windows(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(F.col(text), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    # a name of fewer than four characters is its own key
    keys = F.array_distinct(F.flatten(F.array(*[windows(k) for k in (1, 2, 3, 4)])))
    keyed = df.withColumn("__k", F.explode(keys))
    joined = keyed.join(known.withColumn("__k", F.substring("__name", 1, 4)), "__k").where(F.contains(F.col(text), F.col("__name")))
    return joined.drop("__k").withColumnRenamed("__name", name)
