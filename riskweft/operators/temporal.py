"""Joins in time, and history whose keys are cut into segments: as-of join, interval join, and prior and trailing figures.

A window by user keeps all rows of a user in one task. Here rows are dealt into ranges of (keys, time, tie), so a user
with a third of all rows is cut into many segments of equal size. Within a segment a window does what it always does; what
has to be known of the segments before is a small mergeable state (a last value, a count, a sum, moments), made by one
aggregation and carried over the few segments of a key. Trailing figures are differences of running ones: what came before
a row, less what had come by the time at which its window begins, which an as-of join finds.

Rows with a null time take part in no order: they match nothing as-of and have no history. Ties go by the tie column, which
should name a row. Columns of both sides must differ in name, but for the keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweft.functions.windows import MICROS, money
from riskweft.scratch import in_ranges, kept


def _by_segment(rows: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with the state of their segment (keys, __p)."""
    states = states.withColumnsRenamed({k: f"__k_{i}" for i, k in enumerate(keys)} | {"__p": "__q"})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)]
    out = rows.join(states, [*same, F.col("__p") == F.col("__q")], "left")
    return out.drop("__q", *[f"__k_{i}" for i in range(len(keys))])


def _earlier(keys: Sequence[str]):
    """The segments of a key before this one."""
    return Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: str | None = None, exact: bool = True, tolerance: int | None = None) -> DataFrame:
    """Every left row with the values of the last right row of its keys up to its time; null where there is none.

    exact: rows of the very same time match, too. tie: of right rows of one time the last in its order counts. tolerance:
    seconds that the match may lie back. Times are timestamps or whole numbers of microseconds.
    """
    us = lambda df, c: F.unix_micros(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c).cast("long")
    timed = F.col(left_time).isNotNull()
    for k in keys:
        timed = timed & F.col(k).isNotNull()
    kinds = {v: right.schema[v].dataType for v in values}
    # without keys or a time nothing matches, so such rows are not dealt: they may be many
    alone = left.where(~timed).withColumns({v: F.lit(None).cast(t) for v, t in kinds.items()})
    row = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(*[F.col(c) for c in values], us(right, right_time).alias("__us"))
    probes = left.where(timed).select(*keys, us(left, left_time).alias("__us"), F.lit(1).alias("__side"), F.monotonically_increasing_id().alias("__n"), row.alias("__row"))
    marks = right.dropna(subset=[*keys, right_time]).select(*keys, us(right, right_time).alias("__us"), F.lit(0 if exact else 2).alias("__side"), F.monotonically_increasing_id().alias("__n"), (F.col(tie) if tie else F.lit(None)).alias("__tie"), found.alias("__found"))
    order = ["__us", "__side", "__tie", "__n"]
    rows = in_ranges(probes.unionByName(marks, allowMissingColumns=True), [*keys, *order], "asof")
    upto = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("__found IS NOT NULL").groupBy(*keys, "__p").agg(F.max_by("__found", F.struct(*order)).alias("__found"))
    segments = rows.select(*keys, "__p").distinct().join(last, [*keys, "__p"], "left")
    carried = segments.select(*keys, "__p", F.last("__found", ignorenulls=True).over(_earlier(keys)).alias("__carried"))
    here = rows.withColumn("__here", F.last("__found", ignorenulls=True).over(upto)).where("__row IS NOT NULL")
    match = _by_segment(here, carried, keys).withColumn("__match", F.coalesce("__here", "__carried"))
    near = F.lit(True) if tolerance is None else F.col("__us") - F.col("__match.__us") <= tolerance * MICROS
    out = match.select("__row.*", *[F.when(near, F.col(f"__match.{v}")).alias(v) for v in values])
    return out.unionByName(alone)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, before: int, after: int = 0) -> DataFrame:
    """Pairs of rows of the same keys whose right time lies from `before` seconds before the left time to `after` after it.

    Times fall into buckets as wide as the interval, so a left row meets two of them at most, and a hot key is as many
    groups as it has buckets.
    """
    width = max(1, before + after) * MICROS
    us = lambda c: F.unix_micros(F.col(c))
    bucket = lambda t: F.floor(t / width).cast("long")
    right = right.dropna(subset=[*keys, right_time]).withColumn("__bucket", bucket(us(right_time)))
    left = left.dropna(subset=[*keys, left_time])
    left = left.withColumn("__bucket", F.explode(F.sequence(bucket(us(left_time) - before * MICROS), bucket(us(left_time) + after * MICROS))))
    met = left.join(right, [*keys, "__bucket"]).drop("__bucket")
    return met.where((us(right_time) >= us(left_time) - before * MICROS) & (us(right_time) <= us(left_time) + after * MICROS))


def with_prior(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, prefix: str = "prior_", distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Adds figures of the rows of the keys that come before in the order: {prefix}tx_count, {prefix}total_amount,
    {prefix}mean_amount, {prefix}std_amount (population; null below two rows), and numbers of distinct values by name."""
    rows = in_ranges(df, [*keys, *order], "history")
    own = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    figures = {"n": F.count(F.lit(1)), "na": F.count(amount), "s": F.sum(money(amount)), "m": F.avg(amount), "v": F.var_pop(amount)}
    states = kept(rows.groupBy(*keys, "__p").agg(*[f.alias(k) for k, f in figures.items()]), "states")
    whole = Window.partitionBy(*keys)
    states = states.withColumn("c", F.try_divide(F.sum(F.col("m") * F.col("na")).over(whole), F.sum("na").over(whole)))  # near all means, so squares stay small
    apart = F.col("m") - F.col("c")
    sums = {"pn": F.sum("n"), "pna": F.sum("na"), "ps": F.sum("s"), "p1": F.sum(F.col("na") * apart), "p2": F.sum(F.col("na") * (F.col("v") + apart * apart))}
    before = states.select(*keys, "__p", F.col("c").alias("__c"), *[f.over(_earlier(keys)).alias(f"__{k}") for k, f in sums.items()])
    out = rows.withColumns({f"__{k}": f.over(own) for k, f in figures.items()})
    out = _by_segment(out, before, keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    count, valued = zero("__pn") + zero("__n"), zero("__pna") + zero("__na")
    total = F.coalesce(F.col("__ps"), F.lit(0).cast("decimal(18,2)")) + F.coalesce(F.col("__s"), F.lit(0).cast("decimal(18,2)"))
    mean_before, mean_here = F.col("__c") + F.try_divide(F.col("__p1"), F.col("__pna")), F.col("__m")
    square_before = F.greatest(F.col("__p2") - F.try_divide(F.col("__p1") * F.col("__p1"), F.col("__pna")), F.lit(0.0))
    between = F.coalesce((mean_before - mean_here) * (mean_before - mean_here) * zero("__pna") * zero("__na") / F.greatest(valued, F.lit(1)), F.lit(0.0))
    square = F.coalesce(square_before, F.lit(0.0)) + F.coalesce(F.col("__v") * F.col("__na"), F.lit(0.0)) + between
    new = {
        "tx_count": count.cast("int"),
        "total_amount": total.cast("double"),
        "mean_amount": F.try_divide(total.cast("double"), F.when(valued > 0, valued)),
        "std_amount": F.when((count >= 2) & (valued > 0), F.sqrt(square / valued)),
    }
    out = out.withColumns({f"{prefix}{k}": v for k, v in new.items()}).drop("__c", *[f"__{k}" for k in (*figures, *sums)])
    for name, value in (distinct or {}).items():
        out = _with_distinct(out, keys, order, value, name)
    return out.drop("__p")


def with_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Adds by name the number of distinct values of a column on the rows of the keys that come before in the order."""
    rows = in_ranges(df, [*keys, *order], "distinct")
    for name, value in values.items():
        rows = _with_distinct(rows, keys, order, value, name)
    return rows.drop("__p")


def _with_distinct(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the number of distinct values on earlier rows; rows have their segment. A value counts in the segment that has it first."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min("__p").alias("__first"))
    seen = kept(seen, "firsts").withColumnRenamed(value, "__value")
    per = seen.groupBy(*keys, F.col("__first").alias("__p")).agg(F.count("*").alias("__new"))
    segments = rows.select(*keys, "__p").distinct()
    before = _by_segment(segments, per, keys).select(*keys, "__p", F.sum("__new").over(_earlier(keys)).alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)]
    firsts = seen.withColumnsRenamed({k: f"__k_{i}" for i, k in enumerate(keys)})
    marked = rows.join(firsts, [*same, F.col(value) == F.col("__value"), F.col("__p") == F.col("__first")], "left").drop(*[f"__k_{i}" for i in range(len(keys))])  # the segment is part of the key, so no value is hot
    once = F.row_number().over(Window.partitionBy(*keys, "__p", value).orderBy(*order)) == 1
    marked = marked.withColumn("__is_first", (once & F.col("__first").isNotNull()).cast("long")).drop("__first", "__value")
    own = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _by_segment(marked.withColumn("__here", F.sum("__is_first").over(own)), before, keys)
    return out.withColumn(name, (F.coalesce("__before", F.lit(0)) + F.coalesce("__here", F.lit(0))).cast("int")).drop("__before", "__here", "__is_first")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Adds by name the columns of the row of the keys that comes just before in the order; null for the first one."""
    rows = in_ranges(df.withColumn("__own", F.struct(*[F.col(c).alias(n) for n, c in values.items()])), [*keys, *order], "previous")
    last = rows.groupBy(*keys, "__p").agg(F.max_by("__own", F.struct(*order)).alias("__last"))
    carried = last.select(*keys, "__p", F.last("__last").over(_earlier(keys)).alias("__carried"))
    here = F.lag("__own").over(Window.partitionBy(*keys, "__p").orderBy(*order))
    out = _by_segment(rows.withColumn("__here", here), carried, keys).withColumn("__before", F.coalesce("__here", "__carried"))
    return out.withColumns({n: F.col("__before")[n] for n in values}).drop("__own", "__here", "__carried", "__before", "__p")


def with_trailing(df: DataFrame, keys: Sequence[str], time: str, tie: str, windows: Mapping[str, tuple[int, Column | str | None]]) -> DataFrame:
    """Adds for each name the figure of (seconds, what): rows before this one and less than so many seconds back; counted
    if what is None, counted where what is a condition, summed if it names an amount."""
    order, us = ["__us", tie], F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.withColumn("__us", us)
    wanted = list({id(w) if isinstance(w, Column) else w: w for _, w in windows.values()}.values())
    place = {id(w) if isinstance(w, Column) else w: i for i, w in enumerate(wanted)}
    unit = lambda w: F.lit(1).cast("long") if w is None else money(w) if isinstance(w, str) else w.cast("long")
    rows = in_ranges(rows.withColumns({f"__u{i}": F.coalesce(unit(w), F.lit(0)) for i, w in enumerate(wanted)}), [*keys, *order], "trailing")
    own = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    states = rows.groupBy(*keys, "__p").agg(*[F.sum(f"__u{i}").alias(f"s{i}") for i in range(len(wanted))])
    before = states.select(*keys, "__p", *[F.sum(f"s{i}").over(_earlier(keys)).alias(f"__b{i}") for i in range(len(wanted))])
    out = _by_segment(rows.withColumns({f"__upto{i}": F.sum(f"__u{i}").over(own) for i in range(len(wanted))}), before, keys)
    out = kept(out.withColumns({f"__upto{i}": F.col(f"__upto{i}") + F.coalesce(F.col(f"__b{i}"), F.lit(0)) for i in range(len(wanted))}).drop("__p", *[f"__b{i}" for i in range(len(wanted))]), "running")
    running = out.select(*keys, F.col("__us").alias("__mark_us"), F.col(tie).alias("__mark_tie"), *[F.col(f"__upto{i}").alias(f"__by{i}") for i in range(len(wanted))])
    for seconds in sorted({s for s, _ in windows.values()}):
        out = asof_join(out.withColumn("__begin", F.col("__us") - seconds * MICROS), running, keys, "__begin", "__mark_us", [f"__by{i}" for i in range(len(wanted))], "__mark_tie").drop("__begin")
        new = {}
        for name, (s, what) in windows.items():
            if s == seconds:
                i = place[id(what) if isinstance(what, Column) else what]
                value = F.col(f"__upto{i}") - F.col(f"__u{i}") - F.coalesce(F.col(f"__by{i}"), F.lit(0))
                new[name] = value.cast("double") if isinstance(what, str) else value.cast("int")
        out = out.withColumns(new).drop(*[f"__by{i}" for i in range(len(wanted))])
    return out.drop("__us", *[f"__{k}{i}" for k in ("u", "upto") for i in range(len(wanted))])
