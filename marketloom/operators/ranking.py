"""Order-based operators that stay exact when one group is too large for one task, without a job while a plan is built.

All of them rank by weighted counts. Rows fold to (group, value, count). Approximate quantiles of all rows, combined inside the
map tasks and read as one scalar subquery, cut the values into ranges; a quantile itself is a range of one value, so that a value with
many ties gets a range of its own. Running sums over the counts of each group's ranges say how many rows lie before a range, and only within a
range of a group are values ordered. So no task orders more than about one range of all rows, however large a group is. Quantiles
that miss the true ones change the size of ranges, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 256  # quantiles at most
RANGE_ROWS = 10_000  # rows that a range holds at least, so that small tables have few ranges
SLOTS = 16  # tasks that share the rows of one value
COPIES = 100_000  # repeated rows that one array brings back
EXACT = 2.0**53  # whole numbers below it keep their value as DOUBLE
IMAGE_DIGITS = 14  # hexadecimal digits of a text, seven bytes, that its range is chosen by

BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Rank:
    """A rank column: 1 is the highest value, or the lowest when ascending."""

    value: str
    name: str
    ascending: bool = False


# --- value ranges ----------------------------------------------------------------


def _join_alike(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join on equal keys, where nulls are equal, too; the keys appear once."""
    renamed = {name: f"_key{i}" for i, name in enumerate(keys)}
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in renamed.items()]
    return left.join(right.withColumnsRenamed(renamed), reduce(Column.__and__, same), how).drop(*renamed.values())


def _marks(rows: DataFrame, values: Sequence[Column]) -> Column:
    """Quantiles of each value over all rows, as an array of arrays in one scalar subquery. ``rows`` have ``_rows``: summing them
    makes this aggregate read the same columns as the others, so that all share one exchange."""
    shares = F.array(*[F.lit(k / (CUTS + 1)) for k in range(1, CUTS + 1)])
    step = F.ceil(F.lit(CUTS * RANGE_ROWS) / F.sum("_rows"))
    found = [
        F.array_distinct(F.filter(F.percentile_approx(value, shares), lambda mark, place: (place + 1) % step == 0))
        for value in values
    ]
    return rows.agg(F.array(*found).alias("marks")).scalar()


def _with_range(df: DataFrame, marks: Column, value: Column, exact: Column | bool = True) -> DataFrame:
    """Adds ``_range``: even between two quantiles, odd for a quantile itself, in the order of the values. Where ``exact`` does not
    hold, equal values may stand for different ones and share the range below."""
    on_mark = F.array_contains("_marks", value) & exact
    place = 2 * F.size(F.filter("_marks", lambda mark: mark < value)) + on_mark.cast("int")
    return df.withColumn("_marks", marks).withColumn("_range", place).drop("_marks")


def _range_starts(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per range of each group, its rows and the rows before it."""
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_rows").alias("_size"))
    order = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*BEFORE)
    return sizes.withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0)))


# --- ranks in groups ---------------------------------------------------------------


def _sort_value(df: DataFrame, rank: Rank) -> tuple[Column, Column]:
    """Numbers that ascend with the rank: as DOUBLE, and whole numbers as themselves, since DOUBLE merges neighbours
    beyond 2 ** 53. Not a number is as good as missing."""
    value, kind = F.col(rank.value), dict(df.dtypes)[rank.value]
    if kind in ("float", "double"):
        value = F.when(~F.isnan(value), value.cast("double") + 0.0)
    coarse = value.cast("double") if rank.ascending else -value.cast("double")
    whole = value.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(None).cast("long")
    return coarse, whole if rank.ascending else F.bitwise_not(whole)


def add_min_ranks(df: DataFrame, groups: Sequence[str], ranks: Sequence[Rank], key: str = "stock_id") -> DataFrame:
    """Competition ranks ('1, 2, 2, 4') within groups; a null value, one that is not a number, and a row without
    group have a null rank. Repeated rows count as often as they occur. Whole numbers and floating point numbers rank exactly,
    decimals as DOUBLE. The rows are computed once, for an exchange that all steps read.
    """
    columns = df.columns
    # The aggregate needs every column, so nothing is pruned below it and all steps find the same exchange.
    rows = df.repartition(*groups, key).groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    values = [_sort_value(df, rank) for rank in ranks]
    marks = _marks(rows, [coarse for coarse, _ in values])
    # Rows that agree in these have the same ranks.
    identity = list(dict.fromkeys([*groups, key, *[rank.value for rank in ranks]]))
    entries = F.array(
        *[F.struct(F.lit(i).alias("_rank"), coarse.alias("_value"), fine.alias("_fine")) for i, (coarse, fine) in enumerate(values)]
    )
    long = rows.select(*identity, "_rows", F.inline(entries)).where(F.col("_value").isNotNull())
    exact = F.col("_fine").isNull() | (F.abs("_value") < EXACT)
    ranged = _with_range(long, F.element_at(marks, F.col("_rank") + 1), F.col("_value"), exact)
    # All values of an odd range are equal, so its rows need no order and spread over the slots.
    odd = F.col("_range") % 2 == 1
    spread = F.when(odd, F.pmod(F.xxhash64(key), F.lit(SLOTS))).otherwise(-1)
    slots = F.when(odd, F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))
    parts = ["_rank", *groups]
    starts = _range_starts(ranged, parts).drop("_size").withColumn("_spread", F.explode(slots))
    inside = [*parts, "_range", "_spread"]
    placed = _join_alike(ranged.withColumn("_spread", spread), starts, inside)
    running = Window.partitionBy(*inside).orderBy("_value", "_fine").rowsBetween(*BEFORE)
    ties = Window.partitionBy(*inside, "_value", "_fine")
    placed = placed.withColumn("_running", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
    first = F.when(F.col("_spread") >= 0, F.lit(0)).otherwise(F.min("_running").over(ties))
    placed = placed.withColumn("_place", (F.col("_before") + first + 1).cast("double"))
    names = [f"_place{i}" for i in range(len(ranks))]
    places = placed.groupBy(*identity).agg(
        *[F.max(F.when(F.col("_rank") == i, F.col("_place"))).alias(name) for i, name in enumerate(names)]
    )
    in_group = reduce(Column.__and__, [F.col(name).isNotNull() for name in groups])
    found = _join_alike(rows, places, identity).select(
        *columns, *[F.when(in_group, F.col(name)).alias(rank.name) for name, rank in zip(names, ranks)], "_rows"
    )
    return _repeated(found)


def _repeated(df: DataFrame) -> DataFrame:
    """Each row ``_rows`` times, by arrays of bounded length."""
    last = F.floor((F.col("_rows") - 1) / COPIES)
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.lit(COPIES).cast("long"), F.col("_rows") - F.col("_part") * COPIES)
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("_rows", "_part", "_copy")


# --- selection by position ---------------------------------------------------------


def values_at(rows: DataFrame, group: str, value: str, wanted: DataFrame) -> DataFrame:
    """(group, position, value): the numbers at wanted positions (from 1) of their group, in ascending order. Rows have a known value.

    ``wanted`` holds (group, position), few for a group. Two passes over the folded rows: range counts lead to the ranges that
    hold a wanted position, and only the rows of these are ordered.
    """
    folded = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_rows"))
    ranged = _with_range(folded, _marks(folded, [F.col(value)])[0], F.col(value))
    inside = (F.col("_before") < F.col("position")) & (F.col("position") <= F.col("_before") + F.col("_size"))
    chosen = _join_alike(_range_starts(ranged, [group]), wanted, [group], "inner").where(inside).drop("_size")
    found = _join_alike(ranged, chosen, [group, "_range"], "inner")
    upto = Window.partitionBy(group, "position").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_last", F.col("_before") + F.sum("_rows").over(upto))
    hit = (F.col("position") <= F.col("_last")) & (F.col("position") > F.col("_last") - F.col("_rows"))
    return found.where(hit).select(group, "position", value)


def group_medians(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Exact median of the known values per group; a group without one has no row. NaN counts as missing."""
    known = df.select(group, value).where(F.col(value).isNotNull() & ~F.isnan(value))
    totals = known.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    middle = (F.col("_rows") + 1) / 2
    both = F.array_distinct(F.array(F.floor(middle), F.ceil(middle)))
    wanted = totals.select(group, F.explode(both).alias("position"))
    return values_at(known, group, value, wanted).groupBy(group).agg(F.avg(value).alias(name))


# --- risk bands --------------------------------------------------------------------

# Shares of the companies that are put on watch and marked high.
WATCH_SHARE = 0.15
HIGH_SHARE = 0.25


def _text_image(text: Column) -> Column:
    """The first bytes of a text as a whole number, in the order of the texts."""
    return F.conv(F.substring(F.rpad(F.hex(text), IMAGE_DIGITS, "0"), 1, IMAGE_DIGITS), 16, 10).cast("long")


def _band_ends(latest: DataFrame, score: str) -> DataFrame:
    """(band, _score, _id): the last company of the watch band and of the high band, if there is one.

    A histogram of the scores, whole numbers from 0 to 100, and of ranges of ids finds the score and range that hold a band's end;
    only companies in these are ordered.
    """
    ids = latest.select(F.col(score).alias("_score"), F.coalesce("stock_id", F.lit("")).alias("_id"), F.lit(1).alias("_rows"))
    image = _text_image(F.col("_id"))
    ids = _with_range(ids, _marks(ids, [image])[0], image)
    histogram = ids.groupBy("_score", "_range").agg(F.sum("_rows").alias("_size"))
    # At most 102 scores with 2 * CUTS + 1 ranges each.
    ordered = Window.orderBy(F.col("_score").asc_nulls_last(), "_range")
    steps = histogram.withColumns(
        {
            "_total": F.sum("_size").over(Window.partitionBy()),
            "_before": F.coalesce(F.sum("_size").over(ordered.rowsBetween(*BEFORE)), F.lit(0)),
        }
    )

    def companies(share: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(share)))

    watch = companies(WATCH_SHARE)
    high = F.when(F.col("_total") > watch, watch + companies(HIGH_SHARE))
    ends = F.array(*[F.struct(F.lit(band).alias("band"), end.alias("end")) for band, end in (("Watch", watch), ("High", high))])
    chosen = steps.select("*", F.inline(ends)).where(
        (F.col("end") > F.col("_before")) & (F.col("end") <= F.col("_before") + F.col("_size"))
    )
    chosen = chosen.select("_score", "_range", "band", (F.col("end") - F.col("_before")).alias("_position"))
    # At most two rows, one per band, so the broadcast is bounded.
    inside = _join_alike(ids, F.broadcast(chosen), ["_score", "_range"], "inner")
    place = F.row_number().over(Window.partitionBy("band").orderBy("_id"))
    return inside.withColumn("_place", place).where(F.col("_place") == F.col("_position")).select("band", "_score", "_id")


def add_risk_bands(latest: DataFrame, level_of, score: str = "financial_health_score") -> DataFrame:
    """Relative risk levels over one row per stock: the lowest scores become Watch, then High.

    Ordered by score (nulls last), then stock_id. The bands round up and hold at least one company;
    the rest keep the level of their own score, ``level_of(score)``.
    """

    def place(score: Column, stock: Column) -> Column:
        return F.struct(score.isNull().alias("unknown"), score.alias("score"), stock.alias("stock"))

    end = place(F.col("_score"), F.col("_id"))
    both = F.struct(*[F.max(F.when(F.col("band") == band, end)).alias(band) for band in ("Watch", "High")])
    limits = _band_ends(latest, score).agg(both.alias("limits")).scalar()
    own = place(F.col(score), F.coalesce("stock_id", F.lit("")))
    level = F.when(own <= limits["Watch"], "Watch").when(own <= limits["High"], "High").otherwise(level_of(F.col(score)))
    return latest.withColumn("risk_level", level).select(*latest.columns)
