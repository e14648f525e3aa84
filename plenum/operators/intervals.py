"""Intervals of days: unions of what overlaps, and what of them others leave open. A null end is open; ends are included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.shared import written

FAR = "9999-12-31"


def _end(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(FAR).cast("date"))


def coalesced(rows: DataFrame, keys: list[str], begin: str = "begin", end: str = "end", apart: int = 1) -> DataFrame:
    """keys, begin, end, n: intervals of a key that overlap, or lie at most `apart` days from each other, as one; n of them.

    One sweep in order of begins: an interval opens a new one where it begins after everything before it has ended. Intervals without a begin go."""
    w = Window.partitionBy(*keys).orderBy(begin, _end(end))
    before = F.max(_end(end)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.datediff(F.col(begin), before) > apart), 1).otherwise(0)
    runs = rows.filter(F.col(begin).isNotNull()).withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    out = runs.groupBy(*keys, "_run").agg(F.min(begin).alias(begin), F.max(_end(end)).alias(end), F.count("*").alias("n"))
    return out.withColumn(end, F.nullif(F.col(end), F.lit(FAR).cast("date"))).drop("_run")


def difference(rows: DataFrame, others: DataFrame, keys: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """keys, begin, end: the days of rows that no interval of others has.

    Begins and ends of both are events in order; a stretch between two events counts where rows are open and others aren't. No interval meets
    another one, so a key with very many costs its sort."""
    def events(df: DataFrame, mine: int) -> DataFrame:
        own = df.filter(F.col(begin).isNotNull())
        opens = own.select(*keys, F.col(begin).alias("_day"), F.lit(1).alias("_step"))
        closes = own.filter(F.col(end).isNotNull()).select(*keys, F.date_add(end, 1).alias("_day"), F.lit(-1).alias("_step"))
        return opens.unionByName(closes).withColumn("_mine", F.lit(mine))

    each = events(rows, 1).unionByName(events(others, 0)).groupBy(*keys, "_day").agg(
        F.sum(F.when(F.col("_mine") == 1, F.col("_step")).otherwise(0)).alias("_in"), F.sum(F.when(F.col("_mine") == 0, F.col("_step")).otherwise(0)).alias("_out")
    )
    w = Window.partitionBy(*keys).orderBy("_day")
    state = each.select(*keys, "_day", F.sum("_in").over(w).alias("_in"), F.sum("_out").over(w).alias("_out"), F.lead("_day").over(w).alias("_next"))
    open_ = state.filter("_in > 0 and _out = 0").select(*keys, F.col("_day").alias(begin), F.date_sub("_next", 1).alias(end))
    return coalesced(open_, keys, begin, end).drop("n")


def as_of(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, columns: list[str]) -> DataFrame:
    """rows with columns of the last span of their key that begins at their time or before; null where none does.

    Both sides are put in one order of key and time and the last span is carried on, so no row meets all spans of its key. Spans of a key begin at different
    times, or the one with the greatest columns holds."""
    own = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(spans.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_span"))
    theirs = spans.select(*keys, F.col(begin).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_span"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_span").rowsBetween(Window.unboundedPreceding, 0)
    carried = own.unionByName(theirs).withColumn("_span", F.last("_span", ignorenulls=True).over(w))
    return carried.filter("_side = 1").select("_row.*", *[F.col("_span").getField(c).alias(c) for c in columns])


def holding(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, name: str, begin: str = "begin", end: str = "end") -> DataFrame:
    """rows with name: of the spans of their key that hold their day, the one that begins first (the least name on ties); null where none does.

    A span is passed over where one before it ends no earlier. What is left ends in the order in which it begins, so the first that ends on a day or later is
    found by one order of days, and holds it if it has begun: no row meets all spans of its key."""
    order = Window.partitionBy(*keys).orderBy(begin, name).rowsBetween(Window.unboundedPreceding, -1)
    told = spans.filter(F.col(begin).isNotNull()).withColumn("_until", _end(end)).withColumn("_before", F.max("_until").over(order))
    left = told.filter(F.col("_before").isNull() | (F.col("_until") > F.col("_before"))).select(*keys, (-F.unix_date("_until")).alias("_turned"), F.col(begin).alias("_from"), name)
    found = as_of(rows.withColumn("_turned", -F.unix_date(at)), left, keys, "_turned", "_turned", ["_from", name])
    return found.withColumn(name, F.when(F.col("_from") <= F.col(at), F.col(name))).drop("_turned", "_from")


#: Days by which a letter of appointment and the register's begin may differ.
NEAR_DAYS = 30


def audited_offices(register: DataFrame, evidence: DataFrame, name: str = "name", near: int = NEAR_DAYS) -> DataFrame:
    """name, finding, day, until, days: what a register of offices (name, begin, end) and letters of appointment (name, day) don't agree on.

    appointment_without_record: no office of that name; date_mismatch: the nearest office begins more than near days away (days);
    record_without_appointment: a stretch of offices in a row of a name that no letter names; overlap: more than one office at a time, with how many.

    Offices and letters of a name stand in one order of days, so that every finding is told by what stands before and after a row: one shuffle, one sort. An
    office without a begin only says that its name is on record; a name that is null is nobody's."""
    begun, letter = F.col("begin").isNotNull(), F.col("_letter") == 1
    offices = register.select(name, F.col("begin").alias("_at"), F.lit(0).alias("_letter"), F.when(begun, _end("end")).alias("_until"))
    letters = evidence.filter("day is not null").select(name, F.col("day").alias("_at"), F.lit(1).alias("_letter"), F.lit(None).cast("date").alias("_until"))
    w = Window.partitionBy(name).orderBy("_at", "_letter", "_until")
    whole, here = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    begin, until = F.when(~letter, F.col("_at")), F.col("_until")
    rows = offices.unionByName(letters).withColumns({
        "_before": F.max(until).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_last": F.max(begin).over(here),
        "_next": F.expr(f"lead(CASE WHEN _letter = 0 THEN _at END) IGNORE NULLS OVER (PARTITION BY `{name}` ORDER BY _at, _letter, _until)"),
        "_known": F.min("_letter").over(whole) == 0,
        "_named": F.max("_letter").over(whole) == 1,
    })
    office = ~letter & F.col("_at").isNotNull()
    fresh = office & (F.col("_before").isNull() | (F.datediff("_at", "_before") > 1))
    twice = office & (F.col("_at") <= F.col("_before"))
    rows = rows.withColumns({"_run": F.count_if(fresh).over(here), "_from": F.max(F.when(fresh, F.col("_at"))).over(here)})
    day = Window.partitionBy(name, "_at").orderBy("_letter", "_until").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the same order
    rows = rows.withColumns({
        "_to": F.max(F.when(office, F.struct("_run", "_until"))).over(here)["_until"],
        "_times": F.count_if(twice).over(day),
        "_both": F.max(F.when(twice, F.least("_until", "_before"))).over(day),
    })
    gap = F.least(F.datediff("_at", "_last"), F.datediff("_next", "_at"))
    closes = F.col("_next").isNull() | (F.datediff("_next", F.greatest("_before", "_until")) > 1)
    none, far = F.lit(None), lambda c: F.nullif(F.col(c), F.lit(FAR).cast("date"))
    found = lambda kind, at, end, days: F.struct(F.lit(kind).alias("finding"), F.col(at).alias("day"), end.cast("date").alias("until"), days.cast("int").alias("days"))
    first = (
        F.when(letter & (~F.col("_known") | F.col(name).isNull()), found("appointment_without_record", "_at", none, none))
        .when(letter & (gap > near), found("date_mismatch", "_at", none, gap))
        .when(office & closes & (~F.col("_named") | F.col(name).isNull()), found("record_without_appointment", "_from", far("_to"), none))
    )
    second = F.when(office & (F.col("_times") > 0) & (F.col("_next").isNull() | (F.col("_next") > F.col("_at"))), found("overlap", "_at", far("_both"), F.col("_times")))
    return rows.select(name, F.explode(F.array(first, second)).alias("_found")).filter("_found is not null").select(name, "_found.*")


def aligned(segments: DataFrame, speakers: DataFrame, keys: list[str], speaker: str, begin: str = "start", end: str = "stop", width: float = 60.0, least: float = 1.0) -> DataFrame:
    """segments with speaker: the first of speakers whose time holds a segment's begin, else the one of most overlap if that is `least` seconds or more.

    Times are dealt into stretches of `width` seconds; a segment meets the speakers of its own stretches only. Speakers are in order of their begins, then names."""
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(b, a) / width))).alias("_at")
    own = written(segments.withColumn("_id", F.monotonically_increasing_id()))  # both sides of the last join need the same numbers
    mine = own.select("_id", *keys, F.col(begin).alias("_a"), F.col(end).alias("_b"), stretch(F.col(begin), F.col(end)))
    theirs = speakers.select(*keys, F.col(begin).alias("_c"), F.col(end).alias("_d"), F.col(speaker).alias("_who"), stretch(F.col(begin), F.col(end)))
    met = mine.join(theirs, [*keys, "_at"]).select("_id", "_a", "_b", "_c", "_d", "_who").distinct()
    overlap = F.least("_b", "_d") - F.greatest("_a", "_c")
    holds = (F.col("_c") <= F.col("_a")) & (F.col("_a") < F.col("_d"))
    order = F.struct(F.when(holds, 0).otherwise(1).alias("x"), F.when(holds, 0.0).otherwise(-overlap).alias("y"), F.col("_c"), F.col("_who"))
    best = met.filter(holds | (overlap >= least)).groupBy("_id").agg(F.min_by("_who", order).alias(speaker))
    return own.join(best, "_id", "left").drop("_id")
