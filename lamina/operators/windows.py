"""Questions about intervals: containment, return within a delay, presence by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_MICROS_PER_DAY = 86_400_000_000


def before_window(moment: Column, start: Column) -> Column:
    return moment < start


def after_window(moment: Column, end: Column) -> Column:
    """Past the end; a window whose end is unknown is still open."""
    return F.coalesce(moment > end, F.lit(False))


def outside_window(moment: Column, start: Column, end: Column) -> Column:
    return before_window(moment, start) | after_window(moment, end)


def time_slot(moment: Column, days: int) -> Column:
    """Number of the stretch of `days` days that holds a moment."""
    return F.floor(F.unix_micros(moment.cast("timestamp_ntz").cast("timestamp")) / (days * _MICROS_PER_DAY))


def starts_told(df: DataFrame, entity: str, start: str, days: int) -> DataFrame:
    """(entity, _slot): the slots in which an end may be answered by one of these starts.

    A start answers ends of its own slot and of the one before, of the same entity; no others.
    """
    slot = time_slot(F.col(start), days)
    told = df.where(F.col(start).isNotNull())
    return told.select(entity, F.explode(F.array(slot, slot - 1)).alias("_slot")).distinct()


def returns_within(
    df: DataFrame, entity: str, start: str, end: str, days: int, into: str = "revenu", among: DataFrame | None = None
) -> DataFrame:
    """Add 0/1: does the entity start anew in (end, end + days]?

    Starts are looked for in `among`, by default in the rows themselves. For part of the rows it is enough that
    `among` holds the starts of the slots of their ends and of the next ones.

    Time is cut into slots exactly `days` long. A later start inside the slot
    of `end` is always soon enough, so the slot's last start decides; in the
    next slot only its first start can be soon enough; further slots are too
    far. Two values per (entity, slot), aggregated before the shuffle, thus
    replace the pairs of a self join, and an entity holding a third of all rows
    is spread over its slots. A row never counts itself, as start <= end.
    """
    def slot(moment):
        return time_slot(moment, days)

    nothing = F.lit(None).cast("timestamp_ntz")
    moment = F.col(start).cast("timestamp_ntz")
    starts = (
        (df if among is None else among).where(F.col(start).isNotNull())
        .select(
            F.col(entity).alias("_entity"),
            F.inline(
                F.array(
                    F.struct(slot(moment).alias("_slot"), moment.alias("_same"), nothing.alias("_next")),
                    F.struct((slot(moment) - 1).alias("_slot"), nothing.alias("_same"), moment.alias("_next")),
                )
            ),
        )
        .groupBy("_entity", "_slot")
        .agg(F.max("_same").alias("_last_same"), F.min("_next").alias("_first_next"))
    )
    # Rows without an end cannot match; their start keeps them off one null key.
    own_slot = slot(F.coalesce(F.col(end), F.col(start)))
    limit = F.col(end).cast("timestamp_ntz") + F.expr(f"INTERVAL '{days}' DAY")
    back = (F.col("_last_same") > F.col(end)) | (F.col("_first_next") <= limit)
    return (
        df.withColumn("_own_slot", own_slot)
        .join(starts, (F.col(entity) == F.col("_entity")) & (F.col("_own_slot") == F.col("_slot")), "left")
        .withColumn(into, (F.col(end).isNotNull() & F.coalesce(back, F.lit(False))).cast("int"))
        .drop("_own_slot", "_entity", "_slot", "_last_same", "_first_next")
    )


def presence_by_day(df: DataFrame, group: str, start_day: str, end_day: str) -> DataFrame:
    """Rows present, arriving and leaving per group and day, up to the last arrival.

    Each interval gives +1 on its first day and -1 the day after its last, so
    the work is the number of rows, not rows times days.
    """
    arrivals = df.where(F.col(start_day).isNotNull())
    zero, one = (F.lit(n).cast("bigint") for n in (0, 1))
    moves = arrivals.select(
        F.col(group),
        F.inline(F.array(
            F.struct(F.col(start_day).alias("jour"), one.alias("arrives"), zero.alias("partis")),
            F.struct(F.col(end_day).alias("jour"), zero.alias("arrives"), one.alias("partis")),
        )),
    ).where(F.col("jour").isNotNull())
    return presence_from_moves(moves, group, arrivals.agg(F.max(start_day)).scalar())


def presence_from_moves(moves: DataFrame, group: str, horizon: Column) -> DataFrame:
    """The same from numbers arriving and leaving per group and day, in any number of parts, up to a last day.

    After aggregation one group holds at most one row per calendar day; the running sum reads only those.
    """
    zero = F.lit(0).cast("bigint")

    def change(day, delta, arrived, left):
        return F.struct(
            day.alias("jour"), delta.alias("delta"), arrived.alias("arrives"), left.alias("partis")
        )

    day, arrived, left = F.col("jour"), F.col("arrives"), F.col("partis")
    changes = (
        moves.groupBy(group, "jour").agg(F.sum("arrives").alias("arrives"), F.sum("partis").alias("partis"))
        .select(group, F.inline(F.array(change(day, arrived, arrived, left), change(F.date_add(day, 1), -left, zero, zero))))
        .groupBy(group, "jour")
        .agg(*[F.sum(c).alias(c) for c in ("delta", "arrives", "partis")])
        .where(F.col("jour") <= horizon)
    )
    by_day = Window.partitionBy(group).orderBy("jour")
    present = F.sum("delta").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    following = F.lead("jour").over(by_day)
    # Days without a change repeat the count of the last day that had one.
    until = F.coalesce(F.date_sub(following, 1), horizon)
    spans = (
        changes.withColumn("presents", present)
        .withColumn("_until", until)
        .where((F.col("presents") > 0) & (F.col("jour") <= F.col("_until")))
    )
    on_change = F.col("day") == F.col("jour")
    return spans.withColumn("day", F.explode(F.sequence("jour", "_until"))).select(
        F.col(group),
        F.col("day").alias("jour"),
        F.col("presents"),
        F.when(on_change, F.col("arrives")).otherwise(zero).alias("arrives"),
        F.when(on_change, F.col("partis")).otherwise(zero).alias("partis"),
    )


def pairs_within(df: DataFrame, entity: str, start: str, end: str, days: int, marked: Column) -> DataFrame:
    """Count pairs (interval, later start of the same entity at most `days` calendar days after its end).

    One row: pairs, pairs whose first interval is `marked`, shortest and
    longest delay in days. No pair is emitted. Starts and the bounds asked
    about are laid on one time line per (entity, slot of days + 1), where a
    running count answers each bound; an interval meets one or two slots.
    Equal starts and equal ends collapse into a weight before the shuffle, so a
    time line is no longer than the distinct moments of its slot.
    """
    width = (days + 1) * _MICROS_PER_DAY

    def micros(moment):
        return F.unix_micros(moment.cast("timestamp"))

    def slot(value):
        return F.floor(value / width)

    none = F.lit(None).cast("bigint")
    starts = (
        df.where(F.col(start).isNotNull() & F.col(entity).isNotNull())
        .groupBy(F.col(entity).alias("_entity"), micros(F.col(start)).alias("_at"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_entity", slot(F.col("_at")).alias("_slot"), "_at", F.lit(0).alias("_asks"), "_n",
            none.alias("_from"), none.alias("_to"), F.lit(0).alias("_sign"), F.lit(False).alias("_marked"),
            none.alias("_weight"),
        )
    )
    last_moment = F.unix_micros(F.date_add(F.to_date(F.col(end)), days + 1).cast("timestamp")) - 1
    bounds = (
        df.where(F.col(end).isNotNull() & F.col(entity).isNotNull())
        .groupBy(
            F.col(entity).alias("_entity"),
            micros(F.col(end)).alias("_from"),
            last_moment.alias("_to"),
            F.coalesce(marked, F.lit(False)).alias("_marked"),
        )
        .agg(F.count(F.lit(1)).alias("_weight"))
    )
    here, there = slot(F.col("_from")), slot(F.col("_to"))

    def ask(where, at, sign):
        return F.struct(where.alias("_slot"), at.alias("_at"), F.lit(sign).alias("_sign"))

    asked = F.array(ask(here, F.col("_from"), -1), ask(there, F.col("_to"), 1))
    crossing = F.array(ask(here, (here + 1) * width - 1, 1))
    questions = bounds.select(
        "*", F.inline(F.when(here != there, F.concat(asked, crossing)).otherwise(asked))
    ).select(
        "_entity", "_slot", "_at", F.lit(1).alias("_asks"), F.lit(0).cast("bigint").alias("_n"),
        "_from", "_to", "_sign", "_marked", "_weight",
    )
    line = Window.partitionBy("_entity", "_slot").orderBy("_at", "_asks")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is looking back on the reversed line: a frame that is open
    # towards the end would be read again for every row.
    backwards = Window.partitionBy("_entity", "_slot").orderBy(F.col("_at").desc(), F.col("_asks").desc())
    ahead = backwards.rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col("_asks") == 0, F.col("_at"))
    answered = (
        starts.unionByName(questions)
        .withColumn("_count", F.sum("_n").over(so_far) * F.col("_sign") * F.col("_weight"))
        .withColumn("_first", F.when(F.col("_sign") == -1, F.min(begun).over(ahead)).otherwise(F.min(begun).over(so_far)))
        .withColumn("_last", F.when(F.col("_sign") == 1, F.max(begun).over(so_far)))
        .where(F.col("_asks") == 1)
    )

    def delay(moment):
        inside = (moment > F.col("_from")) & (moment <= F.col("_to"))
        return F.when(
            inside, F.datediff(F.timestamp_micros(moment).cast("date"), F.timestamp_micros(F.col("_from")).cast("date"))
        )

    return answered.agg(
        F.coalesce(F.sum("_count"), F.lit(0)).alias("paires"),
        F.coalesce(F.sum(F.when(F.col("_marked"), F.col("_count"))), F.lit(0)).alias("paires_marquees"),
        F.min(delay(F.col("_first"))).alias("delai_min_j"),
        F.max(delay(F.col("_last"))).alias("delai_max_j"),
    )
