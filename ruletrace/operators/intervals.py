"""Overlapping bookings of one resource: pairs, counts and existence.

``overlap_pairs`` is the join, for when the pairs themselves are wanted. How many pairs there
are, and which jobs have one, is read off a sweep over start and end times instead: the number
of pairs can be quadratic in a busy resource, the sweep touches two events per booking.

Input rows carry resource_id, work_id, assignment_id, start_ts, end_ts. Two bookings of
different jobs overlap when each starts before the other ends.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.functions.clock import epoch_seconds
from ruletrace.operators.ordered import PIECE, PIECE_SECONDS, WHOLE
from ruletrace.session import settled

# Bucket widths for bookings of up to that length: one hour, and then eight times as long each.
TIERS = [3600 * 8 ** k for k in range(8)]

# Event order at one instant: an end comes before a moment without length, and that before
# a start, because touching windows do not overlap. The others take no part.
END, MOMENT, START, BACKWARDS, OUTSIDE = 0, 1, 2, 3, 4


def timed(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())


def _length() -> Column:
    return F.expr(f"{epoch_seconds('end_ts')} - {epoch_seconds('start_ts')}")


def overlap_pairs(rows: DataFrame, keep: list[str] | None = None,
                  earlier: DataFrame | None = None,
                  later: DataFrame | None = None) -> DataFrame:
    """Each overlapping pair once, ``a_*`` holding the smaller assignment id.

    In a pair the later start lies inside the earlier booking. A booking goes to the tier of its
    length, whose time buckets are at least as wide, so it lies in two buckets at most; a start looks
    into one bucket of every tier. (resource, tier, bucket) is the equi-join key: a busy resource
    spreads over its buckets, one very long booking fills only buckets of its own tier, and adaptive
    execution splits a bucket that is still too big. ``earlier`` and ``later`` narrow the two roles; they are written down, so that
    their size is known, and what lies outside their times, or in tiers they do not have, is left out of the other role.
    """
    columns = list(dict.fromkeys(
        ["resource_id", "work_id", "assignment_id", "start_ts", "end_ts", *(keep or [])]))
    width = f"element_at(array({', '.join(f'{w}L' for w in TIERS)}), _tier)"
    at, until = (f"floor({epoch_seconds(c)} / {width})" for c in ("start_ts", "end_ts"))
    steps = " ".join(f"WHEN _length <= {w} THEN {k}" for k, w in enumerate(TIERS[:-1], 1))

    spans = timed(earlier if earlier is not None else rows).select(*columns).filter("start_ts < end_ts")
    starts = timed(later if later is not None else rows).select(*columns)
    if earlier is not None:
        spans = settled(spans, "earlier")
    if later is not None:
        starts = settled(starts, "later")
        first, last = starts.agg(F.min("start_ts"), F.max("start_ts")).first()
        spans = spans.filter((F.col("end_ts") > F.lit(first)) & (F.col("start_ts") <= F.lit(last)))
    spans = (spans.select(*columns, _length().alias("_length"))
             .withColumn("_tier", F.expr(f"CASE {steps} ELSE {len(TIERS)} END")))
    tiers = list(range(1, len(TIERS) + 1))
    if earlier is not None:
        first, last, tiers = spans.agg(F.min("start_ts"), F.max("end_ts"), F.sort_array(F.collect_set("_tier"))).first()
        starts = starts.filter((F.col("start_ts") >= F.lit(first)) & (F.col("start_ts") < F.lit(last)))
    spans = spans.selectExpr("*", f"explode(sequence({at}, {until})) AS _bucket")
    starts = (starts.selectExpr("*", f"explode(CAST(array({', '.join(map(str, tiers))}) AS array<int>)) AS _tier")
              .selectExpr("*", f"{at} AS _bucket"))

    # The smaller assignment id is a; whichever booking begins earlier stays x.
    met = spans.alias("x").join(starts.alias("y"), F.expr(
        "x.resource_id = y.resource_id AND x._tier = y._tier AND x._bucket = y._bucket "
        "AND y.start_ts < x.end_ts AND x.start_ts < y.end_ts AND x.work_id <> y.work_id "
        "AND (x.start_ts < y.start_ts "
        "     OR (x.start_ts = y.start_ts AND x.assignment_id < y.assignment_id))"))
    x_is_a = "x.assignment_id < y.assignment_id"
    names = [n for n in columns if n != "resource_id"]
    return met.selectExpr("x.resource_id AS resource_id",
                          *[f"if({x_is_a}, x.{n}, y.{n}) AS a_{n}" for n in names],
                          *[f"if({x_is_a}, y.{n}, x.{n}) AS b_{n}" for n in names])


def _piece(ts: str, many: str | None) -> str:
    """The piece of time of an event: a week, or all of it for a resource that is known to have few bookings."""
    week = f"floor({epoch_seconds(ts)} / {PIECE_SECONDS})"
    return f"CASE WHEN {many} > {WHOLE} THEN {week} WHEN {ts} IS NOT NULL THEN 0L END" if many else week


def _events(rows: DataFrame, keep: list[str], many: str | None = None) -> DataFrame:
    """Events of bookings (when, and what they are), with the piece of time they lie in.

    A booking that ends before it starts, and one without times or resource, adds nothing; its one event only says that it is there.
    """
    event = lambda ts, mark: f"named_struct('at', {ts}, 'mark', {mark}Y)"
    both = f"array({event('start_ts', START)}, {event('end_ts', END)})"
    shape = (f"CASE WHEN resource_id IS NULL OR start_ts IS NULL OR end_ts IS NULL THEN array({event('CAST(NULL AS TIMESTAMP_NTZ)', OUTSIDE)}) "
             f"WHEN start_ts < end_ts THEN {both} WHEN start_ts = end_ts THEN array({event('start_ts', MOMENT)}) "
             f"ELSE array({event('end_ts', BACKWARDS)}) END")
    return (rows.filter("work_id IS NOT NULL")
            .selectExpr("resource_id", "work_id", *keep, *filter(None, [many]), f"inline({shape})")
            .withColumn(PIECE, F.expr(_piece("at", many)))
            # Leads the order of the windows, where comparing a number is much cheaper than comparing texts.
            .withColumn(SPREAD, F.xxhash64("resource_id", PIECE)))


SPREAD = "_spread"
ORDER = ["at", "mark"]
BEGINS = f"mark IN ({MOMENT}, {START})"


def _counted(events: DataFrame) -> DataFrame:
    """Events with what they add to the running bookings (``step``) and to the begun ones (``entry``), and two counts over the
    bookings of other jobs, taken inside the event's piece of time.

    ``running`` is how many are under way at the event, ``begun`` how many have begun. Both are taken over the whole
    resource and over the same job, and subtracted; (resource, piece) deals the rows for both windows. Equal events at one
    instant may come in any order: a pair of them counts once, at the later one, and sums over a job do not depend on which that is.
    """
    group = [SPREAD, "resource_id", PIECE]
    whole = Window.partitionBy(*group).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*group, "work_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    steps = events.withColumns({"step": F.expr(f"CASE mark WHEN {START} THEN 1L WHEN {END} THEN -1L ELSE 0L END"),
                                "entry": F.expr(f"CASE WHEN {BEGINS} THEN 1L ELSE 0L END")})
    return (steps.withColumns({"_run": before("step", whole), "_beg": before("entry", whole)})
            .withColumns({"running": F.col("_run") - before("step", same), "begun": F.col("_beg") - before("entry", same)})
            .drop("_run", "_beg"))


@dataclass(frozen=True)
class Sweep:
    """What one pass over start and end events leaves: a row per resource, job and piece of time.

    ``net`` and ``entries`` sum what the events add, ``pairs`` the bookings of other jobs under way at each beginning and
    ``share`` what the job overlaps, both counted inside the piece. What runs on from earlier pieces is linear in these sums, so no
    event is joined with anything. ``keys`` are columns that depend on the resource alone, and so is ``many``, its number of bookings.
    """

    rows: DataFrame
    keys: list[str]
    many: str | None
    table: DataFrame
    backwards: bool     # whether any booking ends before it starts; a sweep cannot place those, so they are joined

    def carried(self) -> DataFrame:
        """The table with what the same job has running and begun in earlier pieces."""
        along = Window.partitionBy("resource_id", "work_id").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        carry = lambda c: F.coalesce(F.sum(c).over(along), F.lit(0))
        if not self.many:
            return self.table.withColumns({"same_net": carry("net"), "same_entries": carry("entries")})
        # What is swept in one piece carries nothing.
        none, cut = F.lit(0).cast("bigint"), F.coalesce(F.col(self.many) > WHOLE, F.lit(False))
        return (self.table.filter(cut).withColumns({"same_net": carry("net"), "same_entries": carry("entries")})
                .unionByName(self.table.filter(~cut).withColumns({"same_net": none, "same_entries": none})))

    def pieces(self) -> DataFrame:
        """Per resource and piece: the pairs that begin in it, and what was running and had begun before."""
        along = Window.partitionBy("resource_id").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        own = F.sum(F.col("pairs") - F.col("entries") * F.col("same_net"))
        return (self.carried().groupBy("resource_id", *self.keys, PIECE)
                .agg(own.alias("_own"), F.sum("entries").alias("_entries"), F.sum("net").alias("_net"))
                .withColumns({"before": F.coalesce(F.sum("_net").over(along), F.lit(0)),
                              "begun_before": F.coalesce(F.sum("_entries").over(along), F.lit(0))})
                .select("resource_id", *self.keys, PIECE, "before", "begun_before",
                        (F.col("_own") + F.col("_entries") * F.col("before")).alias("pairs")))

    def backward_pairs(self) -> DataFrame | None:
        if not self.backwards:
            return None
        return overlap_pairs(self.rows, keep=[*self.keys, *filter(None, [self.many])], later=timed(self.rows).filter("work_id IS NOT NULL AND end_ts < start_ts"))


def sweep(rows: DataFrame, keys: list[str] | None = None, many: str | None = None,
          parts: list[DataFrame] | None = None) -> Sweep:
    """Read the bookings once; the table is written to the shared folder, for all that is read off it.

    ``many`` names a column with at least the number of the resource's bookings. Without it every resource is cut into pieces.
    ``parts`` are all the rows in frames that have no resource in common; one that is dealt by resource is swept as it lies.
    """
    keys = keys or []
    carry = [*keys, *filter(None, [many])]
    share = (F.when(F.col("mark") == START, F.col("running") - F.col("begun"))
             .when(F.col("mark") == END, F.col("begun")).when(F.col("mark") == MOMENT, F.col("running")).otherwise(0))
    summed = [_counted(_events(part, keys, many)).groupBy(SPREAD, "resource_id", "work_id", *carry, PIECE).agg(
        F.sum("step").alias("net"), F.sum("entry").alias("entries"),
        F.sum(F.when(F.expr(BEGINS), F.col("running")).otherwise(0)).alias("pairs"), F.sum(share).alias("share"),
        F.count_if(F.col("mark") == BACKWARDS).alias("backwards")).drop(SPREAD) for part in parts or [rows]]
    table = settled(reduce(DataFrame.unionByName, summed), "sweep")
    return Sweep(rows, keys, many, table, not table.filter("backwards > 0").isEmpty())


def overlap_counts(swept: Sweep) -> DataFrame:
    """Overlapping pairs per resource, as (resource_id, keys, pairs); zero rows included."""
    counts = swept.pieces().select("resource_id", *swept.keys, "pairs")
    if (joined := swept.backward_pairs()) is not None:
        counts = counts.unionByName(joined.select(
            "resource_id", *[F.col(f"a_{k}").alias(k) for k in swept.keys], F.lit(1).cast("bigint").alias("pairs")))
    return (counts.filter("resource_id IS NOT NULL").groupBy("resource_id", *swept.keys).agg(F.sum("pairs").alias("pairs")))


def first_overlaps(swept: Sweep, size: int) -> DataFrame:
    """The first ``size`` resources of each key with an overlap, as (resource_id, last, until).

    At least ``size`` pairs, or all there are, lie within the pieces up to ``last``, and within the times up to ``until`` where that is
    known; without ``last`` all do.
    """
    pieces = swept.pieces().select("resource_id", *swept.keys, PIECE, "pairs", "before")
    if (joined := swept.backward_pairs()) is not None:
        at = F.expr(_piece("greatest(a_start_ts, b_start_ts)", swept.many and f"a_{swept.many}"))
        pieces = (pieces.unionByName(joined.select(
            "resource_id", *[F.col(f"a_{k}").alias(k) for k in swept.keys], at.alias(PIECE), F.lit(1).cast("bigint").alias("pairs"),
            F.lit(None).cast("bigint").alias("before")))
            .groupBy("resource_id", *swept.keys, PIECE).agg(F.sum("pairs").alias("pairs"), F.max("before").alias("before")))
    along = Window.partitionBy("resource_id").orderBy(PIECE)
    full = F.sum("pairs").over(along) >= size
    chosen = (pieces.withColumn("_full", full).groupBy("resource_id", *swept.keys)
              .agg(F.sum("pairs").alias("pairs"), F.min(F.when(F.col("_full"), F.struct(PIECE, "before"))).alias("_last"))
              .filter("pairs > 0")
              .withColumn("rn", F.row_number().over(Window.partitionBy(*swept.keys or [F.lit(0)]).orderBy("resource_id")))
              .filter(F.col("rn") <= size))
    # A few resources a key by construction, so what follows reads one piece of each.
    chosen = settled(chosen.select("resource_id", F.col(f"_last.{PIECE}").alias("last"), F.col("_last.before").alias("before")), "first")
    where = chosen.filter("last IS NOT NULL").withColumnsRenamed({"resource_id": "_of"})
    rows = swept.rows.join(where.select("_of"), F.col("resource_id") == F.col("_of"), "left_semi")
    here = _counted(_events(rows, [], swept.many).join(where, (F.col("resource_id") == F.col("_of")) & (F.col(PIECE) == F.col("last"))))
    same = (swept.table.join(where, (F.col("resource_id") == F.col("_of")) & (F.col(PIECE) < F.col("last")))
            .groupBy(F.col("resource_id").alias("_r"), F.col("work_id").alias("_w")).agg(F.sum("net").alias("_same")))
    running = F.col("running") + F.coalesce("before", F.lit(0)) - F.coalesce("_same", F.lit(0))
    times = (here.join(same, (F.col("resource_id") == F.col("_r")) & (F.col("work_id") == F.col("_w")), "left")
             .filter(F.expr(BEGINS) & (running > 0))
             .withColumn("rn", F.row_number().over(Window.partitionBy("resource_id").orderBy("at"))).filter(F.col("rn") <= size)
             .groupBy(F.col("resource_id").alias("_of")).agg(F.max("at").alias("_at"), F.count("*").alias("_n")))
    # Few, and their size is known, so that bookings which meet them are not shuffled.
    return settled(chosen.join(times, F.col("resource_id") == F.col("_of"), "left")
                   .select("resource_id", "last", F.when(F.col("_n") >= size, F.col("_at")).alias("until")), "first")


def within_first(many: str | None = None) -> Column:
    """Whether a booking begins early enough to be in the first pairs, beside the columns of ``first_overlaps``."""
    return F.expr("CASE WHEN until IS NOT NULL THEN start_ts <= until WHEN last IS NOT NULL "
                  f"THEN {_piece('start_ts', many)} <= last ELSE true END")


def work_overlaps(swept: Sweep) -> DataFrame:
    """Per job the bookings of other jobs that its resources' bookings overlap, counted at both; zero rows included.

    A booking overlaps what runs at its start plus what begins before its end. The second part is the begun count at
    its end less the one at its start, so each event carries its share and the shares of a job are summed: no pair is ever formed.
    """
    before = swept.pieces().select(F.col("resource_id").alias("_r"), F.col(PIECE).alias("_p"), "before", "begun_before")
    share = (F.col("share") + F.col("entries") * (F.col("before") - F.col("same_net"))
             - F.col("net") * (F.col("begun_before") - F.col("same_entries")))
    shares = (swept.carried().join(before, (F.col("resource_id") == F.col("_r")) & (F.col(PIECE) == F.col("_p")), "left")
              .select("work_id", F.coalesce(share, F.lit(0)).alias("share")))
    if (joined := swept.backward_pairs()) is not None:
        shares = shares.unionByName(joined.select(F.explode(F.array("a_work_id", "b_work_id")).alias("work_id"),
                                                  F.lit(1).cast("bigint").alias("share")))
    return shares.groupBy("work_id").agg(F.sum("share").alias("overlaps"))


def overlapping_work(swept: Sweep) -> DataFrame:
    """The jobs holding a resource that is also on an overlapping job, each once."""
    return work_overlaps(swept).filter("overlaps > 0")
