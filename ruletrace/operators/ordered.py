"""Next-row windows and row numbers that do not depend on group size.

Every group that is not known to be small is cut into pieces along time: the calendar span of ``PIECE_SECONDS`` that a row's first
order column lies in. Rows are windowed inside a piece, and one carried row per (group, piece), taken by
an aggregate that combines map-side, links a piece to its neighbours. A busy group so spreads over its
pieces, and what is windowed over a whole group is one small row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.functions.clock import epoch_seconds
from ruletrace.session import settled

PIECE_SECONDS = 7 * 24 * 3600
PIECE = "_piece"
# A group that is known to have at most so many rows is one piece.
WHOLE = 1 << 14


def _cut(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn(PIECE, F.expr(f"floor({epoch_seconds(order[0])} / {PIECE_SECONDS})"))


def next_in_group(df: DataFrame, keys: list[str], order: list[str], take: dict[str, str],
                  small: DataFrame | None = None) -> DataFrame:
    """Add, per output name, the value the next row of the group has (null on the last).

    ``order`` starts with a timestamp; keys and that timestamp are never null. ``small`` has the rows of other groups, each
    known to be small and dealt by its keys already: those are windowed as they lie.
    """
    # Keys mostly begin alike: pieces are sorted by a hash first, which is told apart at a glance.
    cut = _cut(df, order).withColumn("_spread", F.xxhash64(*keys, PIECE))
    piece = ["_spread", *keys, PIECE]
    carried = F.struct(*[F.col(c).alias(o) for o, c in take.items()])
    if set(take.values()) == {order[0]}:  # the first row's value is the least one
        head = F.struct(*[F.min(order[0]).alias(o) for o in take])
    else:
        head = F.min_by(carried, F.struct(*order))
    along = Window.partitionBy(*keys).orderBy(PIECE)
    heads = (cut.groupBy(*piece).agg(head.alias("_head"))
             .withColumn("_head", F.lead("_head").over(along)))
    inside = Window.partitionBy(*piece).orderBy(*order)
    found = (cut.withColumn("_own", F.lead(carried).over(inside)).join(heads, piece)
             .withColumn("_next", F.coalesce("_own", "_head"))
             .withColumns({out: F.col(f"_next.{out}") for out in take})
             .drop("_own", "_head", "_next", "_spread", PIECE))
    if small is None:
        return found
    whole = Window.partitionBy("_spread", *keys).orderBy(*order)
    return found.unionByName(
        small.withColumn("_spread", F.xxhash64(*keys))
        .withColumns({out: F.lead(c).over(whole) for out, c in take.items()}).drop("_spread"))


PLACE_BITS = 33  # of monotonically_increasing_id


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add each row's number in the order, from 1, without sorting all rows in one task.

    Rows are dealt by ranges of the order and numbered inside them; one count per range, of which there are as many
    as shuffle partitions, tells how many come before.
    """
    dealt = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    parts = dealt.groupBy(F.shiftright("_id", PLACE_BITS).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for part in parts:
        starts.append((part["part"], before))
        before += part["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _before long"))
    inside = F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)
    return (dealt.withColumn("_part", F.shiftright("_id", PLACE_BITS)).join(offsets, "_part")
            .withColumn(name, F.col("_before") + inside + 1).select(*df.columns, name))
