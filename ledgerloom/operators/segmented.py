"""Order-dependent operators that no single key can overload.

A plain ``Window.partitionBy(document)`` puts all rows of a document into one
task.  One document (or the catch-all id of documents without one) may hold a
third of all rows, so here every key is cut into *segments* by its position
column: a window runs inside a segment (at most ``width`` rows when positions
are unique within the key), a small summary per segment is carried along the
key, and comes back to the segment: as its first row, or by a join.  The
summary of a key has one row per segment, so it is ``width`` times smaller than
the data.

Positions are non-negative integers that rise within a key: a row index, a
node ordinal, an event number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 17
_SEG = "_segment"


def with_segment(df: DataFrame, position: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    return df.withColumn(_SEG, F.floor(F.col(position) / F.lit(width)))


def _carry_windows(keys: list[str], order: list[Column]):
    inside = Window.partitionBy(*keys, _SEG).orderBy(*order)
    along = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    return inside, along


def carry_last(
    df: DataFrame,
    keys: list[str],
    position: str,
    values: dict[str, str],
    order: list[Column] | None = None,
    inclusive: bool = False,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Last non-null value before (or up to) each row, per key.

    ``values`` maps source column to output column.  ``order`` breaks ties of
    equal positions; it starts with the position.
    """
    order = order or [F.col(position)]
    end = 0 if inclusive else -1
    cut = with_segment(df, position, width).repartition(*keys, _SEG)  # one shuffle for the summary and the rows
    inside, along = _carry_windows(keys, [F.col("_in_segment"), *order])
    before = inside.rowsBetween(Window.unboundedPreceding, end)
    rank = F.struct(*order)
    summary = cut.groupBy(*keys, _SEG).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), rank)).alias(f"_end_{o}") for v, o in values.items()]
    )
    carried = summary.select(
        *keys,
        _SEG,
        *[F.last(f"_end_{o}", ignorenulls=True).over(along).alias(f"_from_{o}") for o in values.values()],
    )
    carried = carried.where(" OR ".join(f"`_from_{o}` IS NOT NULL" for o in values.values())).withColumn("_in_segment", F.lit(False))
    # what enters a segment stands before its rows: one sort, no join
    entered = cut.withColumn("_in_segment", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    out = entered.withColumns(
        {o: F.last(F.coalesce(v, f"_from_{o}"), ignorenulls=True).over(before) for v, o in values.items()}
    ).where("_in_segment")
    return out.drop(_SEG, "_in_segment", *[f"_from_{o}" for o in values.values()])


def running_total(
    df: DataFrame,
    keys: list[str],
    position: str,
    value: Column,
    out: str,
    order: list[Column] | None = None,
    inclusive: bool = True,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Running sum of an integer expression per key."""
    order = order or [F.col(position)]
    cut = with_segment(df.withColumn("_v", F.coalesce(value, F.lit(0)).cast("long")), position, width)
    inside, along = _carry_windows(keys, order)
    local = cut.withColumn(
        "_in", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    )
    carried = (
        cut.groupBy(*keys, _SEG)
        .agg(F.sum("_v").alias("_s"))
        .select(*keys, _SEG, F.sum("_s").over(along).alias("_from"))
        .where("_from <> 0")
    )
    joined = local.join(carried, [*keys, _SEG], "left")
    return joined.withColumn(
        out, F.coalesce("_in", F.lit(0)) + F.coalesce("_from", F.lit(0))
    ).drop(_SEG, "_v", "_in", "_from")


def row_number(
    df: DataFrame,
    keys: list[str],
    position: str,
    order: list[Column] | None = None,
    out: str = "row_index",
    start: int = 0,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Dense ordinal per key, counted from ``start``."""
    numbered = running_total(df, keys, position, F.lit(1), out, order, inclusive=True, width=width)
    return numbered.withColumn(out, F.col(out) - 1 + start)


def neighbours(
    df: DataFrame,
    keys: list[str],
    position: str,
    columns: dict[str, tuple[str, int]],
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Values of rows a few positions before (-n) or after (+n), per key.

    ``columns`` maps output to (source, offset).  Positions must be dense
    (0, 1, 2, …).  Rows near a segment's end are copied into the next segment
    for the look-up and dropped afterwards.
    """
    reach = max(abs(n) for _, n in columns.values())
    seg = F.floor(F.col(position) / F.lit(width))
    place = F.col(position) % F.lit(width)
    homes = F.array_compact(
        F.array(
            seg,
            F.when((place < reach) & (seg > 0), seg - 1),
            F.when(place >= width - reach, seg + 1),
        )
    )
    spread = df.withColumn("_home", seg).withColumn(_SEG, F.explode(homes))
    w = Window.partitionBy(*keys, _SEG).orderBy(position)
    looked = spread.withColumns(
        {out: (F.lag(src, -n) if n < 0 else F.lead(src, n)).over(w) for out, (src, n) in columns.items()}
    )
    return looked.where(F.col(_SEG) == F.col("_home")).drop(_SEG, "_home")
