"""Spatial joins as equi-joins on grid cells.

Geometry is exploded to segments, each segment lists the cells its buffer may touch, and both sides
meet on ``(cx, cy)``. The side that holds streets is broadcast after its size was counted; otherwise
hot cells are split by a salt whose table has a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.operators.storage import BROADCAST_BYTES, broadcast_if_small

CELL_M = 200.0
HOT_SHARE = 1024
CELL_EPS = 1e-6


def cells(s: Column, reach: float, size: float = CELL_M) -> Column:
    """array<struct(cx, cy)> of every cell within ``reach`` of a segment.

    Walks the columns the segment spans and keeps the rows it can touch in each, so a long diagonal
    lists a strip of cells and not its whole bounding box.
    """
    r = reach + CELL_EPS
    xmin, xmax = F.least(s["x0"], s["x1"]), F.greatest(s["x0"], s["x1"])
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]

    def cell_of(v):
        return F.floor(v / size).cast("long")

    def column(ix):
        xa = F.greatest(xmin, ix * size - r)
        xb = F.least(xmax, (ix + 1) * size + r)
        slope = F.try_divide(dy, dx)
        ya = F.coalesce(s["y0"] + (xa - s["x0"]) * slope, s["y0"])
        yb = F.coalesce(s["y0"] + (xb - s["x0"]) * slope, s["y1"])
        return F.transform(
            F.sequence(cell_of(F.least(ya, yb) - r), cell_of(F.greatest(ya, yb) + r)),
            lambda iy: F.struct(ix.alias("cx"), iy.alias("cy")),
        )

    return F.flatten(F.transform(F.sequence(cell_of(xmin - r), cell_of(xmax + r)), column))


def segment_cells(df: DataFrame, line: str, keep: list[str | Column], name: str, reach: float,
                  size: float = CELL_M, frame: bool = False) -> DataFrame:
    """One row per (row of df, segment, cell): ``keep`` columns, struct ``name``, ``cx``, ``cy``."""
    kept = df.select(*keep, F.explode(G.segments(F.col(line))).alias(name))
    if frame:
        kept = kept.withColumn(name, G.framed(F.col(name)))
    return (
        kept.withColumn("_c", F.explode(cells(F.col(name), reach, size)))
        .select("*", F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy")).drop("_c")
    )


def boxed(df: DataFrame, pieces: str, side: str, reach: float, several: bool = False) -> DataFrame:
    """With four plain columns for the box around a piece, or ``several`` of them, and its buffer.

    Most pairs of a cell lie apart, and a comparison of numbers costs a small part of one inside structs.
    """
    def of(least: bool, axis: str) -> Column:
        pick, over = (F.least, F.array_min) if least else (F.greatest, F.array_max)
        ends = [F.when(F.size(pieces) == 1, F.expr(f"{pieces}[0].{axis}{k}")).otherwise(over(f"{pieces}.{axis}{k}"))
                if several else F.expr(f"{pieces}.{axis}{k}") for k in (0, 1)]
        return pick(*ends) - reach - CELL_EPS if least else pick(*ends) + reach + CELL_EPS

    return df.withColumns({f"{side}_{name}_{axis}": of(name == "low", axis) for name in ("low", "high") for axis in "xy"})


def boxes_meet(left: str, right: str) -> Column:
    tests = [F.col(f"{p}_low_{axis}") <= F.col(f"{q}_high_{axis}") for p, q in ((left, right), (right, left)) for axis in "xy"]
    return tests[0] & tests[1] & tests[2] & tests[3]


def hot_cells(df: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """Cells holding more than 1/share of all rows, with the number of splits each needs.

    At most ``share`` cells can qualify, whatever the data, so the result is safe to broadcast.
    """
    load = df.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    total = load.agg(F.sum("n").alias("n")).scalar()
    return load.filter(F.col("n") * share > total).select(
        "cx", "cy", F.ceil(F.col("n") * share / total).cast("int").alias("splits"))


def cell_join(big: DataFrame, small: DataFrame, condition: Column, salt_by: str,
              max_broadcast: int = BROADCAST_BYTES, share: int = HOT_SHARE, strip=None, restore=None) -> DataFrame:
    """Inner join on the cell with a residual condition.

    ``big`` is never shuffled when ``small`` has at most ``max_broadcast`` bytes. Otherwise rows of
    ``big`` in hot cells are spread by a hash of ``salt_by`` and the few street rows of those cells
    are repeated, so no join task gets more than about 1/share of ``big``. Its rows are then shuffled as ``strip`` leaves
    them, and ``restore`` makes again what follows from the rest.
    """
    small, fits = broadcast_if_small(small, max_broadcast)
    if fits:
        return big.join(small, ["cx", "cy"]).filter(condition)
    hot = F.broadcast(hot_cells(big, share))
    spread = big.join(hot, ["cx", "cy"], "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("splits")), F.lit(0)).cast("int")).drop("splits")
    if strip is not None:
        spread = restore(strip(spread).repartition("cx", "cy", "salt"))
    repeated = small.join(hot, ["cx", "cy"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits"), F.lit(1)) - 1))).drop("splits")
    return spread.join(repeated, ["cx", "cy", "salt"]).filter(condition).drop("salt")
