"""Joins of points and boxes by distance or overlap: tiles make the join an equi-join that Spark deals out.

Spark plans a join on an inequality as a nested loop over all pairs. Here the right side is put on every tile
that its reach touches and the left side on its own tile, so a pair meets on exactly one tile. A tile size
near the reach keeps the copies to nine at most.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planframe.session import cut


def tile(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that is to shuffle both sides, however small Spark takes them to be.

    Spark guesses a side by the compressed bytes of the columns that it reads and does not count the rows that an
    explode adds, so a table of tiles would be collected on the driver and sent whole to every executor.
    """
    return df.hint("merge")


def within(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, rx: str, ry: str, reach: float | str) -> DataFrame:
    """Pairs of left points (x, y) and right points (rx, ry) of equal keys whose tiles are within ``reach`` of each other.

    Every pair with both |dx| and |dy| up to ``reach`` is there, once; the caller tests the exact condition.
    Right columns other than the keys must not clash with left ones. A name as ``reach`` is that of a column of both
    sides, which has one value for equal keys: each key has tiles of its own size.
    """
    by_key = isinstance(reach, str)
    reach = F.col(reach) if by_key else reach
    a = left.withColumns({"_tx": tile(F.col(x), reach), "_ty": tile(F.col(y), reach)})
    b = right.withColumns({"_ux": tile(F.col(rx), reach), "_uy": tile(F.col(ry), reach)})
    b = b.withColumn("_tx", F.explode(F.sequence(F.col("_ux") - 1, F.col("_ux") + 1)))
    b = b.withColumn("_ty", F.explode(F.sequence(F.col("_uy") - 1, F.col("_uy") + 1))).drop("_ux", "_uy", *([reach] if by_key else []))
    return a.join(shuffled(b), [*keys, "_tx", "_ty"]).drop("_tx", "_ty")


def reaching(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, reach: str, rx: str, ry: str, size: float) -> DataFrame:
    """Pairs of left points (x, y) and right points (rx, ry) of equal keys, each left one with a ``reach`` of its own.

    Left points are put on every tile that their reach touches and right ones on their own, so every pair with
    both |dx| and |dy| up to the left one's reach is there, once; the caller tests the exact condition.
    """
    a = left
    for t, c in (("_tx", x), ("_ty", y)):
        a = a.withColumn(t, F.explode(F.sequence(tile(F.col(c) - F.col(reach), size), tile(F.col(c) + F.col(reach), size))))
    b = right.withColumns({"_tx": tile(F.col(rx), size), "_ty": tile(F.col(ry), size)})
    return a.join(shuffled(b), [*keys, "_tx", "_ty"]).drop("_tx", "_ty")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, size: float) -> DataFrame:
    """Pairs of boxes (prefix ``a`` and ``b``, columns x1 y1 x2 y2) of equal keys that may overlap; each pair once.

    Boxes lie on every tile they touch; a pair counts on the tile of the greater of their lower corners.
    """

    def spread(df: DataFrame, p: str) -> DataFrame:
        c = lambda n: tile(F.col(f"{p}{n}"), size)
        df = df.withColumn("_tx", F.explode(F.sequence(c("x1"), F.greatest(c("x1"), c("x2")))))
        return df.withColumn("_ty", F.explode(F.sequence(c("y1"), F.greatest(c("y1"), c("y2")))))

    joined = spread(left, a).join(shuffled(spread(right, b)), [*keys, "_tx", "_ty"])
    own = (F.col("_tx") == tile(F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1")), size)) & (F.col("_ty") == tile(F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1")), size))
    return joined.where(own).drop("_tx", "_ty")


def containing(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, box: tuple[str, str, str, str], size: float) -> DataFrame:
    """Pairs of points (x, y) and boxes (least x, least y, greatest x, greatest y) of equal keys where the point lies in the closed box; each pair once."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    b = boxes.withColumn("_tx", F.explode(F.sequence(tile(x0, size), F.greatest(tile(x0, size), tile(x1, size)))))
    b = b.withColumn("_ty", F.explode(F.sequence(tile(y0, size), F.greatest(tile(y0, size), tile(y1, size)))))
    p = points.withColumns({"_tx": tile(F.col(x), size), "_ty": tile(F.col(y), size)})
    return p.join(shuffled(b), [*keys, "_tx", "_ty"]).where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).drop("_tx", "_ty")


def first_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """For each key the columns of the row with the least order: a minimum that combines before the shuffle."""
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}") for c in columns])


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... by a column, without one task that holds all rows.

    Rows are dealt to ranges of the column and written once, so that their ranges stay; each is numbered from what the
    ranges before it hold, of which there is a row each.
    """
    dealt = cut(df.repartitionByRange(F.col(column)).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return dealt.withColumn("_own", own).join(counts, "_range").withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
