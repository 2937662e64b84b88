"""Aperture photometry of a spectral cube held as (channel, x, y, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataRefusal


def aperture_flux(cube: DataFrame, x: float, y: float, radius: float, inner: float = 9.0, outer: float = 14.0) -> DataFrame:
    """(channel, pixels, background, flux): values within the radius less the ring's median, by channel.

    Pixels with distance < radius are summed; the background is the median
    over inner <= distance < outer. NULL values are left out; a channel
    without ring values or without pixels is refused when its row is used.
    Rows farther out than both are filtered before the only shuffle.
    """
    if not (radius > 0 and 0 <= inner < outer):
        raise DataRefusal("an aperture needs a radius and a ring")
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    rows = cube.select("channel", F.col("value").cast("double").alias("value"), d.alias("d")).where((F.col("d") < max(radius, outer)) & F.col("value").isNotNull())
    source, ring = F.col("d") < radius, (F.col("d") >= inner) & (F.col("d") < outer)
    agg = rows.groupBy("channel").agg(F.count_if(source).alias("pixels"), F.median(F.when(ring, F.col("value"))).alias("background"), F.sum(F.when(source, F.col("value"))).alias("total"))
    ok = (F.col("pixels") > 0) & F.col("background").isNotNull()
    flux = F.when(ok, F.col("total") - F.col("pixels") * F.col("background")).otherwise(F.raise_error(F.lit("G601: a channel has no pixels or no background")))
    return agg.select("channel", "pixels", "background", flux.alias("flux"))
