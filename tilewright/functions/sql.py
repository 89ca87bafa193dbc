"""The grid as SQL functions.  Those of pure expressions stay visible to the optimiser; one table function decodes tiles."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import grid

_PHI = f"radians(least(greatest(lat, -{grid.MAX_LATITUDE}D), {grid.MAX_LATITUDE}D))"
FUNCTIONS = {
    "mercator_x(lon DOUBLE)": ("DOUBLE", "(lon + 180D) / 360D"),
    "mercator_y(lat DOUBLE)": ("DOUBLE", f"(1D - ln(tan({_PHI}) + 1D / cos({_PHI})) / pi()) / 2D"),
    "grid_index(share DOUBLE, level INT)": ("BIGINT", f"least(greatest(CAST(round(share * (shiftleft(1L, level) * {grid.EXTENT})) AS BIGINT), 0L), shiftleft(1L, level) * {grid.EXTENT} - 1L)"),
    "tile_x(lon DOUBLE, level INT)": ("INT", "CAST(shiftright(grid_index(mercator_x(lon), level), 16) AS INT)"),
    "tile_y(lat DOUBLE, level INT)": ("INT", "CAST(shiftright(grid_index(mercator_y(lat), level), 16) AS INT)"),
    "tile_path(z INT, x INT, y INT)": ("STRING", "concat(z, '/', x, '/', y, '.mt2')"),
    "metres_between(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE)": ("DOUBLE", f"hypot((lon2 - lon1) * cos(radians((lat1 + lat2) / 2D)) * {grid.METRES_PER_DEGREE}D, (lat2 - lat1) * {grid.METRES_PER_DEGREE}D)"),
}


@udtf(returnType="class int, id bigint, rank int, name string, vertices int, holes int")
class TileFeatures:
    """tile_features(content): one row per feature of a tile's vector sections."""

    def eval(self, content: bytes):
        from ..sources import tilefile

        version, _, parts = tilefile.sections(bytes(content))
        for code, payload in parts:
            if code < tilefile.RASTER_BASE:
                for f in tilefile.features(payload, version):
                    yield code, f["id"], f["rank"], f["name"], len(f["vertices"]), len(f["holes"])


def register(spark: SparkSession) -> None:
    """Make the functions known to a session as temporary functions."""
    from .. import ship

    ship(spark)
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("tile_features", TileFeatures)
