"""Readers and writers of the formats that tile builds meet."""

from __future__ import annotations


def register(spark) -> None:
    """Make format("osmpbf"), format("shp") and format("tiff") known to a session."""
    from .osmpbf import OsmPbf
    from .shapefile import Shapefile
    from .tiff import Tiff

    for source in (OsmPbf, Shapefile, Tiff):
        spark.dataSource.register(source)
