"""tilewright: geographic tile analytics on Spark DataFrames."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Let Python workers find this package where the driver found it, if nothing else has put it on their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, (held.get("PYTHONPATH"), root)))
