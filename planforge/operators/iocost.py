"""Cost of a trace of block requests on a rotating disk: seek, rotation, transfer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Disk:
    """Fixed values of the modelled disk."""

    block_size: int = 4096
    rpm: int = 7200
    blocks_per_track: int = 1024
    heads: int = 4
    cylinders: int = 500_000
    track_to_track_ms: float = 0.8
    full_stroke_ms: float = 18.0
    mb_per_s: float = 150.0


def io_cost(trace: DataFrame, disk: Disk = Disk()) -> DataFrame:
    """trace (disk_id, seq, start, n) gains seek_ms, rotation_ms, transfer_ms and total_ms.

    The head begins at cylinder 0. Each disk's trace is one window partition, as its requests
    depend on each other in order.
    """
    per, w = disk.blocks_per_track * disk.heads, Window.partitionBy("disk_id").orderBy("seq")
    end = F.col("start") + F.col("n") - 1
    here, was = F.floor(F.col("start") / per), F.coalesce(F.lag(F.floor(end / per)).over(w), F.lit(0))
    df = trace.withColumns({"_dist": F.abs(here - was), "_follows": F.coalesce(F.lag(end).over(w) + 1 == F.col("start"), F.lit(False)), "_crossed": F.floor(end / per) - here})
    t2t, full = disk.track_to_track_ms, disk.full_stroke_ms
    seek = F.when(F.col("_dist") == 0, 0.0).when(F.col("_dist") == 1, t2t).otherwise(t2t + (full - t2t) * F.sqrt(F.least(F.lit(1.0), F.col("_dist") / disk.cylinders)))
    df = df.withColumns({
        "seek_ms": seek + t2t * F.col("_crossed"),
        "rotation_ms": F.when(F.col("_follows"), 0.0).otherwise(0.5 * 60_000 / disk.rpm),
        "transfer_ms": F.col("n") * disk.block_size / 1e6 / disk.mb_per_s * 1000,
    })
    return df.withColumn("total_ms", F.col("seek_ms") + F.col("rotation_ms") + F.col("transfer_ms")).drop("_dist", "_follows", "_crossed")
