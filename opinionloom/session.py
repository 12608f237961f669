"""Session helpers: shared folders and deterministic randomness."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    A temporary folder is used only in local mode, where the setting may be absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="opinionloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def digest(*parts: Column | str | int) -> Column:
    """md5 over the parts: a random-looking value that only depends on the row, so a
    task that is run again gives the same answer."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("#", *[c.cast("string") for c in columns]))


def hex_number(hexed: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(hexed, start, length), 16, 10).cast("bigint")


def uniform(hexed: Column, start: int) -> Column:
    """A number in (0, 1) from eight hex digits."""
    return (hex_number(hexed, start, 8) + 1) / F.lit(float(2**32 + 1))


def gaussian(hexed: Column, sigma: float) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(hexed, 1)))
    return radius * F.cos(F.lit(2.0) * F.pi() * uniform(hexed, 9)) * F.lit(sigma)


def uuid_of(hexed: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hexed, start, n) for start, n in cuts])
