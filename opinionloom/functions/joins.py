"""Joins against dimension tables, safe for hot keys at any dimension size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20


def fits_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the table has at most max_rows rows, and at most max_bytes as text; reads no more than that many rows."""
    wide = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in dim.columns), F.lit(0))
    r = dim.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(wide.cast("bigint")).alias("size")).first()
    return r.n <= max_rows and (r.size or 0) <= max_bytes


# Items that the sketch of hot keys follows for each share; its error is then about a ninth of a share.
_TRACKED, _MOST_TRACKED = 32, 1_000_000


def hot_keys(facts: DataFrame, on: list[str], shares: int) -> list[tuple[int, int]]:
    """(hash of the key, number of tasks) of each key that holds more than one of `shares` equal parts of the rows.

    Counted by a frequent-items sketch, merged over the partitions; there are fewer such keys than shares. A key's rows
    need as many tasks as they fill shares."""
    tracked = min(_TRACKED * shares, _MOST_TRACKED)
    top = F.expr(f"approx_top_k(_key, {min(shares, tracked)}, {tracked})")
    found = facts.select(F.xxhash64(*[F.col(f"`{c}`") for c in on]).alias("_key")).agg(top.alias("top"), F.count("*").alias("n")).first()
    wide = [(t["item"], -(-t["count"] * shares // found.n)) for t in found.top or []]
    return sorted((key, min(int(n), shares)) for key, n in wide if n > 1)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int | None = None,
) -> DataFrame:
    """Join a fact table with a dimension.

    A dimension of checked size is broadcast. A larger one is shuffled by key. Keys that hold more than one part in
    `salts` of the facts (by default, in the number of shuffle partitions) are measured first; only they are dealt out
    over several tasks, by a hash of `spread_by` and as widely as their rows need, and only their dimension rows are
    repeated. Keys that are NULL match nothing, but are spread alike.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat dimension rows")
    added = [] if how in ("left_semi", "left_anti") else [c for c in dim.columns if c not in on]
    columns = [F.col(f"`{c}`") for c in [*facts.columns, *added]]
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how).select(*columns)
    spark = facts.sparkSession
    shares = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Fixed before the join is planned, so that both sides agree however often a task is repeated.
    hot = spark.createDataFrame(hot_keys(facts, on, shares), "_key long, _width int")
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    width = F.coalesce("_width", F.lit(1))

    def measured(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", key).join(F.broadcast(hot), "_key", "left")

    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), width).cast("int")
    salted_facts = measured(facts).withColumn("_salt", salt)
    salted_dim = measured(dim).withColumn("_salt", F.explode(F.sequence(F.lit(0), width - 1)))
    return salted_facts.drop("_key", "_width").join(salted_dim.drop("_key", "_width"), [*on, "_salt"], how).select(*columns)
