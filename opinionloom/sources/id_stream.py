"""A table as a stream: what is new since the last id, read in bounded ranges of ids.

The offset of the stream is the largest id read. A micro-batch takes the ids above it, up to the largest one there
is, in ranges of ids; each task reads one range. Ids may be negative or zero. A row that arrives later with an id at or
below the offset is not read by the stream: run a batch with mode="missing" for such rows. Rows without an id are
never read. A table that lost its largest ids moves the offset back, never rows twice within a run.

Files that are not sorted by the id would be read once for every range. Where that is more than a few times their rows,
the tasks of a micro-batch read bundles of row groups instead, each once, and keep the rows between its two offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Ids in a range, and ranges in a micro-batch; more ids than both allow make wider ranges.
RANGE = 1_000_000
MAX_RANGES = 10_000
#: Rows that the ranges of a micro-batch may read in all: this many times the rows of the table, or this many at least.
REREAD, FREE_ROWS = 4, 1_000_000
_SCHEMA = pa.schema([("review_id", pa.int64()), ("text", pa.string())])
_BEFORE_ALL = -(1 << 63)


class IdTable(Protocol):
    """A table with an integer id and a text. Executors read it by themselves, so it must be picklable."""

    def bounds(self, after: int) -> tuple[int, int] | None:
        """The smallest and the largest id above `after`, or bounds outside of them; None if there is none."""

    def read(self, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Rows (review_id, text) with low < id <= high."""


@dataclass(frozen=True)
class FileTable:
    """Files below a path that Arrow reads: parquet, orc, csv, json or feather."""

    path: str
    id_col: str = "review_id"
    text_col: str = "text"
    fmt: str = "parquet"

    def _place(self) -> tuple[pa.fs.FileSystem | None, str]:
        return pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (None, self.path)

    def _dataset(self) -> ds.Dataset:
        system, path = self._place()
        return ds.dataset(path, filesystem=system, format=self.fmt, exclude_invalid_files=False, ignore_prefixes=["_", "."])

    def bounds(self, after: int) -> tuple[int, int] | None:
        """From the statistics of Parquet row groups where there are any, else from the ids."""
        lows, highs = [], []
        for piece in self._dataset().get_fragments():
            for part in piece.split_by_row_group() if self.fmt == "parquet" else [piece]:
                known = part.row_groups[0].statistics.get(self.id_col) if self.fmt == "parquet" and part.row_groups else None
                if known is None:
                    ids = [b.column(0) for b in part.to_batches(columns=[self.id_col]) if b.num_rows]
                    ends = [pc.min_max(c).as_py() for c in ids]
                    known = {k: f((e[k] for e in ends if e[k] is not None), default=None) for k, f in (("min", min), ("max", max))}
                if known["max"] is not None and known["max"] > after:
                    lows.append(known["min"])
                    highs.append(known["max"])
        return (max(min(lows), after + 1), max(highs)) if highs else None

    def pieces(self, low: int, high: int, width: int) -> list[list[tuple[str, int]]] | None:
        """Bundles of (file, row group) that hold the ids above `low` up to `high`, of about `width` rows or one group.

        None where ranges of `width` ids read little more than the table, or where files have no statistics."""
        if self.fmt != "parquet":
            return None
        wanted, rows, ranged = [], 0, 0
        for piece in self._dataset().get_fragments():
            for part in piece.split_by_row_group():
                group = part.row_groups[0]
                known = group.statistics.get(self.id_col) or {"min": low + 1, "max": high}
                first, last = max(known["min"], low + 1), min(known["max"], high)
                if first > last:
                    continue
                wanted.append((piece.path, group.id, group.num_rows))
                rows += group.num_rows
                ranged += group.num_rows * ((last - low - 1) // width - (first - low - 1) // width + 1)
        if ranged <= max(REREAD * rows, FREE_ROWS):
            return None
        bundles, held = [[]], 0
        for path, number, n in wanted:
            if bundles[-1] and held + n > width:
                bundles.append([])
                held = 0
            bundles[-1].append((path, number))
            held += n
        return bundles

    def read(self, low: int, high: int, pieces: Sequence[tuple[str, int]] | None = None) -> Iterator[pa.RecordBatch]:
        wanted = (ds.field(self.id_col) > low) & (ds.field(self.id_col) <= high)
        data = self._dataset()
        if pieces is not None:
            system = self._place()[0] or pa.fs.LocalFileSystem()
            groups = [data.format.make_fragment(path, filesystem=system, row_groups=[number]) for path, number in pieces]
            data = ds.FileSystemDataset(groups, data.schema, data.format, system)
        for batch in data.to_batches(columns=[self.id_col, self.text_col], filter=wanted):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string())], schema=_SCHEMA)


@dataclass(frozen=True)
class QueryTable:
    """A table behind Python's database interface (PEP 249): each range is one query by the id, which should be indexed.

    connect opens a connection on whichever executor reads; mark is the driver's place holder ('?' or '%s').
    """

    connect: Callable[[], Any]
    table: str
    id_col: str = "review_id"
    text_col: str = "text"
    mark: str = "?"
    rows: int = 10_000

    def _select(self, what: str, rest: str, values: Sequence[int]) -> Iterator[list[tuple]]:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {what} FROM {self.table} WHERE {rest}", tuple(values))
            while found := cursor.fetchmany(self.rows):
                yield found
        finally:
            connection.close()

    def bounds(self, after: int) -> tuple[int, int] | None:
        what = f"MIN({self.id_col}), MAX({self.id_col})"
        low, high = next(self._select(what, f"{self.id_col} > {self.mark}", [after]))[0]
        return None if low is None else (low, high)

    def read(self, low: int, high: int) -> Iterator[pa.RecordBatch]:
        rest = f"{self.id_col} > {self.mark} AND {self.id_col} <= {self.mark}"
        for found in self._select(f"{self.id_col}, {self.text_col}", rest, [low, high]):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)


class _Range(InputPartition):
    def __init__(self, low: int, high: int, pieces: list[tuple[str, int]] | None = None):
        self.low, self.high, self.pieces = low, high, pieces


class _Reader(DataSourceStreamReader):
    def __init__(self, table: IdTable, width: int):
        self.table, self.width = table, width

    def initialOffset(self) -> dict:
        return {"last_id": _BEFORE_ALL}

    def latestOffset(self) -> dict:
        found = self.table.bounds(_BEFORE_ALL)
        return {"last_id": found[1] if found else _BEFORE_ALL}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["last_id"], end["last_id"]
        found = self.table.bounds(low) if high > low else None
        if found is None:
            return []
        low = max(low, found[0] - 1)  # ids may begin far above the first offset
        width = max(self.width, -(-(high - low) // MAX_RANGES))
        bundles = self.table.pieces(low, high, width) if isinstance(self.table, FileTable) else None
        if bundles is not None:
            return [_Range(low, high, b) for b in bundles]
        return [_Range(a, min(a + width, high)) for a in range(low, high, width)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.pieces is None:
            yield from self.table.read(partition.low, partition.high)
        else:
            yield from self.table.read(partition.low, partition.high, partition.pieces)


def read_id_stream(spark: SparkSession, table: IdTable, ids_per_task: int = RANGE) -> DataFrame:
    """The stream (review_id bigint, text string) of a table, for streaming.reviews.stream_reviews."""

    class IdStream(DataSource):
        @classmethod
        def name(cls) -> str:
            return "review_ids"

        def schema(self) -> str:
            return "review_id bigint, text string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(table, ids_per_task)

    spark.dataSource.register(IdStream)
    return spark.readStream.format("review_ids").load()
