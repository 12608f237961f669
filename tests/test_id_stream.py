"""A table as a stream of its new ids: two runs equal a batch, with negative, late and missing ids."""

import pytest

from opinionloom.plans import analyze
from opinionloom.plans.batch import run_batch
from opinionloom.sinks import tables
from opinionloom.sources import id_stream
from opinionloom.sources.id_stream import FileTable, QueryTable, read_id_stream
from opinionloom.streaming.reviews import stream_reviews


def test_two_runs_and_late_rows(spark, folder):
    store, seen = tables.ResultStore(spark, folder("results")), []

    def run():
        stream = read_id_stream(spark, FileTable(folder("table"), "id", "body"), ids_per_task=7)
        stream_reviews(stream, store, lambda b: seen.append((b.count(), b.rdd.getNumPartitions())) or analyze.analyze_reviews(b), folder("checkpoint")).awaitTermination()

    def add(rows):
        spark.createDataFrame(rows, "id long, body string").coalesce(1).write.mode("append").parquet(folder("table"))

    add([(-9, "Good food"), (0, None), (5, "bad"), (None, "no id"), (40, "great")])
    run()
    assert sorted(r.review_id for r in store.results().collect()) == [-9, 0, 5, 40] and seen[-1] == (4, 8)
    run()
    assert len(seen) == 1  # nothing new, no batch
    add([(41, "awful"), (90, "fine"), (6, "late")])
    run()
    assert seen[-1][0] == 2 and sorted(r.review_id for r in store.results().collect()) == [-9, 0, 5, 40, 41, 90]
    whole = spark.read.parquet(folder("table")).where("id IS NOT NULL").selectExpr("id AS review_id", "body AS text")
    run_batch(whole, store, mode="missing")  # the rule for rows that come late with a lower id
    once = tables.ResultStore(spark, folder("batch"))
    run_batch(whole, once)
    kept = [c for c in once.results().columns if c not in ("created_at", "updated_at")]
    assert sorted(map(str, store.results().select(*kept).collect())) == sorted(map(str, once.results().select(*kept).collect()))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv"])
def test_file_tables(spark, folder, fmt):
    spark.range(-20, 80).selectExpr("id AS review_id", "concat('t', id) AS text").repartition(3).write.option("header", True).format(fmt).save(folder(fmt))
    table = FileTable(folder(fmt), fmt=fmt)
    low, high = table.bounds(10)
    assert high == 79 and 11 <= low <= 79 and table.bounds(79) is None
    found = [r for b in table.read(-5, 30) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(found) == [(k, f"t{k}") for k in range(-4, 31)]


def test_ranges_are_bounded(monkeypatch):
    class Far:
        def bounds(self, after):
            return max(after + 1, 10**12), 10**12 + 99

    reader = id_stream._Reader(Far(), 10)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [p.low for p in parts] == [10**12 - 1 + 10 * k for k in range(10)] and parts[-1].high == 10**12 + 99
    monkeypatch.setattr(id_stream, "MAX_RANGES", 3)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) == 3 and all(a.high == b.low for a, b in zip(parts, parts[1:]))
    assert reader.partitions({"last_id": 5}, {"last_id": 5}) == [] and reader.partitions({"last_id": 9}, {"last_id": 5}) == []


def test_query_tables():
    class Cursor:
        def execute(self, statement, values):
            self.said.append((statement, values))
            self.rows = [(3, 9)] if "MIN" in statement else [(4, "a"), (9, None)]

        def fetchmany(self, n):
            out, self.rows = self.rows[:n], self.rows[n:]
            return out

    class Connection:
        said, closed = [], 0

        def cursor(self):
            cursor = Cursor()
            cursor.said = self.said
            return cursor

        def close(self):
            Connection.closed += 1

    table = QueryTable(Connection, "reviews", "id", "body", "%s", rows=1)
    assert table.bounds(2) == (3, 9)
    assert [b.to_pydict() for b in table.read(3, 9)] == [{"review_id": [4], "text": ["a"]}, {"review_id": [9], "text": [None]}]
    assert Connection.said[1] == ("SELECT id, body FROM reviews WHERE id > %s AND id <= %s", (3, 9)) and Connection.closed >= 1


def test_unsorted_files_are_read_once(spark, folder, monkeypatch):
    monkeypatch.setattr(id_stream, "FREE_ROWS", 100)
    spark.range(-20, 980).selectExpr("IF(id % 50 = 3, null, id) AS review_id", "concat('t', id) AS text").repartition(3).write.parquet(folder("hashed"))
    table, looked = FileTable(folder("hashed")), []
    parts = id_stream._Reader(table, 10).partitions({"last_id": 4}, {"last_id": 900})
    for p in parts:
        looked += [*p.pieces]
        assert (p.low, p.high) == (4, 900)
    assert len(parts) == len(looked) == len(set(looked)) == 3
    found = [r for p in parts for b in id_stream._Reader(table, 10).read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(found) == [(k, f"t{k}") for k in range(5, 901) if k % 50 != 3]
    sorted_ids = spark.range(0, 1000).selectExpr("id AS review_id", "concat('t', id) AS text").repartitionByRange(4, "review_id")
    sorted_ids.write.parquet(folder("sorted"))
    ranges = id_stream._Reader(FileTable(folder("sorted")), 250).partitions({"last_id": -1}, {"last_id": 999})
    assert len(ranges) == 4 and all(r.pieces is None for r in ranges)
