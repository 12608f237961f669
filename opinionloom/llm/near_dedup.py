"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

Steps of `near_duplicates`:

1. One pass over the texts gives each document its set of word shingles, a 128-bit name of the set and
   a SuperMinHash signature. Sets are not kept; only the set size, the name and the signature are.
2. Documents with one and the same set are one class. The smallest doc_id stands for the class in all
   further steps, so a group of a million exact copies costs one document.
3. The signature is cut into bands. Documents that agree in a band meet in its bucket.
4. Each bucket has a hub, another one in each band; members are verified against the hub on full sets.
   That is linear in the bucket, and it joins a group of near copies through many hubs.
5. In buckets that still hold several components, the pairs between different components are compared
   in blocks inside tasks: first by signature, then on full sets. Pairs are never emitted; verified
   links are. So no link between documents that share a bucket is lost.
6. Union-find over the verified links.

With 32 bands of 4 registers, a pair at similarity 0.75 shares no bucket with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, list_array, mix, shingle_sets, sorted_runs, stored, stream, text_table
from .components import components, find, union

BANDS = 32
ROWS = 4
#: Members of one bucket that one task compares with another block of the same bucket.
BLOCK = 1024


def superminhash(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SuperMinHash signatures, one row a set; values order as step + uniform.

    Every element draws a pseudo-random permutation of the registers step by step, and at step j puts
    j + uniform into the register that the permutation names. All elements of all sets take a step
    together. A set stops once each register holds a value below the next step: nothing later can be less.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), registers), np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.tile(np.arange(registers, dtype=np.uint16), (len(elements), 1))
    active = np.arange(len(elements))
    flat = out.reshape(-1)
    steps = stream(77, registers)
    running = np.flatnonzero(sizes)
    for j in range(registers):
        draw = mix(elements[active] ^ steps[j])
        k = j + (((draw >> np.uint64(32)) * np.uint64(registers - j)) >> np.uint64(32)).astype(np.int64)
        chosen = order[active, k]
        order[active, k] = order[active, j]
        value = (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, owner[active] * registers + chosen, value)
        running = running[out[running].max(axis=1) >= np.uint64((j + 1) << 32)]
        if not len(running):
            break
        open_sets = np.zeros(len(sets), bool)
        open_sets[running] = True
        active = active[open_sets[owner[active]]]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        keys[:, b] = combine([signatures[:, b * rows + r] for r in range(rows)], 1000 + b)
    return keys


def _sketcher(size: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, sets in shingle_sets(batch.column(1), size, 1 << 19):
                signatures = superminhash(sets, bands * rows)
                keys = band_keys(signatures, bands, rows).view(np.int64)
                names = [[int(s[k::2].sum(dtype=np.uint64) ^ mix(s + np.uint64(k)).sum(dtype=np.uint64)) for s in sets] for k in (0, 1)]
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([f"{a:016x}{b:016x}" for a, b in zip(*names)], pa.string()),
                        list_array([k if f else k[:0] for k, f in zip(keys, full)], pa.int64()),
                        list_array([(s & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16) if f else np.zeros(0, np.int16) for s, f in zip(signatures, full)], pa.int16()),
                    ],
                    names=["doc_id", "n_shingles", "name", "keys", "sketch"],
                )

    return sketch


def _set_maker(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "members"]
                )

    return make


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(left, right)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return verify


def _block_linker(percent: int, registers: int):
    """Verified links between components inside one pair of blocks of a bucket."""
    loose = (percent / 100 - 0.25) * registers

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, "cell"):
            ids, roots = (table.column(c).to_numpy() for c in ("doc_id", "root"))
            keys = np.vstack([np.asarray(x) for x in table.column("keys").to_pylist()])
            band = np.flatnonzero(keys[0] == table.column("key")[0].as_py())[0]
            sketches = np.vstack([np.asarray(x, np.int16) for x in table.column("sketch").to_pylist()])
            sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
            block = table.column("block").to_numpy()
            parent: dict[int, int] = {}
            a, b = [], []
            for k in range(len(ids)):
                rest = np.arange(k + 1, len(ids))
                rest = rest[(roots[rest] != roots[k]) & ((block[rest] != block[k]) | (block == block[0]).all())]
                rest = rest[(sketches[rest] == sketches[k]).sum(axis=1) >= loose]
                rest = rest[~(keys[rest][:, :band] == keys[k][:band]).any(axis=1)]
                for o in rest:
                    if find(parent, int(roots[k])) != find(parent, int(roots[o])) and _similar(sets[k], sets[o], percent):
                        union(parent, int(roots[k]), int(roots[o]))
                        a.append(ids[k])
                        b.append(ids[o])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing. A text of fewer than `size` words
    is one shingle. Rows that repeat a doc_id appear as often as they are given; the smallest doc_id of a
    group is kept. An empty table gives an empty table. Columns other than doc_id and text are ignored.
    """
    texts = text_table(docs)
    fields = "doc_id long, n_shingles long, name string, keys array<long>, sketch array<short>"
    sketches = stored(texts.mapInArrow(_sketcher(size, bands, rows), fields), "sketches")
    full = sketches.where("n_shingles > 0")
    classes = full.groupBy("name").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    members = reps.select("doc_id", F.explode("keys").alias("key")).distinct()
    hubs = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key", "doc_id").alias("h"), "doc_id")).alias("hub")).where("n > 1")
    crowded = stored(members.join(hubs, "key").select("key", "n", "doc_id", F.col("hub.doc_id").alias("hub")), "buckets")
    pairs = crowded.where("doc_id != hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()

    wanted = crowded.select("doc_id").distinct()
    sets = stored(
        texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_set_maker(size), "doc_id long, members binary"), "sets"
    )
    with_sets = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left")), "a"
    )
    links = stored(with_sets.select("a", "b", "left", "right").mapInArrow(_verifier(percent), "a long, b long"), "links")
    roots = components(links)

    placed = crowded.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    rest = placed.join(open_keys, "key", "left_semi").select("key", "n", "doc_id", "root")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks.cast("bigint")).cast("int")
    cells = rest.withColumn("blocks", blocks).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    cells = cells.join(reps.select("doc_id", "keys", "sketch"), "doc_id").join(sets, "doc_id")
    more = (
        cells.select("cell", "key", "block", "doc_id", "root", "keys", "sketch", "members")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_block_linker(percent, bands * rows), "a long, b long")
    )
    final = components(links.union(stored(more, "links")))

    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("name", F.coalesce("root", "rep").alias("component_id"))
    grouped = full.join(named, "name").select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
