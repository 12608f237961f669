"""Language identification by interpolated Kneser-Ney models over characters.

Counting: every task counts the 4-grams of folded characters of its documents by language; Spark sums them.
Lower orders are continuation counts of the order above. Probabilities and back-off weights are worked out by
joins over whole grams, and so is the score of every 4-gram that occurs in a document: the tables grow with the
distinct grams, and no two grams share an entry. The scores of the most frequent grams, as many as MODEL_BYTES
hold, are broadcast as sorted arrays; the grams that are not among them are joined by gram.

A document gets the language of the least cross-entropy per character. It is rejected when that entropy is
far above what training documents of that language and length have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import remainder, stored, text_blocks

ORDER = 4
MODEL_BYTES = 64 << 20
#: Distinct n-grams a task holds before it passes their counts on.
HELD = 1_000_000
#: Rejection: entropy above the median by SLACK times the distance from the median to the 99th percentile, and
#: by MARGIN nats a character at least. A text partly in another language stays; one in no known language goes.
SLACK = 4.0
MARGIN = 1.0
#: Documents with a letter but fewer than this many characters are never rejected: their entropy says little.
SURE_LENGTH = 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower-cased letter of each code point, a blank for everything else, as 16 bits.

    Letters beyond 16 bits take the numbers that no other letter has, in order: each script has its own. Only the
    rarest ideographs, which come last, share numbers with one another.
    """
    kinds = pretokens.class_table()
    letters = np.flatnonzero((kinds >= pretokens.LETTER) & (kinds <= pretokens.E_))
    low = letters.copy()
    for k, c in enumerate(letters):
        lowered = chr(c).lower()
        if len(lowered) == 1:
            low[k] = ord(lowered)
    short = low < 1 << 16
    free = np.setdiff1d(np.arange(1 << 16), np.append(low[short], 32))
    far = np.unique(low[~short], return_inverse=True)[1]
    table = np.full(0x110000, 32, np.uint16)
    table[letters[short]] = low[short]
    table[letters[~short]] = free[far % len(free)]
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of every character."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return at, points


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams (four 16-bit letters in one number) and the text of each; blanks are merged, three go before a text."""
    at, points = code_points(data)
    folded = fold_table()[points]
    text = np.searchsorted(offsets, at, "right") - 1
    letter = folded != 32
    before = np.zeros(len(letter), bool)
    before[1:] = letter[:-1] & (text[1:] == text[:-1])
    kept = letter | before
    folded, text = folded[kept], text[kept]
    where = np.arange(len(folded)) + 3 * (text + 1)
    line = np.full(len(folded) + 3 * len(offsets), 32, np.uint64)
    line[where] = folded
    keys = line[where - 3] << np.uint64(48) | line[where - 2] << np.uint64(32) | line[where - 1] << np.uint64(16) | line[where]
    return keys.view(np.int64), text


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def flush():
        for lang, (keys, counts) in held.items():
            k, c = _merge(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for first, end, data, offsets in text_blocks(batch.column(0)):
            keys, text = grams(data, offsets)
            own = langs[first:end]
            for lang in set(own.tolist()):
                k, c = np.unique(keys[(own == lang)[text]], return_counts=True)
                slot = held.setdefault(lang, [[], []])
                slot[0].append(k)
                slot[1].append(c)
        for slot in held.values():
            if sum(map(len, slot[0])) > HELD // 4:
                slot[0], slot[1] = ([x] for x in _merge(*slot))
        if sum(len(k) for s in held.values() for k in s[0]) > HELD:
            yield from flush()
    yield from flush()


def _low(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1))


def _by_language(counted: DataFrame, langs: list[str]) -> DataFrame:
    """One row per gram of counted(lang, gram, n): n in all, and c, an array of its counts by language."""
    each = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0).cast("long")) for lang in langs]
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.array(*each).alias("c"))


def _discounts(table: DataFrame, width: int) -> list[float]:
    """Of each language the absolute discount, from how many grams occur once and twice."""
    counts = [F.count_if(F.col("c")[k] == times).alias(f"n{times}_{k}") for k in range(width) for times in (1, 2)]
    r = table.agg(*counts).first()
    raw = [r[f"n1_{k}"] / max(r[f"n1_{k}"] + 2 * r[f"n2_{k}"], 1) for k in range(width)]
    return [min(d, 0.9) if d > 0 else 0.5 for d in raw]


def _solved(counts: DataFrame, width: int) -> list[tuple[DataFrame, DataFrame]]:
    """Of each order from 1: the grams with p and s, arrays by language, and the contexts with their back-off weights.

    counts: gram, n and c as _by_language gives them. p is the interpolated probability of a gram's last letter after
    the others, null where a language does not have the gram; s is its logarithm, or else the score of the gram's
    suffix and the logarithm of the back-off weight of its context. An unseen letter has the score of one in 65,536.
    """
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        kinds = [F.count_if(F.col("c")[k] > 0) for k in range(width)]
        orders[n] = stored(orders[n + 1].groupBy(_low("gram", n).alias("gram")).agg(F.array(*kinds).alias("c")), "grams")
    lower, out = None, []
    for n in range(1, ORDER + 1):
        table = orders[n].withColumn("context", F.shiftrightunsigned("gram", 16) if n > 1 else F.lit(0).cast("long"))
        sums = [F.sum(F.col("c")[k]) for k in range(width)]
        kinds = [F.count_if(F.col("c")[k] > 0) for k in range(width)]
        contexts = table.groupBy("context").agg(F.array(*sums).alias("total"), F.array(*kinds).alias("kinds"))
        discounts = _discounts(table, width)
        weights = [F.try_divide(F.lit(d) * F.col("kinds")[k], F.nullif(F.col("total")[k], F.lit(0))) for k, d in enumerate(discounts)]
        contexts = stored(contexts.withColumn("weights", F.array(*weights)), "contexts")
        joined = table.join(F.broadcast(contexts) if n == 1 else contexts, "context")
        if lower is not None:
            joined = joined.withColumn("short", _low("gram", n - 1)).join(lower, "short")
        p, s = [], []
        for k, d in enumerate(discounts):
            c, weight = F.col("c")[k], F.col("weights")[k]
            share = F.try_divide(F.greatest(c - F.lit(d), F.lit(0.0)), F.nullif(F.col("total")[k], F.lit(0)))
            rest = F.lit(1.0) / (F.col("kinds")[k] + 1) if lower is None else F.col("lower_p")[k]
            after = F.lit(-np.log(65536.0).item()) if lower is None else F.col("lower_s")[k]
            p.append(F.when(c > 0, share + weight * rest))
            s.append(F.coalesce(F.log(p[-1]), F.coalesce(F.log(weight), F.lit(0.0)) + after))
        table = stored(joined.select("gram", *(["n"] if n == ORDER else []), F.array(*p).alias("p"), F.array(*s).alias("s")), "scores")
        lower = table.select(F.col("gram").alias("short"), F.col("p").alias("lower_p"), F.col("s").alias("lower_s"))
        out.append((table, contexts.select("context", "weights")))
    return out


def probabilities(counted: DataFrame) -> DataFrame:
    """(lang, part, gram, value) of counted(lang, gram, n): interpolated probabilities of seen grams in parts 1 to 4,
    back-off weights of contexts in parts 11 to 14 (of the context of order part - 11)."""
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    names, out = F.array(*[F.lit(x) for x in langs]), None
    for n, (table, contexts) in enumerate(_solved(stored(_by_language(counted, langs), "grams4"), len(langs)), 1):
        for part, rows in ((n, table.select("gram", F.posexplode("p").alias("k", "value"))), (10 + n, contexts.select(F.col("context").alias("gram"), F.posexplode("weights").alias("k", "value")))):
            rows = rows.where("value IS NOT NULL").select(F.get(names, "k").alias("lang"), F.lit(part).alias("part"), "gram", "value")
            out = rows if out is None else out.union(rows)
    return out


def learn(docs: DataFrame, taught: Column) -> tuple[list[str], DataFrame | None]:
    """The languages of the rows where `taught` holds and lang is not null, and the scores of all grams of `docs`."""
    lang = F.when(taught, F.col("lang").cast("string")).alias("lang")
    rows = docs.select(F.col("text").cast("string").alias("text"), lang).where("text IS NOT NULL")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect() if r.lang is not None)
    if not langs:
        return langs, None
    counted = rows.mapInArrow(_counting, "lang string, gram long, n long")
    table, _ = _solved(stored(_by_language(counted, langs), "grams4"), len(langs))[-1]
    return langs, table.select("gram", "n", F.col("s").cast("array<float>").alias("scores"))


def frequent(scores: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Sorted grams and scores of the most frequent grams, at most MODEL_BYTES, and the table of the others if there are any.

    Which are frequent is decided by the logarithm of n, in steps of a sixteenth, so a gram of the table is in no
    larger share of the text than one in as many as the arrays hold.
    """
    step = F.floor(16 * F.log2("n")).cast("int")
    room, least, rest = MODEL_BYTES // (8 + 4 * width), 1 << 30, False
    for r in scores.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 16 rows an octave
        room -= r["count"]
        if room < 0:
            rest = True
            break
        least = r.step
    table = scores.where(step >= least).select("gram", "scores").toArrow()
    keys = table.column("gram").to_numpy()
    order = np.argsort(keys)
    logs = table.column("scores").combine_chunks().flatten().to_numpy().reshape(-1, width)
    return keys[order], logs[order], scores.where(step < least).select("gram", "scores") if rest else None


def _rare(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """The distinct grams of each of n texts and how often they occur, as lists."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    cuts = pa.array(np.searchsorted(text[first], np.arange(n + 1)), pa.int32())
    times = np.diff(np.append(first, len(keys)))
    return pa.ListArray.from_arrays(cuts, pa.array(keys[first])), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))


def _scoring(held, width: int, more: bool):
    """Letters and summed scores of each text; with `more`, also its grams that are not among the frequent ones."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = held.value
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(0)):
                n = end - first
                keys, text = grams(data, offsets)
                distinct, inverse = np.unique(keys, return_inverse=True)
                at = np.searchsorted(known, distinct)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == distinct[hit]
                logs = np.zeros((len(distinct), width), np.float32)
                logs[hit] = scores[at[hit]]
                logs = logs[inverse]
                sums = np.zeros((n, width))
                for k in range(width):
                    sums[:, k] = np.bincount(text, weights=logs[:, k], minlength=n)
                columns = [
                    *[c.slice(first, n) for c in batch.columns[1:]],
                    pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(sums.reshape(-1))),
                ]
                if more:
                    left = ~hit[inverse]
                    columns += _rare(keys[left], text[left], n)
                names = [*batch.schema.names[1:], "length", "sums", "rare", "times"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return score


def _judging(langs: list[str]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes = batch.num_rows, batch.column(3).to_numpy()
            best, entropy, sure = [None] * n, np.zeros(n), np.zeros(n)
            if langs and n:
                means = batch.column(4).flatten().to_numpy().reshape(n, len(langs)) / np.maximum(sizes, 1)[:, None]
                top = means.argmax(axis=1)
                entropy = -means[np.arange(n), top]
                sure = 1 / np.exp(10 * (means + entropy[:, None])).sum(axis=1)
                best = [langs[t] if s else None for t, s in zip(top, sizes)]
            columns = [*batch.columns[:3], pa.array(best, pa.string()), pa.array(np.where(sizes > 0, sure, 0.0)), pa.array(entropy), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "name", "lang", "best", "sure", "entropy", "length"])

    return judge


def judge_texts(plain: DataFrame, langs: list[str], scores: DataFrame | None) -> DataFrame:
    """doc_id, name, lang, best, sure, entropy and length of each row of `plain`, from the summed scores of all its grams."""
    width, rest = len(langs), None
    known = np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    if scores is not None:
        *known, rest = frequent(scores, width)
    held = plain.sparkSession.sparkContext.broadcast(tuple(known))
    fields = "doc_id long, name long, lang string, best string, sure double, entropy double, length long"
    judge = _judging(langs)
    if rest is None:
        score = _scoring(held, width, False)
        return plain.mapInArrow(lambda batches: judge(score(batches)), fields)
    some = plain.mapInArrow(_scoring(held, width, True), "doc_id long, name long, lang string, length long, sums array<double>, rare array<long>, times array<long>")
    parts = stored(some.withColumn("row", F.monotonically_increasing_id()), "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("row", F.col("z.rare").alias("gram"), F.col("z.times").alias("times"))
    added = rare.join(rest, "gram").groupBy("row").agg(*[F.sum(F.col("times") * F.col("scores")[k].cast("double")).alias(f"more{k}") for k in range(width)])
    sums = F.array(*[F.col("sums")[k] + F.coalesce(F.col(f"more{k}"), F.lit(0.0)) for k in range(width)]).alias("sums")
    return parts.join(added, "row", "left").select("doc_id", "name", "lang", "length", sums).mapInArrow(judge, fields)


def identify(docs: DataFrame, taught: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected, name (hash of the text) for every row of `docs`.

    taught: condition on doc_id of the rows whose lang may be learned from; by default the remainders other than 1.
    Null, empty and letterless texts are `und` with score 0 and rejected; so is every row if no language can be
    learned. Ties go to the language that sorts first. Repeated rows are scored as often as they are given.
    Extra columns are ignored.
    """
    taught = remainder(F.col("doc_id"), 3) != 1 if taught is None else taught
    langs, scores = learn(docs, taught)
    plain = docs.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("name"),
        F.when(taught, F.col("lang").cast("string")).alias("lang"),
    )
    scored = stored(judge_texts(plain, langs, scores), "languages")
    size = F.floor(F.log2(F.greatest("length", F.lit(1)))).cast("int")
    right = scored.where("lang = best AND length > 0").select("best", size.alias("size"), "entropy")
    at = F.percentile_approx("entropy", [0.5, 0.99], 10_000)
    limits = right.groupBy("best", "size").agg(at.alias("q"), F.count("*").alias("n")).where("n >= 100")
    limit = F.col("q")[0] + F.greatest(SLACK * (F.col("q")[1] - F.col("q")[0]), F.lit(MARGIN))
    limits = limits.select("best", "size", limit.alias("own_limit"))
    common = right.groupBy("best").agg(at.alias("q")).select("best", limit.alias("any_limit"))
    judged = scored.withColumn("size", size).join(F.broadcast(limits), ["best", "size"], "left").join(F.broadcast(common), "best", "left")
    return judged.select(
        "doc_id",
        F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).otherwise(F.col("sure")).alias("score"),
        "entropy",
        (F.col("best").isNull() | ((F.col("length") >= SURE_LENGTH) & (F.col("entropy") > F.greatest("own_limit", "any_limit")))).alias("rejected"),
        "name",
    )
