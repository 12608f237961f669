"""One registered query per corpus operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_formatting, class_lm, decontamination, fill_middle, language_id, near_dedup, packing, quality_classifier, quality_rules, repeated_spans, spelling_variants, token_counts, toxicity
from .common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a text: lower-cased A-Z, cut at ASCII white space.
_WORDS = r"""
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')
"""

_NEAR = f"""
WITH RECURSIVE tokens AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM tokens WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
classes AS (
    SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, name) AS rep
    FROM (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS name FROM shingles GROUP BY doc_id)
),
reps AS (SELECT s.doc_id, s.s FROM shingles s JOIN classes c USING (doc_id) WHERE c.rep = s.doc_id),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM reps x JOIN reps y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
    JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
    WHERE 100 * p.n >= 75 * (sa.n + sb.n - p.n)
),
reach(a, b) AS (
    SELECT rep, rep FROM classes
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN classes c USING (doc_id) LEFT JOIN roots r ON r.a = c.rep
"""


@query(_NEAR)
def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op8_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query()
def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_REPEATS = """
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, k, md5(h[k+1:k+400]) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS k FROM n WHERE n >= 400)),
hit AS (SELECT doc_id, k FROM win JOIN (SELECT m FROM win GROUP BY m HAVING count(*) > 1) USING (m)),
marked AS (SELECT doc_id, k, (k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -1000) + 400)::INT AS opens FROM hit),
runs AS (
    SELECT doc_id, min(k) AS b, max(k) + 400 AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM marked) GROUP BY doc_id, g
),
gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM runs),
totals AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last_e FROM runs GROUP BY doc_id),
pieces AS (
    SELECT doc_id, b AS pos, hex(h[a+1:b]) AS s FROM gaps JOIN n USING (doc_id)
    UNION ALL
    SELECT doc_id, n + 1, hex(h[coalesce(last_e, 0)+1:n]) FROM n LEFT JOIN totals USING (doc_id)
),
kept AS (SELECT doc_id, sha256(unhex(string_agg(s, '' ORDER BY pos))) AS kept_sha256 FROM pieces GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM n LEFT JOIN totals USING (doc_id) JOIN kept USING (doc_id)
"""


@query(_REPEATS)
def op9_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))


_ITEM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
wi AS (
    SELECT DISTINCT item_id, n, array_to_string(w[k:k+n-1], ' ') AS s
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)
),
wd AS (
    SELECT doc_id, n, k, array_to_string(w[k:k+n-1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM wi) WHERE len(w) >= n)
),
found AS (SELECT wd.doc_id, wd.k, wd.n, wi.item_id FROM wd JOIN wi ON wi.n = wd.n AND wi.s = wd.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query(_LEAKS)
def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query()
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected", "entropy")


def _marks(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("label"))


@query()
def op5_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = toxicity.toxicity(table(spark, sf_dir, "documents"), _marks(spark, sf_dir, "toxic"))
    return rated.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op7_fourier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_classifier.quality(table(spark, sf_dir, "documents"), _marks(spark, sf_dir, "quality"))
    return rated.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM t),
win AS (SELECT doc_id, k, w[k:k+2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k+1, k+2]) AS p FROM again) GROUP BY doc_id),
m AS (
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
           (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
           coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
    FROM w LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m
"""


@query(_RULES)
def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digests(table(spark, sf_dir, "documents")).drop("failed_rule")


_CHATS = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
    SELECT conv_id, list('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, md5(role || chr(31) || text)) AS l
    FROM t GROUP BY conv_id
),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
f AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l)
SELECT conv_id, len(l)::BIGINT AS n_turns, n_copies, array_to_string(l, '') AS text FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = f.l)
"""


@query(_CHATS)
def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.format_chats(table(spark, sf_dir, "conversations"))


_MIDDLES = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
    SELECT doc_id, t, n, ('0x' || h[1:8])::UBIGINT::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::UBIGINT::BIGINT % (n + 1) AS c2,
           ('0x' || h[17:24])::UBIGINT::BIGINT % 100 AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT % 100 AS h4 FROM t
),
f AS (
    SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM u
),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""


@query(_MIDDLES)
def op13_rank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256")
    again = F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, again)


_VARIANTS = """
WITH RECURSIVE tab AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
),
each AS (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc, run),
summed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(x) // 2 + 1), lambda k: ('0x' || x[2*k-1:2*k])::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
    FROM each, tab
),
said AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT a.word AS long, a.n AS long_n, b.word AS short, b.n AS short_n FROM less a JOIN words b ON a.s = b.word),
near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
    UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter
),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, encode(near))) AS near FROM near GROUP BY word),
rated AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN near END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
    FROM words LEFT JOIN best USING (word)
),
steps(word, here, k) AS (SELECT word, word, 0 FROM rated UNION ALL SELECT s.word, r.form, k + 1 FROM steps s JOIN rated r ON r.word = s.here WHERE r.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM rated JOIN ends USING (word)
"""


@query(_VARIANTS)
def op11_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


@query()
def op12_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = class_lm.score_texts(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", (~F.col("taught")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
