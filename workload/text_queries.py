"""Text shaping and rule sentiment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from opinionloom import resources
from opinionloom.operators import boundaries, lexicon, phrases, shaping, tagging

from . import inputs as I
from .registry import query, rounded


@query(f"WITH {I.PROSE}, {I.sentences_sql('prose')} SELECT review_id, sent_idx, sentence FROM sent")
def split_sentences(spark, sf_dir):
    return shaping.split_sentences(I.prose(spark, sf_dir))


PROSE_STOP = ["the", "of", "de", "and", "to", "in", "la", "a", "der", "is"]

_TOKENS = f"""{I.PROSE}, {I.sentences_sql('prose')},
token_lists AS (SELECT review_id, sent_idx, regexp_extract_all(sentence, {I.TOKEN_SQL}) AS l FROM sent),
tokens AS (SELECT review_id, sent_idx, unnest(l) AS token, (generate_subscripts(l, 1) - 1)::INT AS tok_idx FROM token_lists)"""


@query(f"""WITH {_TOKENS}
SELECT review_id, sent_idx, tok_idx, token,
       regexp_full_match(token, '\\p{{L}}+')::INT AS is_alpha,
       (lower(token) IN ({', '.join(I.quoted(w) for w in PROSE_STOP)}))::INT AS is_stop,
       regexp_full_match(token, '\\p{{P}}+')::INT AS is_punct
FROM tokens""")
def tokenize(spark, sf_dir):
    flags = ["is_alpha", "is_stop", "is_punct"]
    tokens = shaping.tokenize(I.prose(spark, sf_dir), PROSE_STOP)
    return tokens.withColumns({c: F.col(c).cast("int") for c in flags})


_POS_ROWS = [("the", "th", "DET", "DT"), ("of", "of", "ADP", "IN"), ("tion", "tio", "NOUN", "NN"), ("und", "u", "CONJ", "CC"),
             ("ble", "bl", "ADJ", "JJ"), ("que", "qu", "PRON", "WP")]


@query(f"""WITH {_TOKENS},
lex(w, lemma, pos, tag) AS (VALUES {', '.join(str(r) for r in _POS_ROWS)})
SELECT review_id, sent_idx, tok_idx, token, coalesce(lemma, lower(token)) AS lemma, coalesce(pos, 'X') AS pos,
       coalesce(tag, '') AS tag
FROM tokens LEFT JOIN lex ON lower(token) = w""")
def annotate_tokens(spark, sf_dir):
    tokens = shaping.tokenize(I.prose(spark, sf_dir)).select("review_id", "sent_idx", "tok_idx", "token")
    return shaping.annotate_tokens(tokens, spark.createDataFrame(_POS_ROWS, "token string, lemma string, pos string, tag string"))


_TAG_ROWS = [
    ("the", "the", "DET", "DT", 1.0), ("der", "der", "DET", "DT", 3.0), ("der", "der", "PRON", "PRP", 1.0), ("die", "die", "DET", "DT", 3.0), ("die", "die", "VERB", "VB", 1.0),
    ("la", "le", "DET", "DT", 2.0), ("la", "la", "NOUN", "NN", 1.0), ("le", "le", "DET", "DT", 1.0), ("of", "of", "ADP", "IN", 1.0), ("de", "de", "ADP", "IN", 1.0),
    ("in", "in", "ADP", "IN", 3.0), ("in", "in", "ADV", "RB", 1.0), ("to", "to", "ADP", "IN", 1.0), ("to", "to", "PART", "TO", 2.0), ("and", "and", "CONJ", "CC", 1.0),
    ("und", "und", "CONJ", "CC", 1.0), ("that", "that", "PRON", "DT", 1.0), ("that", "that", "CONJ", "IN", 1.0), ("it", "it", "PRON", "PRP", 1.0), ("is", "be", "VERB", "VBZ", 1.0),
    ("was", "be", "VERB", "VBD", 1.0), ("thed", "the", "VERB", "VBD", 1.0), ("ored", "ore", "VERB", "VBD", 1.0), ("tions", "tion", "NOUN", "NNS", 1.0),
    ("ations", "ation", "NOUN", "NNS", 1.0), ("ble", "ble", "ADJ", "JJ", 1.0), ("able", "able", "ADJ", "JJ", 1.0), ("thing", "thing", "NOUN", "NN", 1.0), ("oring", "ore", "VERB", "VBG", 1.0),
]

# Possible tags of each distinct word: its entries, else those of its longest ending that two listed words share.
_OPTIONS = f"""{_TOKENS},
lex(w, lemma, pos, tag, weight) AS (VALUES {', '.join(str(r) for r in _TAG_ROWS)}),
entries AS (SELECT w, pos, round(-ln(weight / sum(weight) OVER (PARTITION BY w)) * 1e6)::BIGINT AS cost FROM lex),
tails AS (SELECT w, pos, unnest(range(least(length(w), 6))) AS n FROM entries),
of_ending AS (SELECT right(w, n) AS ending, pos, count(*) AS n FROM tails GROUP BY 1, 2),
endings AS (SELECT ending, pos, round(-ln(n / sum(n) OVER (PARTITION BY ending)) * 1e6)::BIGINT AS cost FROM of_ending
            QUALIFY sum(n) OVER (PARTITION BY ending) >= 2 OR ending = ''),
words AS (SELECT DISTINCT lower(token) AS w FROM tokens),
unlisted AS (SELECT w, unnest(range(least(length(w), 6))) AS n FROM words ANTI JOIN entries USING (w) WHERE regexp_full_match(w, '\\p{{L}}+')),
longest AS (SELECT w, max(n) AS n FROM unlisted WHERE right(w, n) IN (SELECT ending FROM endings) GROUP BY w),
options AS MATERIALIZED (
  SELECT w, pos, cost FROM words JOIN entries USING (w)
  UNION ALL SELECT w, pos, cost FROM longest JOIN endings ON ending = right(w, n)
  UNION ALL SELECT w, CASE WHEN regexp_matches(w, '\\p{{N}}') AND NOT regexp_matches(w, '\\p{{L}}') THEN 'NUM' WHEN regexp_full_match(w, '\\p{{P}}+') THEN 'PUNCT' ELSE 'X' END, 0
  FROM words ANTI JOIN entries USING (w) WHERE NOT regexp_full_match(w, '\\p{{L}}+')),
certain AS (SELECT w, min(pos) AS pos FROM options GROUP BY w HAVING count(*) = 1),
known AS (SELECT review_id, sent_idx, tok_idx, token, c.pos FROM tokens LEFT JOIN certain c ON lower(token) = w),
neighbours AS (SELECT pos, CASE WHEN tok_idx = 0 THEN '' ELSE lag(pos) OVER (PARTITION BY review_id, sent_idx ORDER BY tok_idx) END AS before FROM known),
transitions AS (SELECT before, pos, count(*) AS n FROM neighbours WHERE before IS NOT NULL AND pos IS NOT NULL GROUP BY 1, 2)"""


def _tag_rows(spark):
    return spark.createDataFrame(_TAG_ROWS, "token string, lemma string, pos string, tag string, weight double")


@query(f"WITH {_OPTIONS} SELECT before, pos, n FROM transitions")
def tag_transitions(spark, sf_dir):
    entries = tagging.dictionary_entries(_tag_rows(spark))
    tokens = shaping.tokenize(I.prose(spark, sf_dir)).select("review_id", "sent_idx", "tok_idx", "token")
    return tagging.transition_counts(tagging.certain_tags(tokens, entries, tagging.ending_rules(entries)))


# The best sequence is found between words with one possible tag, which part a sentence into runs: forth by least costs, back by the tag each came from.
@query(f"""WITH RECURSIVE {_OPTIONS},
tags AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS code FROM (SELECT pos FROM lex UNION SELECT unnest(['NUM', 'PUNCT', 'X']))),
pairs AS (SELECT b.pos AS before, b.code AS a, t.pos, t.code FROM (SELECT pos, code FROM tags UNION ALL SELECT '', -1) b, tags t),
steps AS MATERIALIZED (SELECT a, code AS b, round(-ln((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a)) * 1e6)::BIGINT AS cost
          FROM pairs LEFT JOIN transitions USING (before, pos)),
parted AS (SELECT review_id, sent_idx, tok_idx, token, pos IS NOT NULL AS sure,
                  count(pos) OVER (PARTITION BY review_id, sent_idx ORDER BY tok_idx) AS run FROM known),
placed AS (SELECT *, true AS own FROM parted UNION ALL SELECT * REPLACE (run - 1 AS run), false FROM parted WHERE sure AND tok_idx > 0),
numbered AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY review_id, sent_idx, run) AS id, tok_idx - min(tok_idx) OVER (PARTITION BY review_id, sent_idx, run) AS k FROM placed),
choices AS MATERIALIZED (SELECT id, k, tok_idx, code, cost FROM numbered JOIN options ON w = lower(token) JOIN tags USING (pos)),
forth AS (
  SELECT id, k, c.code, CASE WHEN tok_idx = 0 THEN s.cost ELSE 0 END + c.cost AS score, -1::BIGINT AS came FROM choices c JOIN steps s ON a = -1 AND b = c.code WHERE k = 0
  UNION ALL
  SELECT c.id, c.k, c.code, min((f.score + s.cost) * 64 + f.code) // 64 + min(c.cost), min((f.score + s.cost) * 64 + f.code) % 64
  FROM forth f JOIN choices c ON c.id = f.id AND c.k = f.k + 1 JOIN steps s ON s.a = f.code AND s.b = c.code GROUP BY c.id, c.k, c.code),
lasts AS (SELECT id, k, arg_min(code, score * 64 + code) AS code FROM forth WHERE (id, k) IN (SELECT id, max(k) FROM numbered GROUP BY id) GROUP BY id, k),
back AS (
  SELECT f.id, f.k, f.code, f.came FROM forth f JOIN lasts USING (id, k, code)
  UNION ALL SELECT f.id, f.k, f.code, f.came FROM back b JOIN forth f ON f.id = b.id AND f.k = b.k - 1 AND f.code = b.came)
SELECT review_id, sent_idx, tok_idx, token, pos FROM numbered JOIN back USING (id, k) JOIN tags USING (code) WHERE own""")
def tag_in_context(spark, sf_dir):
    tokens = shaping.tokenize(I.prose(spark, sf_dir)).select("review_id", "sent_idx", "tok_idx", "token")
    tagged = tagging.tag_in_context(tokens, tagging.learn_tags(tokens, _tag_rows(spark)))
    return tagged.select("review_id", "sent_idx", "tok_idx", "token", "pos")


_NOUN_PHRASES = f"""WITH {_TOKENS},
pos_of(w, code) AS (VALUES {', '.join(f"({I.quoted(w)}, '{'J' if c == shaping.ADJECTIVE else 'N'}')" for w, c in I.PROSE_POS.items())}),
coded AS (SELECT t.*, coalesce(code, 'x') AS code FROM tokens t LEFT JOIN pos_of ON lower(token) = w),
grouped AS (
  SELECT *, lag(code, 1, 'x') OVER s AS before, tok_idx - row_number() OVER (PARTITION BY review_id, sent_idx, code = 'x' ORDER BY tok_idx) AS island
  FROM coded WINDOW s AS (PARTITION BY review_id, sent_idx ORDER BY tok_idx)),
islands AS (
  SELECT review_id, sent_idx, island, min(tok_idx) AS first_idx, string_agg(code, '' ORDER BY tok_idx) AS codes,
         list(token ORDER BY tok_idx) AS toks FROM grouped WHERE code <> 'x' GROUP BY 1, 2, 3),
starts AS (SELECT *, unnest(range(len(toks))) AS o FROM islands),
spans AS (SELECT *, unnest(range(1, len(toks) - o + 1)) AS n FROM starts)
SELECT review_id, sent_idx, (first_idx + o)::INT AS tok_idx, n::INT AS n_words,
       lower(array_to_string(list_slice(toks, o + 1, o + n), ' ')) AS phrase,
       ((o = 0 OR (codes[o] = 'N' AND codes[o + 1] = 'J')) AND (o + n = len(toks) OR codes[o + n + 1] = 'J'))::INT AS is_chunk
FROM spans WHERE regexp_full_match(substr(codes, o + 1, n), 'J*N+')"""


@query(_NOUN_PHRASES)
def noun_phrases(spark, sf_dir):
    phrases = shaping.noun_phrases(I.prose(spark, sf_dir), I.PROSE_POS)
    return phrases.withColumn("is_chunk", F.col("is_chunk").cast("int"))


@query(_NOUN_PHRASES)
def noun_phrases_joined(spark, sf_dir):
    """The dictionary as a table that is joined with the words."""
    listed = spark.createDataFrame(list(I.PROSE_POS.items()), "token string, code int")
    phrases = shaping.noun_phrases(I.prose(spark, sf_dir), listed, max_inline=0)
    return phrases.withColumn("is_chunk", F.col("is_chunk").cast("int"))


@query(f"WITH {I.OPINIONS}, {I.units_sql('opinions')} SELECT review_id, unit_idx, unit FROM units")
def meaningful_sentences(spark, sf_dir):
    return shaping.meaningful_sentences(I.opinions(spark, sf_dir))


@query(f"WITH {I.OPINIONS}, {I.clauses_sql('opinions')} SELECT review_id, clause_idx, clause FROM clauses")
def emotion_clauses(spark, sf_dir):
    return shaping.emotion_clauses(I.opinions(spark, sf_dir))


@query(f"WITH {I.DIALOGUE}, {I.clauses_sql('dialogue')} SELECT review_id, clause_idx, clause FROM clauses")
def dialogue_clauses(spark, sf_dir):
    return shaping.emotion_clauses(I.dialogue(spark, sf_dir))


CLAUSES_OF_ASPECT = f"""but_lists AS (
  SELECT review_id, text, aspect, string_split_regex({I.strip_sql('text')}, {I.quoted('(?i),?' + I._WS + '+but' + I._WS + '+')}) AS l
  FROM pairs),
but_kept AS (
  SELECT review_id, aspect,
         CASE WHEN len(l) <= 1 THEN [text] ELSE list_filter(l, lambda c: contains(lower(c), lower(aspect))) END AS l
  FROM but_lists),
aspect_clauses AS (
  SELECT review_id, aspect, (generate_subscripts(l, 1) - 1)::INT AS clause_idx, unnest(l) AS clause FROM but_kept
  UNION ALL
  SELECT review_id, aspect, 0, NULL FROM but_kept WHERE len(l) = 0)"""


@query(f"""WITH {I.OPINION_ASPECTS},
pairs AS (SELECT review_id, text, aspect FROM listed JOIN worded USING (review_id)), {CLAUSES_OF_ASPECT}
SELECT review_id, aspect, clause_idx, clause FROM aspect_clauses""")
def contrast_clauses(spark, sf_dir):
    return shaping.contrast_clauses(I.opinion_aspects(spark, sf_dir))


@query(f"WITH {I.PROSE}, {I.sentences_sql('prose')} SELECT review_id, array_to_string(l, ' ') AS text FROM sent_lists")
def normalize_text(spark, sf_dir):
    return shaping.normalize_text(I.prose(spark, sf_dir))


@query(f"""WITH {I.OPINIONS}
SELECT review_id, {I.strip_sql(f"regexp_replace({I.strip_sql('text')}, '[.,!?;:]+$', '')")} AS text FROM opinions""")
def strip_punct(spark, sf_dir):
    return shaping.strip_punct(I.opinions(spark, sf_dir))


_PROSE_UNITS = f"{I.PROSE}, {I.units_sql('prose')}, {I.unit_scores_sql(I.PROSE_LEXICON)}"


@query(f"WITH {_PROSE_UNITS} SELECT review_id, unit_idx, round(valence, 9) AS valence FROM unit_scores")
def valence_score(spark, sf_dir):
    units = shaping.meaningful_sentences(I.prose(spark, sf_dir))
    return rounded(lexicon.valence_score(units, I.PROSE_LEXICON))


@query(f"WITH {_PROSE_UNITS} SELECT review_id, unit_idx, round(polarity, 9) AS polarity FROM unit_scores")
def polarity_score(spark, sf_dir):
    units = shaping.meaningful_sentences(I.prose(spark, sf_dir))
    return rounded(lexicon.polarity_score(units, I.PROSE_LEXICON))


_ROUNDED_RULE = "round(valence_score, 9) AS valence_score, round(polarity_score, 9) AS polarity_score, round(rule_polarity, 9) AS rule_polarity"


@query(f"WITH {_PROSE_UNITS}, {I.RULE_SQL} SELECT review_id, {_ROUNDED_RULE} FROM rule")
def rule_aggregate(spark, sf_dir):
    units = shaping.meaningful_sentences(I.prose(spark, sf_dir))
    return rounded(lexicon.rule_aggregate(lexicon.unit_scores(units, I.PROSE_LEXICON)))


@query(f"WITH {_PROSE_UNITS}, {I.RULE_SQL} SELECT review_id, {_ROUNDED_RULE} FROM rule")
def rule_aggregate_joined(spark, sf_dir):
    units = shaping.meaningful_sentences(I.prose(spark, sf_dir))
    words = {*I.PROSE_LEXICON.valence, *I.PROSE_LEXICON.polarity}
    rows = [(w, I.PROSE_LEXICON.valence.get(w), I.PROSE_LEXICON.polarity.get(w)) for w in sorted(words)]
    entries = spark.createDataFrame(rows, "token string, valence_milli int, polarity_milli int")
    return rounded(lexicon.rule_aggregate(lexicon.unit_scores_joined(units, entries, I.PROSE_LEXICON)))


# No idiom begins as another one ends, so that plain SQL can find them.
_IN_CONTEXT = replace(I.PROSE_LEXICON, capitals=True, contrast=("and", "und"),
                      idioms={"of the": 1700, "of the tion": -1300, "ing der": 900, "to the": -600, "in la": 1100})


def _context_sql() -> str:
    """valences(review_id, unit_idx, valence) of loud(review_id, unit_idx, unit), by windows over words."""
    lex = _IN_CONTEXT
    turns = ", ".join(I.quoted(w) for w in lex.contrast)
    grams = ", ".join(f"({I.quoted(k)}, {len(k.split())}, {v})" for k, v in lex.idioms.items())
    place = "(PARTITION BY review_id, unit_idx ORDER BY i)"

    def before(flag: str) -> list[str]:
        return [f"coalesce(lag({flag}, {d}) OVER {place}, 0)" for d in (1, 2, 3)]

    boosts = " + ".join(f"{b} * {weight}" for b, weight in zip(before("own"), (100, 95, 90)))
    return f"""{I.lexicon_sql(lex)}, idioms(g, size, iv) AS (VALUES {grams}),
loud_words AS (SELECT review_id, unit_idx, unnest(l) AS cased, generate_subscripts(l, 1) AS i
               FROM (SELECT review_id, unit_idx, regexp_extract_all(unit, {I.WORD_SQL}) AS l FROM loud)),
flagged AS (SELECT *, lower(cased) AS w, (cased = upper(cased) AND cased <> lower(cased))::INT AS flag FROM loud_words),
read AS (SELECT *, CASE WHEN min(flag) OVER u = 0 THEN flag ELSE 0 END AS cap, min(CASE WHEN w IN ({turns}) THEN i END) OVER u AS turn,
                lead(w, 1) OVER {place} AS w1, lead(w, 2) OVER {place} AS w2 FROM flagged WINDOW u AS (PARTITION BY review_id, unit_idx)),
marked AS (SELECT read.*, v, coalesce(b + sign(b) * 733 * cap, 0) AS own, (neg.w IS NOT NULL OR read.w LIKE '%n''t')::INT AS n,
                  coalesce(i3.iv, i2.iv) AS iv, CASE WHEN i3.iv IS NOT NULL THEN 3 WHEN i2.iv IS NOT NULL THEN 2 ELSE 0 END AS size
           FROM read LEFT JOIN val ON read.w = val.w LEFT JOIN boost ON read.w = boost.w LEFT JOIN neg ON read.w = neg.w
           LEFT JOIN idioms i2 ON i2.g = read.w || ' ' || w1 LEFT JOIN idioms i3 ON i3.g = read.w || ' ' || w1 || ' ' || w2),
near AS (SELECT *, {boosts} + cap * 73300 AS boosted, greatest({', '.join(before('n'))}) AS negated,
                coalesce(lag(size, 1) OVER {place}, 0) > 1 OR coalesce(lag(size, 2) OVER {place}, 0) > 2 OR size > 0 AS inside FROM marked),
counted AS (SELECT *, CASE WHEN size > 0 THEN iv WHEN NOT inside THEN v END AS x,
                   CASE negated WHEN 1 THEN -74 ELSE 100 END * CASE WHEN i < turn THEN 0.5 WHEN i > turn THEN 1.5 ELSE 1.0 END AS factor FROM near),
raws AS (SELECT review_id, unit_idx, coalesce(sum((x * 100 + sign(x) * boosted) * factor), 0) AS raw FROM counted GROUP BY 1, 2),
totals AS (SELECT review_id, unit_idx, coalesce(raw, 0) AS raw, least(4, length(unit) - length(replace(unit, '!', ''))) * 2920000 AS louder
           FROM loud LEFT JOIN raws USING (review_id, unit_idx)),
summed AS (SELECT review_id, unit_idx, (raw + sign(raw) * louder)::DOUBLE / 10000000.0 AS s FROM totals),
valences AS (SELECT review_id, unit_idx, s / sqrt(s * s + 15.0) AS valence FROM summed)"""


@query(f"""WITH {I.PROSE}, {I.units_sql('prose')},
loud AS (SELECT review_id, unit_idx, CASE WHEN review_id % 3 < 2 THEN replace(replace(unit, 'tion', 'TION'), 'with', 'WITH') ELSE unit END AS unit FROM units),
{_context_sql()} SELECT review_id, unit_idx, round(valence, 9) AS valence FROM valences""")
def valence_in_context(spark, sf_dir):
    """Compound scores with capitals, words of contrast and idioms; two texts in three have some words in capitals."""
    units = shaping.meaningful_sentences(I.prose(spark, sf_dir))
    raised = F.replace(F.replace(F.col("unit"), F.lit("tion"), F.lit("TION")), F.lit("with"), F.lit("WITH"))
    loud = units.withColumn("unit", F.when(F.col("review_id") % 3 < 2, raised).otherwise(F.col("unit")))
    return rounded(lexicon.valence_score(loud, _IN_CONTEXT))


_LABELS = """CASE WHEN rule_polarity >= 0.05 THEN 1 WHEN rule_polarity <= -0.05 THEN -1 ELSE 0 END::INT AS rule_score,
CASE WHEN rule_polarity >= 0.05 THEN 'positive' WHEN rule_polarity <= -0.05 THEN 'negative' ELSE 'neutral' END AS rule_label"""


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS review_id, l_discount - l_tax AS rule_polarity, {_LABELS}
FROM (SELECT *, l_discount - l_tax AS rule_polarity FROM lineitem)""")
def rule_label(spark, sf_dir):
    lines = I.load(spark, sf_dir, "lineitem")
    polarity = (F.col("l_discount") - F.col("l_tax")).alias("rule_polarity")
    rows = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), polarity)
    return lexicon.rule_label(rows).select("review_id", "rule_polarity", "rule_score", "rule_label")


OPINION_RULE = f"{I.OPINIONS}, {I.units_sql('opinions')}, {I.unit_scores_sql(resources.DEFAULT_LEXICON)}, {I.RULE_SQL}"


@query(f"WITH {OPINION_RULE} SELECT review_id, {_ROUNDED_RULE}, {_LABELS.replace('rule_polarity', 'rule.rule_polarity')} FROM rule")
def rule_sentiment(spark, sf_dir):
    return rounded(lexicon.rule_sentiment(I.opinions(spark, sf_dir)))


@query(f"WITH {_PROSE_UNITS}, {I.RULE_SQL} SELECT review_id, {_ROUNDED_RULE}, {_LABELS.replace('rule_polarity', 'rule.rule_polarity')} FROM rule")
def prose_rule_sentiment(spark, sf_dir):
    return rounded(lexicon.rule_sentiment(I.prose(spark, sf_dir), I.PROSE_LEXICON))


_CUE_KINDS = """cues AS (
  SELECT DISTINCT kind, phrase FROM (
    SELECT 'piece' AS kind, lower(substr(text, 11, 9)) AS phrase FROM documents WHERE length(text) >= 20
    UNION ALL SELECT 'short piece', lower(substr(text, 13, 5)) FROM documents WHERE length(text) >= 20
    UNION ALL SELECT 'item', lower(substr(text, 1, 24)) FROM benchmark UNION ALL SELECT 'part', lower(p_name) FROM part UNION ALL SELECT 'empty', ''))"""


def _cue_table(spark, sf_dir):
    """Phrases of the given tables: pieces of documents, some inside others, beginnings of items, part names, the empty one."""
    long_enough = I.load(spark, sf_dir, "documents").where(F.length("text") >= 20)
    parts = [
        long_enough.select(F.lit("piece").alias("kind"), F.lower(F.substring("text", 11, 9)).alias("phrase")),
        long_enough.select(F.lit("short piece"), F.lower(F.substring("text", 13, 5))),
        I.load(spark, sf_dir, "benchmark").select(F.lit("item"), F.lower(F.substring("text", 1, 24))),
        I.load(spark, sf_dir, "part").select(F.lit("part"), F.lower("p_name")),
        spark.range(1).select(F.lit("empty"), F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"""WITH {_CUE_KINDS}, each AS (SELECT phrase, list(kind ORDER BY kind) AS kinds FROM cues GROUP BY phrase),
hits AS (SELECT doc_id AS review_id, phrase, unnest(kinds) AS kind FROM documents JOIN each ON contains(lower(text), phrase))
SELECT review_id, kind, count(*) AS n, min(phrase) AS first_phrase, max(phrase) AS last_phrase, sum(length(phrase))::BIGINT AS chars
FROM hits GROUP BY review_id, kind""")
def phrase_hits(spark, sf_dir):
    """Every phrase of a table that each document holds, summed up by kind."""
    hits = phrases.phrase_hits(I.prose(spark, sf_dir), _cue_table(spark, sf_dir))
    first, last = F.min("phrase").alias("first_phrase"), F.max("phrase").alias("last_phrase")
    return hits.groupBy("review_id", "kind").agg(F.count("*").alias("n"), first, last, F.sum(F.length("phrase")).alias("chars"))


_CUE_ROWS = [(kind, p) for kind, ps in (("hidden_negative", resources.HIDDEN_NEGATIVE), ("sarcasm", resources.SARCASM_CUES), ("questioned", resources.QUESTIONED_POSITIVES),
                                        ("positive", resources.CONTRADICTION_POSITIVES), ("contrast", resources.CONTRADICTION_CONTRASTS)) for p in ps]


def _any_cue(kind: str, end: str = "") -> str:
    tests = " OR ".join(f"contains(lower(text), {I.quoted(p + end)})" for k, p in _CUE_ROWS if k == kind)
    return f"coalesce({tests}, false)"


@query(f"""WITH {I.OPINIONS}
SELECT review_id, CASE WHEN {_any_cue('hidden_negative')} THEN -0.6 ELSE 0.0 END::DOUBLE AS hidden_sentiment,
       least(1.0, CASE WHEN {_any_cue('sarcasm')} THEN 0.6 ELSE 0.0 END + CASE WHEN length(text) - length(replace(text, '!', '')) > 2 THEN 0.3 ELSE 0.0 END
             + CASE WHEN {_any_cue('questioned', '?')} THEN 0.4 ELSE 0.0 END)::DOUBLE AS sarcasm_context_score,
       ({_any_cue('positive')} AND {_any_cue('contrast')})::INT::DOUBLE AS contradiction_score FROM opinions""")
def contextual_features_table(spark, sf_dir):
    """The contextual features of every review from a table of cue phrases."""
    cues = spark.createDataFrame(_CUE_ROWS, "kind string, phrase string")
    return phrases.contextual_features(I.opinions(spark, sf_dir), cues)


def _bin(k: str, n: str, p: str) -> str:
    return f"({k} * ln(greatest({p}, 1e-12)) + ({n} - {k}) * ln(greatest(1 - {p}, 1e-12)))"


_SHORT = f"""(-2 * ({_bin('d', 'n', '(dots / big)')} - {_bin('d', 'n', '0.99')}) * exp(-length(replace(word, '.', '')))
         * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', '')), -p))"""
_BOUNDARY_COUNTS = f"""{I.PROSE}, raw AS (SELECT regexp_extract_all(text, {I.quoted('[^' + I.text_functions.SPACES + ']+')}) AS l FROM prose),
each AS (SELECT l[i] AS t, CASE WHEN i > 1 THEN l[i - 1] END AS before FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM raw)),
cores AS (SELECT t, before, regexp_replace(regexp_replace(lower(t), '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}.]+$', '') AS core, regexp_replace(regexp_replace(lower(before), '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}.]+$', '') AS last FROM each),
words AS (
  SELECT regexp_replace(core, '\\.+$', '') AS word, regexp_matches(core, '[^.]\\.$') AS dotted, regexp_matches(last, '[^.]\\.$') AS last_dotted,
         regexp_replace(last, '\\.$', '') AS last_word,
         coalesce(regexp_matches(before, '[.!?]$') AND regexp_matches(t, '^[^\\p{{L}}\\p{{N}}]*\\p{{Lu}}'), false) AS capital FROM cores),
dots AS (SELECT word, count(*) FILTER (dotted) AS d, count(*) FILTER (NOT dotted) AS p, count(*) AS n FROM words WHERE regexp_matches(word, '\\p{{L}}') GROUP BY word),
short AS (SELECT word FROM dots, (SELECT sum(n)::DOUBLE AS big, sum(d)::DOUBLE AS dots FROM dots) WHERE {_SHORT} >= 0.3),
facts AS (
  SELECT word, dotted, capital AND NOT (last_dotted AND (regexp_matches(last_word, '^(\\p{{L}}|\\p{{N}}+)$') OR last_word IN (SELECT word FROM short))) AS starts FROM words),
counts AS (
  SELECT word, count(*) FILTER (dotted) AS d, count(*) FILTER (NOT dotted) AS p, count(*) FILTER (starts) AS s, count(*) AS n
  FROM facts WHERE regexp_matches(word, '\\p{{L}}') GROUP BY word),
totals AS (SELECT sum(n)::DOUBLE AS big, sum(d)::DOUBLE AS dots, sum(s)::DOUBLE AS sts FROM counts)"""


@query(f"""WITH {_BOUNDARY_COUNTS}, scored AS (
  SELECT word, d, p, s, {_SHORT} AS abbreviation,
         CASE WHEN s / sts > n / big THEN -2 * ({_bin('s', 'sts', '(n / big)')} + {_bin('(n - s)', '(big - sts)', '(n / big)')}
              - {_bin('s', 'sts', '(s / sts)')} - {_bin('(n - s)', '(big - sts)', '((n - s) / (big - sts))')}) ELSE 0 END AS starter
  FROM counts, totals)
SELECT word, d AS n_dotted, p AS n_plain, s AS n_start, round(abbreviation, 6) + 0.0 AS abbreviation, round(starter, 6) + 0.0 AS starter,
       (abbreviation >= 0.3)::INT AS is_abbreviation, (starter >= 30 AND abbreviation < 0.3)::INT AS is_starter FROM scored""")
def learned_boundaries(spark, sf_dir):
    """Counts and scores of every word of the documents as an abbreviation and as the beginning of a sentence."""
    learned = boundaries.learn_boundaries(I.prose(spark, sf_dir))
    return rounded(learned.withColumns({c: F.col(c).cast("int") for c in ("is_abbreviation", "is_starter")}), 6)
