"""Column functions that split and clean text inside the row, so no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookup import is_listed

# Every character that counts as white space, listed because trim() alone
# only removes the plain blank.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WS = f"[{SPACES}]"

# A word is a run of letters or digits with inner apostrophes; any other visible
# character is a token of its own.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"
TOKEN = WORD + "|" + rf"[^{SPACES}\p{{L}}\p{{M}}\p{{N}}]"

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def strip_trailing_punct(c: Column | str) -> Column:
    return strip(F.rtrim(strip(c), F.lit(".,!?;:")))


def has_two_words(stripped: Column | str) -> Column:
    """For stripped text: any white space left lies between two words. The plain blank is tried first."""
    c = _col(stripped)
    return c.contains(" ") | c.rlike(_WS)


def _not_empty(x: Column) -> Column:
    return x != ""


def _or_no_strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


@dataclass(frozen=True)
class SentenceModel:
    """Lower-case words without their dot: abbreviations, and words that begin sentences."""

    abbreviations: Sequence[str] = ()
    starters: Sequence[str] = ()


def word_core(token: Column) -> Column:
    """Lower-cased token from its first letter or digit to its last one or a dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}.]+$", "")


def is_capital(token: Column) -> Column:
    return token.rlike(r"^[^\p{L}\p{N}]*\p{Lu}")


# Stands between sentences while they are split: a code point that no text holds by the Unicode standard.
_CUT = "\uffff"


def _ends(piece: Column, after: Column, model: SentenceModel) -> Column:
    """Whether a sentence ends between two pieces that . ! or ? and white space part."""
    core = word_core(F.regexp_extract(strip(piece), rf"[^{SPACES}]+$", 0))
    word = F.regexp_replace(core, r"\.$", "")
    follower = F.regexp_extract(after, rf"^[^{SPACES}]+", 0)
    begins = F.regexp_replace(word_core(follower), r"\.+$", "")
    new = is_capital(follower) & is_listed(begins, model.starters)
    short = is_listed(word, model.abbreviations) & ~new
    initial = word.rlike(r"^\p{L}$") & is_capital(follower) & ~new
    ordinal = word.rlike(r"^\p{N}+$") & follower.rlike(r"^\p{Ll}")
    return ~(core.rlike(r"[^.]\.$") & (short | initial | ordinal))


def sentences(text: Column | str, model: SentenceModel | None = None) -> Column:
    """Split after . ! or ? followed by white space; NULL or blank text has none.

    With a model, a dot ends no sentence after an abbreviation (unless a word that begins sentences follows with a
    capital), between an initial and a capital, or between a number and a lower-case word. Dots inside words and
    numbers never do. White space inside a sentence stays as it is.
    """
    if model is None:
        parts = F.split(strip(text), rf"(?<=[.!?]){_WS}+")
        return _or_no_strings(F.filter(parts, _not_empty))
    pieces = F.regexp_extract_all(strip(text), F.lit(rf"(?s).*?[.!?]{_WS}+|.+$"), F.lit(0))

    def marked(ps: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            after = F.get(ps, i + 1)
            return F.when(after.isNotNull() & _ends(p, after, model), F.concat(p, F.lit(_CUT))).otherwise(p)

        return F.transform(ps, piece)

    whole = F.array_join(bind(pieces, marked), "")
    return _or_no_strings(F.filter(F.transform(F.split(whole, _CUT), strip), _not_empty))


def words(c: Column | str) -> Column:
    """Lower-cased words without punctuation."""
    return _or_no_strings(F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0)))


def tokens(c: Column | str) -> Column:
    """Words and single punctuation marks, in order, in their own case."""
    return _or_no_strings(F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(0)))


def is_alpha(token: Column) -> Column:
    return token.rlike(r"^\p{L}+$")


def is_punct(token: Column) -> Column:
    return token.rlike(r"^\p{P}+$")


def scoring_units(text: Column | str, model: SentenceModel | None = None) -> Column:
    """Sentences of two words or more; the whole text when there is none."""
    kept = F.filter(sentences(text, model), has_two_words)
    whole = F.array(F.coalesce(_col(text), F.lit("")))
    return bind(kept, lambda u: F.when(F.size(u) > 0, u).otherwise(whole))


def joined(toks: Column, start: Column, n: Column) -> Column:
    """n tokens from `start` (0-based) with blanks between; costs n, not the length of `toks`."""
    return F.array_join(F.transform(F.sequence(start, start + n - 1), lambda j: F.get(toks, j)), " ")


def normalized(text: Column | str, model: SentenceModel | None = None) -> Column:
    """Sentences joined again by one blank."""
    return F.array_join(sentences(text, model), " ")


def _split_on_but(part: Column) -> Column:
    halves = F.filter(F.transform(F.split(part, ", but ", 2), strip), _not_empty)
    return F.when(part.contains(", but "), halves).otherwise(F.array(part))


def emotion_clauses(text: Column | str) -> Column:
    """Several sentences are the clauses; a single one is split on '. ' and the first ', but '."""
    whole = strip(text)
    parts = F.filter(F.transform(F.split(whole, r"\. "), strip), _not_empty)
    pieces = F.filter(F.flatten(F.transform(parts, _split_on_but)), has_two_words)
    fallback = F.filter(F.array(whole), _not_empty)
    single = bind(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(fallback))
    clauses = bind(sentences(text), lambda s: F.when(F.size(s) > 1, s).otherwise(single))
    return F.when(is_blank(text), _or_no_strings(F.lit(None))).otherwise(clauses)


def contrast_clauses(text: Column | str) -> Column:
    """Parts between the word 'but', with or without a comma before it."""
    return _or_no_strings(F.split(strip(text), rf"(?i),?{_WS}+but{_WS}+"))


def context_windows(toks: Column, aspect: Column, window: int) -> Column:
    """Text around every token that contains `aspect`, without punctuation.

    `toks` must be a plain column: it is read once per occurrence. Tokens are taken
    one by one because slice() copies the whole array for each occurrence.
    """
    needle = F.lower(aspect)
    marks = F.transform(toks, lambda t, i: F.when(F.lower(t).contains(needle), i).otherwise(F.lit(-1)))
    hits = F.filter(marks, lambda i: i >= 0)

    def around(hit: Column) -> Column:
        start = F.greatest(hit - window, F.lit(0))
        stop = F.least(hit + (window + 1), F.size(toks))
        near = F.transform(F.sequence(start, stop - 1), lambda j: F.get(toks, j))
        return F.array_join(F.filter(near, lambda t: ~is_punct(t)), " ")

    found = F.array_join(F.filter(F.transform(hits, around), _not_empty), " ")
    return F.when((aspect == "") | (F.size(toks) == 0), F.lit("")).otherwise(F.coalesce(found, F.lit("")))
