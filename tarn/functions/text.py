"""Analysers, lemmas and text helpers as Column functions.

Three analysers: ``crawl`` (letters and digits, own stop words), ``index`` (also ``_`` and ``*``, lemmas) and ``score`` (letters
and digits of the lower-cased text, no stop words). They are ASCII only: other letters separate words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CRAWL_STOPWORDS, INDEX_STOPWORDS, IRREGULAR, SECTION_BREAK

#: A word of the index analyser, or the end of a sentence that has one: it takes a position of its own.
_WORD_OR_END = r"[A-Za-z0-9_*]+|(?<=[A-Za-z0-9_*])[^A-Za-z0-9_*.!?]*[.!?]"


def is_stopword(word: Column) -> Column:
    return F.lower(word).isin(INDEX_STOPWORDS)


def _undouble(stem: Column) -> Column:
    twice = (F.length(stem) > 2) & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1))
    return F.when(twice, F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)


def lemma(word: Column) -> Column:
    """Irregular forms, then the first suffix rule that fits; a pattern with ``*`` stays."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    size = F.length(word)
    known = F.element_at(F.array(*map(F.lit, IRREGULAR.values())), F.nullif(F.array_position(F.array(*map(F.lit, IRREGULAR)), word), F.lit(0)).cast("int"))
    return (
        F.when(word.contains("*"), word)
        .when(word.isin(list(IRREGULAR)), known)
        .when((size > 5) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((size > 5) & word.endswith("ing"), _undouble(cut(3)))
        .when((size > 4) & word.endswith("ed"), _undouble(cut(2)))
        .when((size > 4) & word.endswith("es"), cut(2))
        .when((size > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def lemma_once(word: Column) -> Column:
    """``lemma`` of an expression that is itself large: binds it, where the plain form has a copy of it in every rule."""
    return F.element_at(F.transform(F.array(word), lemma), 1)


def lemma_of(word: str) -> str:
    """``lemma`` for a query's words, on the driver."""
    if "*" in word or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    for ending, least, put, undouble in (("ies", 6, "y", False), ("ing", 6, "", True), ("ed", 5, "", True), ("es", 5, "", False)):
        if len(word) >= least and word.endswith(ending):
            stem = word[: -len(ending)] + put
            return stem[:-1] if undouble and len(stem) > 2 and stem[-1] == stem[-2] else stem
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def index_tokens(text: Column) -> Column:
    """All words of the index analyser, lower-cased, stop words included."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_*]+"), F.lit(0)), F.lower)


def index_items(text: Column) -> Column:
    """Words and sentence ends in order: a word's place in this array is its position."""
    return F.regexp_extract_all(text, F.lit(_WORD_OR_END), F.lit(0))


def process_text(text: Column) -> Column:
    """Lemmas of the words that are no stop words, in order."""
    return F.transform(F.filter(index_tokens(text), lambda w: ~is_stopword(w)), lemma)


def index_length(text: Column) -> Column:
    """Number of words that are no stop words."""
    return F.size(F.filter(index_tokens(text), lambda w: ~w.isin(INDEX_STOPWORDS)))


def words_of(text: str) -> list[str]:
    """``index_tokens`` on the driver."""
    return [w.lower() for w in re.findall(r"[A-Za-z0-9_*]+", text)]


def crawl_segments(text: Column) -> Column:
    """Words of each section of a page's text without stop words; sections without a word are left out."""
    stop = F.array(*map(F.lit, CRAWL_STOPWORDS))
    words = lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower), lambda w: ~F.array_contains(stop, w))
    return F.filter(F.transform(F.split(text, SECTION_BREAK), words), lambda ws: F.size(ws) > 0)


def crawl_tokens(text: Column) -> Column:
    return F.flatten(crawl_segments(text))


def score_terms(query: Column) -> Column:
    """Scoring terms of a raw query, in order and with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin("and", "or", "not"))


def score_terms_of(query: str) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", query.lower()) if w not in ("and", "or", "not")]


def snippet(text: Column, terms: list[str], width: int = 200) -> Column:
    """Text around the first term found, ``width`` long at most, with marks where it was cut."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    size, low = F.length(flat), F.lower(flat)
    places = [F.nullif(F.locate(t, low), F.lit(0)) - 1 for t in terms if t]
    hit = F.least(*places, F.lit(None)) if len(places) > 1 else (places[0] if places else F.lit(None).cast("int"))
    head = F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit("..."))
    end = F.least(size, F.greatest(F.lit(0), hit - width // 4) + width)
    start = F.greatest(F.lit(0), end - width)
    middle = F.btrim(F.substring(flat, start + 1, end - start))
    around = F.concat(F.when(start > 0, "...").otherwise(""), middle, F.when(end < size, "...").otherwise(""))
    return F.when(size <= width, flat).when(hit.isNull(), head).otherwise(around)


def relevant_snippet(text: Column, terms: list[str], width: int = 180) -> Column:
    """Text from 80 characters before the first term on, cut at a space where one is near, with an ellipsis on each side that was cut."""
    text = F.coalesce(text, F.lit(""))
    size, low = F.length(text), F.lower(text)
    places = [F.nullif(F.locate(t.lower(), low), F.lit(0)) - 1 for t in terms if t]
    hit = F.least(*places, F.lit(None)) if len(places) > 1 else (places[0] if places else F.lit(None).cast("int"))
    wanted = F.greatest(F.lit(0), F.coalesce(hit, F.lit(0)) - 80)
    space = F.locate(" ", F.substring(text, wanted + 1, F.lit(20)))  # 1 is the character at ``wanted``
    start = F.when((wanted > 0) & (space > 0), wanted + space).otherwise(wanted)
    full = F.least(size, start + width)
    tail = F.locate(" ", F.reverse(F.substring(text, full - 18, F.lit(20))))  # from the character at ``full`` back
    end = F.when((full < size) & (tail > 0), full - tail + 1).otherwise(full)
    cut = lambda c: F.when(c, "…").otherwise("")
    return clean_control(F.when(size <= width, text).otherwise(F.concat(cut(start > 0), F.substring(text, start + 1, end - start), cut(end < size))))


def wrapped(text: str, width: int = 80) -> str:
    """Lines of at most ``width`` characters, cut at the last space if it lies in a line's second half."""
    text, lines = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", text), []
    while text:
        end = width
        if len(text) > width and (space := text.rfind(" ", 0, width + 1)) > width // 2:
            end = space
        lines.append(text[:end])
        text = text[end:].lstrip(" ")
    return "\n".join(lines)


def now_iso() -> Column:
    """The time in UTC to the second, as ``2026-01-31T09:05:00Z``."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def highlight(text: Column, terms: list[str], start: str = "<mark>", end: str = "</mark>") -> Column:
    """Whole-word hits wrapped, whatever their case, longer terms first."""
    unique = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not unique:
        return text
    either = "|".join(re.escape(t) for t in unique)
    quoted = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, rf"(?iU)\b({either})\b", f"{quoted(start)}$1{quoted(end)}")


def clean_control(text: Column) -> Column:
    """Control characters but tab, line feed and carriage return become spaces."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def display_title(title: Column, url: Column) -> Column:
    """The title, else the host, else a stand-in."""
    host = F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)
    return F.coalesce(F.nullif(F.btrim(title), F.lit("")), F.nullif(host, F.lit("")), F.lit("(untitled)"))
