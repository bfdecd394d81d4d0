"""Places of a pattern's matches in whole texts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of a text that are gone through at once: keeps appended arrays short, so that time grows with the number of matches and not its square.
CHUNK = 128
#: Code points of context kept before and after a match, no further than the match next to it.
BEFORE, AFTER = 80, 40


def spans(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start,end,value,before,after>> of the matches: code points, end exclusive. ``hint`` must hold for a text with a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # transform() over an array of one binds a value that would else be computed at every use.
    pairs = F.element_at(F.transform(F.array(F.split(text, pattern, -1)), lambda g: F.arrays_zip(g.alias("gap"), matches.alias("value"), F.slice(g, 2, F.size(g)).alias("next"))), 1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)")

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        before = F.when(F.length(pair["gap"]) > BEFORE, F.substring(pair["gap"], -BEFORE, BEFORE)).otherwise(pair["gap"])
        found = F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"), pair["value"].alias("value"), before.alias("before"), F.substring(F.coalesce(pair["next"], F.lit("")), 1, AFTER).alias("after")
        )
        return F.struct(
            F.coalesce(end, acc["at"]).cast("int").alias("at"), F.when(pair["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(found))).alias("out")
        )

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda i: F.slice(p, i * CHUNK + 1, CHUNK))
    chunks = F.element_at(F.transform(F.array(pairs), cut), 1)
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    done = F.aggregate(chunks, F.array(first), lambda acc, c: F.concat(acc, F.array(F.aggregate(c, F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out")), add))))
    return F.when(F.regexp_like(text, F.lit(hint)), F.flatten(F.transform(done, lambda x: x["out"]))).otherwise(none)


_PUNCTUATION = ".,;:!?()[]{}\"'=<>|*#$%&"


def _flat(text: Column) -> Column:
    return F.translate(text, "\n\t\r\f\u000b", "     ")


def _context(flat: Column, rest: Column, punctuation: Column, side: int) -> Column:
    """The word next to a match; one that is punctuation only is kept beside the nearest real word. Null if there is nothing."""
    word = lambda c: F.btrim(F.lower(F.substring_index(c, " ", side)), F.lit(_PUNCTUATION))
    near = F.nullif(word(rest), F.lit(""))
    return F.when(word(flat) != "", word(flat)).when(flat != "", F.concat_ws(" ", near, F.replace(punctuation, F.lit(" "), F.lit(""))))


#: Words on a side that contexts are made of: one, the nearest two, the nearest three.
CONTEXT_WORDS = 3


def _contexts(nearest: Column, flat: Column, side: int) -> Column:
    """Contexts of one word and of several, nearest last on the left and first on the right, without punctuation around words."""
    bare = F.transform(F.split(F.btrim(F.lower(flat)), " +"), lambda w: F.btrim(w, F.lit(_PUNCTUATION)))
    words = F.filter(bare, lambda w: w != "")
    several = [F.when(F.size(words) >= k, F.array_join(F.slice(words, -k, k) if side < 0 else F.slice(words, 1, k), " ")) for k in range(2, CONTEXT_WORDS + 1)]
    return F.array_compact(F.array(nearest, *several))


def left_contexts(before: Column) -> Column:
    """array<string>: the word that ends the context before a match, lower-cased, without punctuation around it, or as in ``email =``;
    the last two and three words."""
    flat = F.rtrim(_flat(before))
    rest = F.rtrim(flat, F.lit(_PUNCTUATION + " "))
    return _contexts(_context(flat, rest, F.substring(flat, F.length(rest) + 1, F.length(flat)), -1), flat, -1)


def right_contexts(after: Column) -> Column:
    """The same of the context after a match; marks that end a sentence or were trimmed from a token don't count."""
    flat = F.ltrim(_flat(F.ltrim(after, F.lit("._%+/:#-,;!?"))))
    rest = F.ltrim(flat, F.lit(_PUNCTUATION + " "))
    return _contexts(_context(flat, rest, F.substring(flat, F.lit(1), F.length(flat) - F.length(rest)), 1), flat, 1)
