"""Boolean, phrase and wildcard queries: parsed on the driver, compiled to one plan.

    query := or;  or := and ("OR" and)*;  and := unary ("AND"? unary)*;  unary := "NOT" unary | "(" or ")" | word | "phrase"

Only upper-case AND, OR and NOT are operators. Stop words outside phrases are dropped while reading, so that one next to an
explicit operator makes the query malformed; a malformed query matches nothing and says why in ``error``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions.words import INDEX_STOPWORDS

from .index import Index

_LEX = re.compile(r'"([^"]*)"|(")|([()])|([A-Za-z0-9_*]+)')


@dataclass(frozen=True)
class Term:
    word: str  # lemma or pattern


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Parsed:
    root: object | None
    terms: tuple[str, ...] = ()  # lemmas and patterns that are scored, whatever their polarity, with repeats
    stopwords_only: bool = False
    error: str | None = None
    leaves: tuple = field(default=(), compare=False)


def _tokens(query: str) -> list[tuple[str, str]]:
    out = []
    for m in _LEX.finditer(query):
        phrase, open_quote, paren, word = m.groups()
        if phrase is not None:
            out.append(("phrase", phrase))
        elif open_quote:
            raise ValueError("a quote isn't closed")
        elif paren:
            out.append((paren, paren))
        elif word in ("AND", "OR", "NOT"):
            out.append((word, word))
        elif word.lower() not in INDEX_STOPWORDS:
            out.append(("word", T.lemma_of(word.lower())))
    return out


def _only_stopwords(query: str) -> bool:
    words = [w for w in T.words_of(query) if w not in ("and", "or", "not")]
    return bool(words) and all(w in INDEX_STOPWORDS for w in words)


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self):
        parts = [self.both()]
        while self.peek() == "OR":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.unary()]
        while self.peek() in ("AND", "NOT", "(", "word", "phrase"):
            if self.peek() == "AND":
                self.take()
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def unary(self):
        kind = self.peek()
        if kind == "NOT":
            self.take()
            part = self.unary()
            return part.part if isinstance(part, Not) else Not(part)
        if kind == "(":
            self.take()
            part = self.either()
            if self.peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            self.take()
            return part
        if kind == "word":
            return Term(self.take())
        if kind == "phrase":
            return Phrase(self.take())
        raise ValueError(f"a term is missing before {kind}")


def _leaves(node) -> list:
    if isinstance(node, (Term, Phrase)):
        return [node]
    parts = [node.part] if isinstance(node, Not) else node.parts
    return list(dict.fromkeys(x for p in parts for x in _leaves(p)))


def parse(query: str) -> Parsed:
    try:
        tokens = _tokens(query or "")
        if not tokens:
            return Parsed(None, stopwords_only=_only_stopwords(query or ""))
        reader = _Reader(tokens)
        root = reader.either()
        if reader.peek() != "end":
            raise ValueError(f"unexpected {reader.peek()}")
    except ValueError as e:
        return Parsed(None, error=str(e))
    scored = []
    for kind, value in tokens:
        if kind == "word":
            scored.append(value)
        elif kind == "phrase":
            scored += [T.lemma_of(w) for w in T.words_of(value) if w not in INDEX_STOPWORDS]
    return Parsed(root, tuple(scored), _only_stopwords(query), None, tuple(_leaves(root)))


def matches_pattern(word: Column, pattern: str, overlap: bool = False) -> Column:
    """Whether a word fits a pattern with ``*``; with ``overlap``, prefix and suffix of a single-star pattern may share letters."""
    parts = pattern.split("*")
    if len(parts) == 2:  # simple comparisons that the scan can push down
        fits = F.lit(True)
        if parts[0]:
            fits = fits & word.startswith(parts[0])
        if parts[1]:
            fits = fits & word.endswith(parts[1])
        return fits if overlap or not all(parts) else fits & (F.length(word) >= len(pattern) - 1)
    if len(parts) == 3 and not parts[0] and not parts[2]:
        return word.contains(parts[1])
    return word.rlike("^" + ".*".join(map(re.escape, parts)) + "$")


def expand(index: Index, pattern: str, overlap: bool = False) -> DataFrame:
    """(term): lemmas that a pattern stands for. Letter patterns are matched against surface forms and lemmas, others, and the
    lone star, against lemmas only."""
    by_letter = re.fullmatch(r"[a-z*]+", pattern) and pattern.strip("*")
    if not by_letter:
        return index.vocab.where(matches_pattern(F.col("term"), pattern, overlap)).select("term")
    plain = F.col("word").rlike("^[a-z]+$") & matches_pattern(F.col("word"), pattern, overlap)
    surface = index.surfaces.select(F.col("surface").alias("word"), F.col("lemma").alias("term")).where(plain)
    lemma = index.vocab.select(F.col("term").alias("word"), T.lemma_once(F.col("term")).alias("term")).where(plain)
    return surface.select("term").unionByName(lemma.select("term")).distinct().join(index.vocab.select("term"), "term", "left_semi")


def phrase_documents(index: Index, phrase: str, overlap: bool = False) -> DataFrame:
    """(doc_id): documents with the words at consecutive positions. One pass: each occurrence votes for the start it implies."""
    words = T.words_of(phrase)
    if not words:
        return index.documents.select("doc_id").where("false")
    slots = [(k, w if w in INDEX_STOPWORDS else T.lemma_of(w)) for k, w in enumerate(words)]
    places = {}
    for k, w in slots:
        if "*" not in w:
            places.setdefault(w, []).append(k)
    frames = []
    if places:
        by_term = reduce(lambda out, item: out.when(F.col("term") == item[0], F.array(*map(F.lit, item[1]))), list(places.items())[1:], F.when(F.col("term") == next(iter(places)), F.array(*map(F.lit, next(iter(places.values()))))))
        frames.append(index.occurrences.where(F.col("term").isin(list(places))).select("doc_id", "pos", F.explode(by_term).alias("slot")))
    for k, w in slots:
        if "*" in w:
            frames.append(index.occurrences.join(expand(index, w, overlap), "term").select("doc_id", "pos", F.lit(k).alias("slot")))
    votes = reduce(DataFrame.unionByName, frames).select("doc_id", (F.col("pos") - F.col("slot")).alias("start"), "slot")
    full = votes.groupBy("doc_id", "start").agg(F.count_distinct("slot").alias("n") if len(words) > 62 else F.bit_count(F.bit_or(F.expr("shiftleft(1L, slot)"))).alias("n"))
    return full.where(F.col("n") == len(words)).select("doc_id").distinct()


def _holds(node, flags: dict) -> Column:
    if isinstance(node, (Term, Phrase)):
        return flags[node]
    if isinstance(node, Not):
        return ~_holds(node.part, flags)
    both = isinstance(node, And)
    return reduce(lambda a, b: a & b if both else a | b, (_holds(p, flags) for p in node.parts))


def _true_of_nothing(node) -> bool:
    """Whether a document without any of the leaves matches."""
    if isinstance(node, (Term, Phrase)):
        return False
    if isinstance(node, Not):
        return not _true_of_nothing(node.part)
    return (all if isinstance(node, And) else any)(_true_of_nothing(p) for p in node.parts)


def matching_documents(index: Index, query: str | Parsed, overlap: bool = False) -> DataFrame:
    """(doc_id) of the documents that match: a flag per leaf and document, one aggregation whatever the query."""
    parsed = parse(query) if isinstance(query, str) else query
    if parsed.root is None:
        return index.documents.select("doc_id").where("false")
    leaves = parsed.leaves
    number = {leaf: k for k, leaf in enumerate(leaves)}
    plain = [x for x in leaves if isinstance(x, Term) and "*" not in x.word]
    found = []
    if plain:
        first, *more = plain
        which = reduce(lambda c, x: c.when(F.col("term") == x.word, number[x]), more, F.when(F.col("term") == first.word, number[first]))
        found.append(index.doc_terms.where(F.col("term").isin([x.word for x in plain])).select("doc_id", which.alias("leaf")))
    for leaf in leaves:
        if isinstance(leaf, Phrase):
            found.append(phrase_documents(index, leaf.text, overlap).select("doc_id", F.lit(number[leaf]).alias("leaf")))
        elif "*" in leaf.word:
            found.append(index.doc_terms.join(expand(index, leaf.word, overlap), "term", "left_semi").select("doc_id", F.lit(number[leaf]).alias("leaf")))
    hits = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(*(F.max(F.col("leaf") == k).alias(f"f{k}") for k in range(len(leaves))))
    if _true_of_nothing(parsed.root):
        hits = index.documents.select("doc_id").join(hits, "doc_id", "left")
    flags = {leaf: F.coalesce(F.col(f"f{k}"), F.lit(False)) for leaf, k in number.items()}
    return hits.where(_holds(parsed.root, flags)).select("doc_id")


def matching_documents_by_joins(index: Index, query: str | Parsed) -> DataFrame:
    """The same by semi, anti joins and unions; the flag form is tested against it."""
    parsed = parse(query) if isinstance(query, str) else query
    everything = index.documents.select("doc_id")

    def of(node) -> DataFrame:
        if isinstance(node, Term):
            terms = expand(index, node.word) if "*" in node.word else None
            hits = index.doc_terms.where(F.col("term") == node.word) if terms is None else index.doc_terms.join(terms, "term", "left_semi")
            return hits.select("doc_id").distinct()
        if isinstance(node, Phrase):
            return phrase_documents(index, node.text)
        if isinstance(node, Not):
            return everything.join(of(node.part), "doc_id", "left_anti")
        if isinstance(node, Or):
            return reduce(DataFrame.unionByName, map(of, node.parts)).distinct()
        held = [p for p in node.parts if not isinstance(p, Not)]
        out = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), map(of, held)) if held else everything
        return reduce(lambda a, p: a.join(of(p.part), "doc_id", "left_anti"), (p for p in node.parts if isinstance(p, Not)), out)

    return everything.where("false") if parsed.root is None else of(parsed.root)


def query_terms(index: Index, query: str | Parsed, overlap: bool = False) -> DataFrame:
    """(term, df, qtf) of a query's scored terms: literal ones as often as they occur, those behind a pattern once."""
    parsed = parse(query) if isinstance(query, str) else query
    counts: dict[str, int] = {}
    for t in parsed.terms:
        if "*" not in t:
            counts[t] = counts.get(t, 0) + 1
    spark = index.vocab.sparkSession
    weights = reduce(lambda c, item: c.when(F.col("term") == item[0], item[1]), counts.items(), F.when(F.lit(False), 0))
    found = index.vocab.where(F.col("term").isin(list(counts))).select("term", "df", weights.cast("int").alias("qtf")) if counts else spark.createDataFrame([], "term string, df long, qtf int")
    for pattern in dict.fromkeys(t for t in parsed.terms if "*" in t):
        found = found.unionByName(index.vocab.join(expand(index, pattern, overlap), "term", "left_semi").select("term", "df", F.lit(1).alias("qtf")))
    return found.groupBy("term").agg(F.max("df").alias("df"), F.max("qtf").alias("qtf"))


def candidates(index: Index, query: str | Parsed) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, tf) of all matching documents, terms null where none is scored; and (term, df)."""
    terms = query_terms(index, query).select("term", "df")
    tf = index.doc_terms.join(terms.select("term"), "term", "left_semi")
    return matching_documents(index, query).join(tf, "doc_id", "left").select("doc_id", "term", "tf"), terms
