"""From a query to weighted dictionary terms. Only small, capped look-ups in the dictionary run here."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import SearchConf
from ..errors import QuerySyntaxError, QuillError
from ..functions import fuzzy as fz
from ..functions.analysis import analyze, normalise_word
from . import grammar as g
from .query import BM25Query


@dataclass(frozen=True)
class Term:
    """A dictionary term of a field with its multiplicity in the query and its fuzzy weight."""

    field: int
    term: str
    count: int = 1
    weight: float = 1.0


@dataclass(frozen=True)
class PhraseFilter:
    """A document passes if any of the fields holds the terms next to each other. prefix: the last one is a beginning.
    A term of None (a stop word) never matches."""

    fields: tuple[int, ...]
    terms: tuple[str | None, ...]
    prefix: bool = False


@dataclass
class Resolved:
    terms: list[Term] = field(default_factory=list)
    phrases: list[PhraseFilter] = field(default_factory=list)


def _after(prefix: str) -> str | None:
    """The least string above all that begin with prefix, in byte order."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i]) + 1
        if 0xD800 <= c <= 0xDFFF:
            c = 0xE000
        if c <= 0x10FFFF:
            return prefix[:i] + chr(c)
    return None


def begins(column: str, prefix: str):
    """A range that reaches the scan of a sorted dictionary."""
    end = _after(prefix)
    ok = F.col(column) >= prefix
    return ok & (F.col(column) < end) if end else ok


def expand_prefix(terms: DataFrame, field_no: int, prefix: str, cap: int) -> list[str]:
    rows = terms.where((F.col("field_idx") == field_no) & begins("term", prefix)).select("term").distinct().orderBy("term").limit(cap).collect()
    return [r[0] for r in rows]


def expand_fuzzy(terms: DataFrame, field_no: int, word: str, distance: int, cap: int, prefix: bool = False) -> list[tuple[str, int]]:
    """(term, distance), best first. A built-in edit distance narrows the candidates; those that are left go through Python once
    each, however often they occur."""
    size, n = F.length("term"), len(word)
    if not prefix:
        ok = (F.abs(size - n) <= distance) & fz.near(F.col("term"), word, distance)
    else:
        near = [(size >= m) & fz.near(F.substring("term", 1, m), word, distance) for m in range(max(0, n - distance), n + distance + 1)]
        ok = reduce(or_, near)
    own = terms.where((F.col("field_idx") == field_no) & ok).select("term").distinct()
    # not deterministic: else the filter moves below distinct, to every occurrence
    own = own.withColumn("d", fz.distance_udf(word, distance, prefix).asNondeterministic()(F.col("term"))).where("d is not null")
    return [(r[0], r[1]) for r in own.orderBy("d", "term").limit(cap).collect()]


def _ascii_lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def resolve(query: BM25Query, fields: list[str], config: str, terms: DataFrame, conf: SearchConf) -> Resolved:
    """Plain queries on one field are a bag of words; several fields, grammar and fuzzy queries go through the grammar."""
    out = Resolved()
    everywhere = tuple(range(len(fields)))
    if not query.grammar and query.fuzzy is None and len(fields) == 1:
        out.terms = [Term(0, t, n) for t, n in Counter(t for t, _ in analyze(config, query.text)).items()]
        return out
    distance = query.fuzzy or 0
    if distance > conf.max_fuzzy_distance:
        raise QuillError(f"the fuzzy distance must be at most {conf.max_fuzzy_distance}")
    for c in g.parse(query.text):
        if c.field is not None:
            if len(fields) == 1:
                raise QuerySyntaxError("a field scope needs an index of several fields")
            if c.field not in fields:
                raise QuerySyntaxError(f"field {c.field!r} does not exist")
        scope = everywhere if c.field is None else (fields.index(c.field),)
        if c.kind in (g.PHRASE, g.PHRASE_PREFIX) and distance:
            raise QuerySyntaxError("phrases cannot be fuzzy")
        if c.kind == g.TERM:
            found = sorted({t for t, _ in analyze(config, c.words[0])}, key=lambda t: t.encode())[:1]
            for t in found:
                for f in scope:
                    if distance and len(t) >= conf.min_fuzzy_term_len:
                        out.terms += [Term(f, x, 1, fz.weight(d)) for x, d in expand_fuzzy(terms, f, t, distance, conf.max_fuzzy_expansions)]
                    else:
                        out.terms.append(Term(f, t))
        elif c.kind == g.PREFIX:
            p = _ascii_lower(c.words[0])
            for f in scope:
                if distance and len(p) >= conf.min_fuzzy_term_len:
                    out.terms += [Term(f, x, 1, fz.weight(d)) for x, d in expand_fuzzy(terms, f, p, distance, conf.max_prefix_expansions, prefix=True)]
                else:
                    out.terms += [Term(f, x) for x in expand_prefix(terms, f, p, conf.max_prefix_expansions)]
        else:
            prefix = c.kind == g.PHRASE_PREFIX
            words = [w for part in c.words for w in ([part] if prefix and part is c.words[-1] else [x for x, _ in analyze("simple", part)])]
            last = _ascii_lower(words[-1]) if prefix else None
            stems = [normalise_word(config, w) for w in (words[:-1] if prefix else words)]
            for f in scope:
                out.terms += [Term(f, t) for t in stems if t is not None]
                if prefix:
                    out.terms += [Term(f, x) for x in expand_prefix(terms, f, last, conf.max_prefix_expansions)]
            out.phrases.append(PhraseFilter(scope, (*stems, last) if prefix else tuple(stems), prefix))
    return out
