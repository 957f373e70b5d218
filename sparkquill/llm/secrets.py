"""Secret scans driven by a trigram inverted index (DataFrame operations only).

Each rule is a regex. Its parse tree yields a Boolean query over lower-case trigrams that every match satisfies: runs of
fixed characters must be there, alternatives are ORed, what may be left out or repeated breaks a run. The index is a table
of postings (trigram, document) of the trigrams that any query names. A rule's candidates come from its postings,
intersected by document; only candidates meet the regex. A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, saved, table

#: Most strings that one run of a regex may stand for.
STRINGS = 64


class Query(tuple):
    """("and", parts), ("or", parts) or ("has", trigram); ALL: no condition."""

    def trigrams(self) -> set[str]:
        return {self[1]} if self[0] == "has" else set().union(*(p.trigrams() for p in self[1]))


ALL = Query(("and", ()))


def _both(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(q for p in parts for q in (p[1] if p[0] == "and" else (p,))))
    return parts[0] if len(parts) == 1 else Query(("and", tuple(parts)))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if ALL in parts or not parts:
        return ALL
    plain = {p: frozenset(p.trigrams()) for p in parts if p[0] == "has" or p[0] == "and" and all(q[0] == "has" for q in p[1])}
    parts = [p for p in parts if not any(p in plain and x < plain[p] for x in plain.values())]  # asks for more than another
    return parts[0] if len(parts) == 1 else Query(("or", tuple(parts)))


def _strings(found: set[str]) -> Query:
    """One of these strings is there. Trigrams side by side are asked for, and the last if two characters are left: those
    between add little."""
    if any(len(x) < 3 for x in found):
        return ALL
    least = sorted(x for x in found if not any(y != x and y in x for y in found))
    return _any([_both([Query(("has", t)) for t in sorted({x[i : i + 3] for i in (*range(0, len(x) - 2, 3), *[len(x) - 3] * (len(x) % 3 == 2))})]) for x in least])


def _folded(codes) -> set[str] | None:
    out = {chr(c).lower() for c in codes}
    return out if all(x.isascii() for x in out) else None


def _class(items) -> set[str] | None:
    codes: set[int] = set()
    for op, value in items:
        if op is ops.LITERAL:
            codes.add(value)
        elif op is ops.RANGE and value[1] - value[0] < 8:
            codes |= set(range(value[0], value[1] + 1))
        else:
            return None
    return _folded(codes)


_REPEATS = (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT)


def _sequence(items) -> tuple[set[str] | None, Query]:
    """The strings that the items stand for, or None if they are many, and then what each match has. None among the items: anything."""
    run, parts, exact = {""}, [], True
    whole = []
    for item in items:  # a part that comes at least once is there, then perhaps anything
        least, most, sub = item[1] if item is not None and item[0] in _REPEATS else (0, 0, None)
        times = min(least, 4)
        whole += [(ops.SUBPATTERN, (None, 0, 0, sub))] * times + [None] * (most > times) if times else [item]
    for item in whole:
        strings, query = (None, ALL) if item is None else _node(item)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {x + y for x, y in product(run, strings)}
            continue
        exact = False
        parts.append(_strings(run))
        run = {""} if strings is None else strings
        parts.append(query)
    return (run, ALL) if exact else (None, _both([*parts, _strings(run)]))


def _node(item) -> tuple[set[str] | None, Query]:
    op, value = item
    if op is ops.LITERAL:
        found = _folded([value])
    elif op is ops.IN:
        found = _class(value)
    elif op is ops.SUBPATTERN:
        return _sequence(value[-1])
    elif op is ops.BRANCH:
        sides = [_sequence(x) for x in value[1]]
        if all(x is not None for x, _ in sides) and len(union := set().union(*(x for x, _ in sides))) <= STRINGS:
            return union, ALL
        return None, _any([q if x is None else _strings(x) for x, q in sides])
    elif op in _REPEATS:  # at least none
        strings, _ = _sequence(value[2])
        return (strings | {""}, ALL) if value[1] == 1 and strings is not None else (None, ALL)
    elif op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        found = {""}
    else:
        found = None
    return found, ALL


def trigram_query(regex: str) -> Query:
    """What lower-case trigrams the lower-case text around any match of the regex has. Never more than each match has."""
    strings, query = _sequence(_parser.parse(regex))
    return query if strings is None else _strings(strings)


@dataclass(frozen=True)
class Rule:
    """A regex without look-around or back references, common to Java and RE2."""

    kind: str
    regex: str
    group: int = 0
    min_chars: int = 1

    def query(self) -> Query:
        return trigram_query(self.regex)


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_NAMES = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), f"{_either('api')}_?{_either('key')}"])
BASE_RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 or more are the runs of one or more that pass the length test; no shorter run is materialised
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
RULES = BASE_RULES + MORE_RULES


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc): the documents (doc, text) that hold each of the trigrams in lower case; trigram: its place in the list."""
    low = F.lower("text").cast("binary")  # folds more than A-Z, so candidates can only grow; bytes are searched fastest
    has = [F.contains(F.col("low"), F.lit(t.encode())).alias(f"t{k}") for k, t in enumerate(trigrams)]
    found = docs.select("doc", low.alias("low")).select("doc", *has)
    held = F.array_compact(F.array(*[F.when(F.col(f"t{k}"), F.lit(k)) for k in range(len(trigrams))]))
    return found.select(F.explode(held).alias("trigram"), "doc")


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """(doc, kinds): the rules whose query each document meets. The postings that a query names are intersected by
    document, so a trigram that every document has does not meet in one task."""
    words = range(-(-len(trigrams) // 62))
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, F.expr("shiftleft(1L, cast(trigram % 62 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words]
    own = index.groupBy("doc").agg(*masks)
    place = {t: k for k, t in enumerate(trigrams)}

    def holds(q: Query) -> Column:
        if q[0] == "has":
            k = place[q[1]]
            return F.col(f"m{k // 62}").bitwiseAND(F.lit(1 << k % 62)) != 0
        return reduce(and_ if q[0] == "and" else or_, map(holds, q[1]))

    met = [F.when(holds(r.query()), F.lit(r.kind)) for r in rules if r.query() != ALL]
    return own.select("doc", F.array_compact(F.array(*met)).alias("kinds")).where(F.size("kinds") > 0)


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Matches that are added up together; an array that grows match by match is copied each time.
_CHUNK = 128


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once: a plain column would be inlined into every lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, whole: Column, rule: Rule, order: int) -> Column:
    """SPANS of one rule in code points; whole: its matches. The pieces of text between matches and the matches give positions."""
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    pairs = F.arrays_zip(lengths(F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(whole))).alias("gap"), lengths(whole).alias("n"), lengths(value).alias("v"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end")))
        return F.struct((start + x["n"]).alias("at"), F.when(x["v"] >= rule.min_chars, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def chunks(p):
        cuts = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int"))
        return F.transform(cuts, lambda c: F.aggregate(F.slice(p, c * _CHUNK + 1, F.lit(_CHUNK)), zero, step))

    def placed(parts):
        # where each chunk begins: sums of the chunks before
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        at = F.aggregate(parts, start, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        move = lambda b: lambda s: F.struct((s["start"] + b).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + b).alias("end"))
        return F.flatten(F.zip_with(parts, at, lambda c, b: F.transform(c["out"], move(b))))

    return F.when(F.size(whole) > 0, _let(_let(pairs, chunks), placed)).otherwise(F.array().cast(SPANS))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, rank, kind, end>>) for every row, sorted by start, then by the order of rules.

    Offsets are code points, end exclusive. Null and empty texts have no spans; a row without a doc_id is scanned in full
    by every rule. Rows that repeat a doc_id each get their own spans. Equal starts are listed in the order of rules.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    indexed = [r for r in rules if r.query() != ALL]
    if indexed:
        trigrams = sorted(set().union(*(r.query().trigrams() for r in indexed)))
        index = saved(spark, postings(docs.where("doc is not null"), trigrams), "secret-postings")
        met = saved(spark, candidates(index, rules, trigrams), "secret-candidates")
        docs = lookup(docs, met, ["doc"], met.count(), "left")
    matches = []
    for k, r in enumerate(rules):
        found = F.regexp_extract_all(F.col("text"), F.lit(r.regex), F.lit(0))
        if r in indexed:
            found = F.when(F.col("doc").isNull() | F.array_contains("kinds", r.kind), found).otherwise(F.array().cast("array<string>"))
        matches.append(found.alias(f"m{k}"))
    docs = docs.select("doc", "text", *matches)
    parts = [_spans(F.col("text"), F.col(f"m{k}"), r, k) for k, r in enumerate(rules)]
    return docs.select(F.col("doc").alias("doc_id"), F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(rank: int):
    return lambda s: s["rank"] == rank


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        q = r.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, unnest(regexp_extract_all(t, '{q}', 0)) AS w, unnest(regexp_extract_all(t, '{q}', {r.group})) AS v, "
            f"unnest(list_transform(string_split_regex(t, '{q}')[1:len(regexp_extract_all(t, '{q}', 0))], lambda x: length(x))) AS gap, "
            f"unnest(range(len(regexp_extract_all(t, '{q}', 0)))) AS i, {r.min_chars} AS least FROM d"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (" + " UNION ALL ".join(parts) + "), "
        "p AS (SELECT *, (sum(gap + length(w)) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS stop FROM m), "
        "s AS (SELECT doc_id, rank, kind, stop - length(w) AS start, stop FROM p WHERE length(v) >= least), "
        "g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c, "
        "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, "
        "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, "
        "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
    )


SQL6 = _sql()
