"""Registered queries over the test tables and their SQL equivalents.

Scores are rounded to four places after ordering; ties are broken by the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import analysis
from .operators import admin
from .operators.highlight import bm25_snippet
from .operators.index import Index, IndexSpec, build_index
from .operators.search import batch_scores, facets, more_like_this, score_all, score_text, scores, search, search_batch
from .plans.query import BM25Query, bm25_phrase, bm25_phrase_prefix, bm25_prefix
from .sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SPEC = IndexSpec("documents_idx", ("text",), "simple", id_col="doc_id")
WORDS = "anstin bleha eresnd the"
K = 10


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs_index(spark, sf: str, spec: IndexSpec = SPEC) -> Index:
    return build_index(table(spark, sf, "documents"), spec)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 4))


# ---- SQL pieces

ONE = "SELECT doc_id, 0 AS f, text FROM documents"
TWO = "SELECT doc_id, 0 AS f, source AS text FROM documents UNION ALL SELECT doc_id, 1, text FROM documents"


def corpus(src: str = ONE) -> str:
    """tok, tf, dl, n, avgs and df of the texts of src(doc_id, f, text)."""
    return rf"""src AS ({src}),
tok AS (SELECT doc_id, f, unnest(ts) AS term, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT doc_id, f, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ts FROM src)),
tf AS (SELECT f, term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, f, dl, CASE WHEN dl < 40 THEN dl ELSE 24 + ((dl - 24) // (1 << s)) * (1 << s) END AS dlq FROM (SELECT *, CASE WHEN dl < 40 THEN 0 ELSE floor(log2(dl - 24))::INT - 3 END AS s FROM (SELECT doc_id, f, count(*) AS dl FROM tok GROUP BY ALL))),
n AS (SELECT count(DISTINCT doc_id) AS n FROM tok),
avgs AS (SELECT f, count(*) / (SELECT n FROM n) AS av FROM tok GROUP BY f),
df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY ALL)"""


def bag(text: str, fields: tuple[int, ...] = (0,), weights: tuple[float, ...] = (1.0,)) -> str:
    rows = [f"({f}, '{t}', {text.split().count(t) * w})" for t in dict.fromkeys(text.split()) for f, w in zip(fields, weights, strict=True)]
    return "q(f, term, w) AS (VALUES " + ", ".join(rows) + ")"


def scored(k1: float = 1.2, b: float = 0.75) -> str:
    return f"""sc AS (SELECT doc_id, round(-sum(w * ln((n + 1) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dlq / av))), 10) AS score
FROM q JOIN df USING (f, term) JOIN tf USING (f, term) JOIN dl USING (doc_id, f) JOIN avgs USING (f) CROSS JOIN n GROUP BY doc_id)"""


def best(k: int = K, columns: str = "doc_id, round(score, 4) AS score", source: str = "sc") -> str:
    return f"SELECT {columns} FROM (SELECT * FROM {source} ORDER BY score, doc_id LIMIT {k})"


def standard(text: str, tail: str, src: str = ONE, more: str = "", k1: float = 1.2, b: float = 0.75) -> str:
    return f"WITH {corpus(src)}, {bag(text)}, {scored(k1, b)}{more} {tail}"


# ---- top-k and scoring


@query("bm25_top10", standard("anstin the", best()))
def bm25_top10(spark, sf):
    return rounded(search(docs_index(spark, sf), "anstin the", K))


@query("bm25_multi_term", standard(WORDS, best(20)))
def bm25_multi_term(spark, sf):
    return rounded(search(docs_index(spark, sf), WORDS, 20))


@query("bm25_query_freq", standard("anstin anstin the", best(20)))
def bm25_query_freq(spark, sf):
    return rounded(search(docs_index(spark, sf), "anstin anstin the", 20))


@query("bm25_k1_b_custom", standard(WORDS, best(20), k1=2.0, b=0.3))
def bm25_k1_b_custom(spark, sf):
    return rounded(search(docs_index(spark, sf, IndexSpec("x", ("text",), "simple", id_col="doc_id", k1=2.0, b=0.3)), WORDS, 20))


@query("bm25_offset", standard(WORDS, "SELECT doc_id, round(score, 4) AS score FROM (SELECT * FROM sc ORDER BY score, doc_id LIMIT 10 OFFSET 5)"))
def bm25_offset(spark, sf):
    return rounded(search(docs_index(spark, sf), WORDS, K, offset=5))


@query("bm25_all_matches", standard(WORDS, "SELECT doc_id, round(score, 4) AS score FROM sc"))
def bm25_all_matches(spark, sf):
    return rounded(scores(docs_index(spark, sf), WORDS))


_ALL = "SELECT d.doc_id, round(coalesce(sc.score, 0), 4) AS score FROM documents d LEFT JOIN sc USING (doc_id)"


@query("bm25_score_all", standard(WORDS, _ALL))
def bm25_score_all(spark, sf):
    return rounded(score_all(docs_index(spark, sf), WORDS))


@query("bm25_score_text", standard(WORDS, _ALL))
def bm25_score_text(spark, sf):
    return rounded(score_text(table(spark, sf, "documents"), SPEC, WORDS))


@query("bm25_threshold", standard(WORDS, "SELECT doc_id, round(score, 4) AS score FROM sc WHERE score < -1.23456"))
def bm25_threshold(spark, sf):
    return rounded(scores(docs_index(spark, sf), WORDS).where("score < -1.23456"))


@query("bm25_prefilter_lang", standard("anstin the", best(source="(SELECT sc.* FROM sc JOIN documents USING (doc_id) WHERE lang <> 'en')")))
def bm25_prefilter_lang(spark, sf):
    docs = table(spark, sf, "documents")
    return rounded(search(build_index(docs, SPEC), "anstin the", K, among=docs.where("lang <> 'en'").select("doc_id")))


@query("bm25_postfilter", standard(WORDS, best(source="(SELECT sc.* FROM sc JOIN documents USING (doc_id) WHERE n_chars > 2000)")))
def bm25_postfilter(spark, sf):
    docs = table(spark, sf, "documents")
    found = scores(build_index(docs, SPEC), WORDS).join(docs.where("n_chars > 2000").select("doc_id"), "doc_id", "left_semi")
    return rounded(found.orderBy("score", "doc_id").limit(K))


# ---- batches


def _batch_sql(queries: str, k: int, where: str = "") -> str:
    return rf"""WITH {corpus()}, qs AS ({queries}),
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM qs), q AS (SELECT query_id, 0 AS f, term, count(*) AS w FROM qt GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(-sum(w * ln((n + 1) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dlq / av))), 10) AS score
FROM q JOIN df USING (f, term) JOIN tf USING (f, term) JOIN dl USING (doc_id, f) JOIN avgs USING (f) CROSS JOIN n {where} GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM sc)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= {k}"""


@query("bm25_batch_topk", _batch_sql("SELECT item_id AS query_id, text FROM benchmark", 5))
def bm25_batch_topk(spark, sf):
    return rounded(search_batch(docs_index(spark, sf), table(spark, sf, "benchmark"), 5, id_col="item_id"))


@query("bm25_more_like_this", _batch_sql("SELECT doc_id AS query_id, text FROM documents WHERE doc_id IN (1, 50, 51)", 5, "WHERE query_id <> doc_id"))
def bm25_more_like_this(spark, sf):
    return rounded(more_like_this(docs_index(spark, sf), [1, 50, 51], 5))


@query(
    "bm25_batch_agg",
    _batch_sql("SELECT item_id AS query_id, text FROM benchmark", 1).split("r AS (")[0].rstrip().rstrip(",") + " SELECT query_id, count(*)::BIGINT AS n, round(avg(score), 4) AS avg_score, round(min(score), 4) AS best FROM sc GROUP BY query_id",
)
def bm25_batch_agg(spark, sf):
    found = batch_scores(docs_index(spark, sf), table(spark, sf, "benchmark"), id_col="item_id")
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.min("score"), 4).alias("best"))


_GRAM = 6


@query(
    "bm25_mrr10",
    _batch_sql("SELECT item_id AS query_id, text FROM benchmark", 10).rsplit("SELECT query_id, rank", 1)[0]
    + f""", top AS (SELECT query_id, rank, doc_id FROM r WHERE rank <= 10),
g AS (SELECT doc_id, {" || ' ' || ".join(f"lead(term, {i}) OVER o" if i else "term" for i in range(_GRAM))} AS gram FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
it AS (SELECT query_id, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')[1:{_GRAM}], ' ') AS gram FROM qs),
rel AS (SELECT DISTINCT query_id, doc_id FROM it JOIN g USING (gram)),
b AS (SELECT query_id, max(1.0 / rank) AS rr FROM top JOIN rel USING (query_id, doc_id) GROUP BY query_id)
SELECT count(*)::BIGINT AS n_queries, round(sum(coalesce(rr, 0)) / count(*), 4) AS mrr10 FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN b USING (query_id)""",
)
def bm25_mrr10(spark, sf):
    """A document is relevant to a passage if it holds the passage's first six words in a row."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    index = build_index(docs, SPEC)
    found = search_batch(index, items, 10, id_col="item_id")
    own = items.select(F.col("item_id").alias("query_id"), F.slice(analysis.terms_col("simple", F.col("text")), 1, _GRAM).alias("words"))
    firsts = sorted({r[0] for r in own.select(F.element_at("words", 1)).where("size(words) > 0").distinct().collect()})
    # a row of six words wherever one begins that is the first of some passage
    at = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.isin(firsts) & (i + _GRAM <= F.size(w)), i + 1)), lambda i: i.isNotNull())
    words = docs.select("doc_id", analysis.terms_col("simple", F.col("text")).alias("w"))
    grams = words.select("doc_id", F.explode_outer(F.array_distinct(F.transform(at(F.col("w")), lambda i: F.array_join(F.slice("w", i, F.lit(_GRAM)), " ")))).alias("gram"))
    own = own.select("query_id", F.array_join("words", " ").alias("gram"))
    relevant = grams.join(F.broadcast(own), "gram").select("query_id", "doc_id").distinct()
    reciprocal = found.join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.max(1 / F.col("rank")).alias("rr"))
    each = relevant.select("query_id").distinct().join(reciprocal, "query_id", "left")
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.sum(F.coalesce("rr", F.lit(0.0))) / F.count(F.lit(1)), 4).alias("mrr10"))


# ---- kinds of indexes


@query(
    "bm25_expression_index",
    f"WITH {corpus("SELECT event_id AS doc_id, 0 AS f, event_type || ' ' || json_extract_string(props, '$.k') AS text FROM events")}, {bag('error 69')}, {scored()} {best()}",
)
def bm25_expression_index(spark, sf):
    spec = IndexSpec("events_idx", {"what": F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"))}, "simple", id_col="event_id")
    return rounded(search(build_index(table(spark, sf, "events"), spec), "error 69", K))


@query("bm25_partial_index_en", standard("anstin the", best(), src="SELECT doc_id, 0 AS f, text FROM documents WHERE lang = 'en'"))
def bm25_partial_index_en(spark, sf):
    spec = IndexSpec("en_idx", ("text",), "simple", id_col="doc_id", where="lang = 'en'")
    return rounded(search(docs_index(spark, sf, spec), "anstin the", K))


@query(
    "bm25_partition_stats",
    rf"""WITH {corpus()}, p AS (SELECT doc_id, lang AS part FROM documents), np AS (SELECT part, count(DISTINCT doc_id) AS n, count(*) AS total FROM tok JOIN p USING (doc_id) GROUP BY part),
dfp AS (SELECT part, term, count(*) AS df FROM tf JOIN p USING (doc_id) GROUP BY ALL), {bag('the de und que')},
sc AS (SELECT doc_id, round(-sum(w * ln((np.n + 1) / (dfp.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dlq / (total / np.n)))), 10) AS score
FROM q JOIN tf USING (term) JOIN p USING (doc_id) JOIN dfp USING (part, term) JOIN np USING (part) JOIN dl USING (doc_id) GROUP BY doc_id) {best(20)}""",
)
def bm25_partition_stats(spark, sf):
    spec = IndexSpec("by_lang", ("text",), "simple", id_col="doc_id", partition_by="lang")
    return rounded(search(docs_index(spark, sf, spec), "the de und que", 20))


_LANGS = {"en": "the anstin", "fr": "de la", "de": "und der", "es": "que de"}


@query(
    "bm25_multilang_union",
    " UNION ALL ".join(f"SELECT * FROM (WITH {corpus(f"SELECT doc_id, 0 AS f, text FROM documents WHERE lang = '{lang}'")}, {bag(q)}, {scored()} {best(5, f"'{lang}' AS lang, doc_id, round(score, 4) AS score")})" for lang, q in _LANGS.items()),
)
def bm25_multilang_union(spark, sf):
    out = None
    for lang, q in _LANGS.items():
        spec = IndexSpec(f"{lang}_idx", ("text",), "simple", id_col="doc_id", where=f"lang = '{lang}'")
        own = rounded(search(docs_index(spark, sf, spec), q, 5)).select(F.lit(lang).alias("lang"), "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    return out


_TURNS = "SELECT conv_id AS doc_id, 0 AS f, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE text <> '') AS text FROM conversations GROUP BY conv_id"


@query("bm25_array_docs", f"WITH {corpus(_TURNS)}, {bag('the and')}, {scored()} {best()}")
def bm25_array_docs(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("turns"))
    return rounded(search(build_index(turns, IndexSpec("conv_idx", ("turns",), "simple", id_col="conv_id")), "the and", K))


# ---- several fields

TWO_SPEC = IndexSpec("two_idx", ("source", "text"), "simple", id_col="doc_id")
_BOTH = "src3 anstin the"


@query("bm25f_two_fields", f"WITH {corpus(TWO)}, {bag(_BOTH, (0, 1), (1.0, 1.0))}, {scored()} {best()}")
def bm25f_two_fields(spark, sf):
    return rounded(search(docs_index(spark, sf, TWO_SPEC), _BOTH, K))


@query("bm25f_weights", f"WITH {corpus(TWO)}, {bag(_BOTH, (0, 1), (10.0, 0.5))}, {scored()} {best()}")
def bm25f_weights(spark, sf):
    spec = IndexSpec("weighted_idx", ("source", "text"), "simple", id_col="doc_id", field_weights=(10.0, 0.5))
    return rounded(search(docs_index(spark, sf, spec), _BOTH, K))


@query("bm25f_field_scope", f"WITH {corpus(TWO)}, q(f, term, w) AS (VALUES (0, 'src3', 1.0), (1, 'anstin', 1.0), (1, 'the', 1.0)), {scored()} {best()}")
def bm25f_field_scope(spark, sf):
    return rounded(search(docs_index(spark, sf, TWO_SPEC), BM25Query("source:src3 text:(anstin the)", grammar=True), K))


_TITLED = "SELECT doc_id, 0 AS f, lang || ' ' || source AS text FROM documents UNION ALL SELECT doc_id, 1, text FROM documents"


@query("bm25_record_lhs", f"WITH {corpus(_TITLED)}, {bag('en src5 the', (0, 1), (1.0, 1.0))}, {scored()} {best()}")
def bm25_record_lhs(spark, sf):
    spec = IndexSpec("record_idx", {"head": F.concat_ws(" ", "lang", "source"), "text": "text"}, "simple", id_col="doc_id")
    return rounded(search(docs_index(spark, sf, spec), "en src5 the", K))


# ---- prefixes, fuzzy terms, phrases


@query("bm25_prefix", f"WITH {corpus()}, q AS (SELECT 0 AS f, term, 1.0 AS w FROM (SELECT DISTINCT term FROM tok WHERE starts_with(term, 'anst') ORDER BY term LIMIT 50)), {scored()} {best(20)}")
def bm25_prefix_query(spark, sf):
    return rounded(search(docs_index(spark, sf), bm25_prefix("anst"), 20))


@query(
    "bm25_fuzzy_d1",
    f"WITH {corpus()}, q AS (SELECT 0 AS f, term, CASE d WHEN 0 THEN 1.0 ELSE 0.8 END AS w FROM (SELECT term, damerau_levenshtein(term, 'anstin') AS d FROM (SELECT DISTINCT term FROM tok) ORDER BY d, term LIMIT 50) WHERE d <= 1), {scored()} {best(20)}",
)
def bm25_fuzzy_d1(spark, sf):
    return rounded(search(docs_index(spark, sf), BM25Query("anstin", fuzzy=1), 20))


def _fuzzy_sql(distance: str, most: int, cap: int = 50) -> str:
    """The expansions of a fuzzy term: the nearest first, then in dictionary order."""
    return f"q AS (SELECT 0 AS f, term, CASE d WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END AS w FROM (SELECT term, {distance} AS d FROM (SELECT DISTINCT term FROM tok)) WHERE d <= {most} ORDER BY d, term LIMIT {cap})"


@query("bm25_fuzzy_d2", f"WITH {corpus()}, {_fuzzy_sql("damerau_levenshtein(term, 'anstin')", 2)}, {scored()} {best(20)}")
def bm25_fuzzy_d2(spark, sf):
    return rounded(search(docs_index(spark, sf), BM25Query("anstin", fuzzy=2), 20))


_NEAR = ", ".join(f"CASE WHEN length(term) >= {n} THEN damerau_levenshtein(term[1:{n}], 'anst') END" for n in (3, 4, 5))


@query("bm25_fuzzy_prefix", f"WITH {corpus()}, {_fuzzy_sql(f'least({_NEAR})', 1)}, {scored()} {best(20)}")
def bm25_fuzzy_prefix(spark, sf):
    return rounded(search(docs_index(spark, sf), BM25Query("anst*", grammar=True, fuzzy=1), 20))


def _phrase_sql(words: list[str], match: str, terms: str, tail: str = "", src: str = ONE, f: str = "") -> str:
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.f = t0.f AND t{i}.pos = t0.pos + {i}" for i in range(1, len(words)))
    return f"WITH {corpus(src)}, {terms}, {scored()}, ph AS (SELECT DISTINCT t0.doc_id FROM tok t0 {joins} WHERE {match}{f}) {best(20, source='(SELECT sc.* FROM sc JOIN ph USING (doc_id))')}{tail}"


@query("bm25_phrase", _phrase_sql(["of", "the"], "t0.term = 'of' AND t1.term = 'the'", bag("of the")))
def bm25_phrase_query(spark, sf):
    return rounded(search(docs_index(spark, sf), bm25_phrase("of the"), 20))


@query(
    "bm25_phrase_prefix",
    _phrase_sql(["of", "an"], "t0.term = 'of' AND starts_with(t1.term, 'an')", "q AS (SELECT 0 AS f, 'of' AS term, 1.0 AS w UNION ALL SELECT 0, term, 1.0 FROM (SELECT DISTINCT term FROM tok WHERE starts_with(term, 'an') ORDER BY term LIMIT 50))"),
)
def bm25_phrase_prefix_query(spark, sf):
    return rounded(search(docs_index(spark, sf), bm25_phrase_prefix("of an"), 20))


@query("bm25_field_phrase", _phrase_sql(["of", "the"], "t0.term = 'of' AND t1.term = 'the'", "q(f, term, w) AS (VALUES (1, 'of', 1.0), (1, 'the', 1.0), (0, 'src3', 1.0), (1, 'src3', 1.0))", src=TWO, f=" AND t0.f = 1"))
def bm25_field_phrase(spark, sf):
    return rounded(search(docs_index(spark, sf, TWO_SPEC), BM25Query('text:"of the" src3', grammar=True), 20))


# ---- around the score: joins, aggregates, windows, sets


@query("bm25_join_labels", standard(WORDS, "SELECT doc_id, quality, toxic, round(score, 4) AS score FROM (SELECT * FROM sc JOIN labels USING (doc_id) ORDER BY score, doc_id LIMIT 10)"))
def bm25_join_labels(spark, sf):
    found = scores(docs_index(spark, sf), WORDS).join(table(spark, sf, "labels"), "doc_id")
    return rounded(found.orderBy("score", "doc_id").limit(K)).select("doc_id", "quality", "toxic", "score")


@query("bm25_anti_join", standard(WORDS, best(source="(SELECT sc.* FROM sc ANTI JOIN labels USING (doc_id))")))
def bm25_anti_join(spark, sf):
    found = scores(docs_index(spark, sf), WORDS).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return rounded(found.orderBy("score", "doc_id").limit(K))


@query("bm25_facets", standard(WORDS, "SELECT lang AS value, count(*)::BIGINT AS n FROM (SELECT * FROM sc ORDER BY score, doc_id LIMIT 100) JOIN documents USING (doc_id) GROUP BY lang"))
def bm25_facets(spark, sf):
    docs = table(spark, sf, "documents")
    return facets(search(build_index(docs, SPEC), WORDS, 100), docs, "lang")


@query("bm25_agg_scores", standard(WORDS, "SELECT count(*)::BIGINT AS n, round(avg(score), 4) AS avg_score, round(min(score), 4) AS best, round(max(score), 4) AS worst FROM sc"))
def bm25_agg_scores(spark, sf):
    s = F.col("score")
    return scores(docs_index(spark, sf), WORDS).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 4).alias("avg_score"), F.round(F.min(s), 4).alias("best"), F.round(F.max(s), 4).alias("worst"))


@query("bm25_having", standard(WORDS, "SELECT source, count(*)::BIGINT AS n, round(min(score), 4) AS best FROM sc JOIN documents USING (doc_id) GROUP BY source HAVING count(*) > 20"))
def bm25_having(spark, sf):
    docs = table(spark, sf, "documents")
    found = scores(build_index(docs, SPEC), WORDS).join(docs.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 4).alias("best")).where("n > 20")


@query("bm25_rank_window", standard(WORDS, "SELECT lang, rank::INTEGER AS rank, doc_id, round(score, 4) AS score FROM (SELECT lang, doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS rank FROM sc JOIN documents USING (doc_id)) WHERE rank <= 3"))
def bm25_rank_window(spark, sf):
    docs = table(spark, sf, "documents")
    found = scores(build_index(docs, SPEC), WORDS).join(docs.select("doc_id", "lang"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("score", "doc_id"))
    return rounded(found.withColumn("rank", rank).where("rank <= 3")).select("lang", "rank", "doc_id", "score")


@query("bm25_lag_check", standard(WORDS, "SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE prev > score)::BIGINT AS n_disorder FROM (SELECT score, lag(score) OVER (ORDER BY score, doc_id) AS prev FROM (SELECT * FROM sc ORDER BY score, doc_id LIMIT 100))"))
def bm25_lag_check(spark, sf):
    found = search(docs_index(spark, sf), WORDS, 100)  # the window sees 100 rows
    prev = F.lag("score").over(Window.orderBy("score", "doc_id"))
    return found.withColumn("prev", prev).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prev") > F.col("score")).cast("long")).alias("n_disorder")).withColumn("n_disorder", F.coalesce("n_disorder", F.lit(0)))


def _two_searches(op: str) -> str:
    a, b = (f"SELECT doc_id FROM (WITH {corpus()}, {bag(q)}, {scored()} {best(50, 'doc_id')})" for q in ("anstin the", "bleha the"))
    return f"({a}) {op} ({b})"


@query("bm25_union", _two_searches("UNION ALL"))
def bm25_union(spark, sf):
    index = docs_index(spark, sf)
    return search(index, "anstin the", 50).select("doc_id").unionByName(search(index, "bleha the", 50).select("doc_id"))


@query("bm25_except", _two_searches("EXCEPT"))
def bm25_except(spark, sf):
    index = docs_index(spark, sf)
    return search(index, "anstin the", 50).select("doc_id").subtract(search(index, "bleha the", 50).select("doc_id"))


@query("bm25_intersect", _two_searches("INTERSECT"))
def bm25_intersect(spark, sf):
    index = docs_index(spark, sf)
    return search(index, "anstin the", 50).select("doc_id").intersect(search(index, "bleha the", 50).select("doc_id"))


# ---- upkeep


@query("bm25_append_visible", standard("anstin the", best()))
def bm25_append_visible(spark, sf):
    """Indexed in two parts, of which the second is appended: as if built at once."""
    docs = table(spark, sf, "documents")
    return rounded(search(build_index(docs.where("doc_id % 3 = 0"), SPEC).append(docs.where("doc_id % 3 <> 0")), "anstin the", K))


@query("bm25_delete", standard("anstin the", best(), src="SELECT doc_id, 0 AS f, text FROM documents WHERE lang <> 'fr'"))
def bm25_delete(spark, sf):
    docs = table(spark, sf, "documents")
    return rounded(search(build_index(docs, SPEC).delete(docs.where("lang = 'fr'").select("doc_id")), "anstin the", K))


@query("bm25_update", standard("anstin the", best(), src="SELECT doc_id, 0 AS f, CASE WHEN lang = 'de' THEN source ELSE text END AS text FROM documents"))
def bm25_update(spark, sf):
    docs = table(spark, sf, "documents")
    return rounded(search(build_index(docs, SPEC).update(docs.where("lang = 'de'").withColumn("text", F.col("source"))), "anstin the", K))


@query("bm25_df_stats", f"WITH {corpus()} SELECT term, df::BIGINT AS df FROM df")
def bm25_df_stats(spark, sf):
    return docs_index(spark, sf).terms.select("term", "df")


@query("bm25_lengths", f"WITH {corpus()} SELECT doc_id, dl::BIGINT AS dl, dlq::BIGINT AS dlq FROM dl")
def bm25_lengths(spark, sf):
    return docs_index(spark, sf).docs.select("doc_id", "dl", "dlq")


@query(
    "bm25_summary",
    f"WITH {corpus()} SELECT (SELECT n FROM n)::BIGINT AS n_docs, (SELECT count(*) FROM df)::BIGINT AS n_terms, (SELECT count(*) FROM tf)::BIGINT AS n_postings, (SELECT count(*) FROM tok)::BIGINT AS total_len, round((SELECT av FROM avgs), 4) AS avg_len",
)
def bm25_summary(spark, sf):
    return admin.summarize(docs_index(spark, sf)).select("n_docs", "n_terms", "n_postings", "total_len", F.round("avg_len", 4).alias("avg_len"))


@query("bm25_dump", f"WITH {corpus()} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf, min(doc_id) AS first_doc FROM tf GROUP BY term")
def bm25_dump(spark, sf):
    own = admin.dump(docs_index(spark, sf))
    return own.groupBy("term").agg(F.max("df").alias("df"), F.sum("tf").alias("tf"), F.min("doc_id").alias("first_doc"))


@query("bm25_positions", f"WITH {corpus()} SELECT doc_id, term, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY ALL")
def bm25_positions(spark, sf):
    own = docs_index(spark, sf).postings
    return own.select("doc_id", "term", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("bm25_vector", f"WITH {corpus()} SELECT doc_id, 'documents_idx:{{' || string_agg(term || ':' || tf, ',' ORDER BY term) || '}}' AS vector FROM tf GROUP BY doc_id")
def bm25_vector(spark, sf):
    own = docs_index(spark, sf).vectors.select("doc_id", F.col("ps").alias("ts")).where("size(ts) > 0")
    return own.select("doc_id", F.concat(F.lit("documents_idx:{"), F.array_join(F.transform("ts", lambda t: F.concat_ws(":", t["term"], t["tf"])), ","), F.lit("}")).alias("vector"))


# ---- without an SQL equivalent


@query("bm25_english")
def bm25_english(spark, sf):
    spec = IndexSpec("english_idx", ("text",), "english", id_col="doc_id", where="lang = 'en'")
    return rounded(search(docs_index(spark, sf, spec), "anstin bleha eresnd", K))


@query("bm25_html_index")
def bm25_html_index(spark, sf):
    spec = IndexSpec("pages_idx", ("html",), "simple", id_col="page_id", content_format="html")
    return rounded(search(build_index(table(spark, sf, "pages"), spec), "the and", K))


@query("bm25_markdown_index")
def bm25_markdown_index(spark, sf):
    spec = IndexSpec("md_idx", ("text",), "simple", id_col="doc_id", content_format="markdown")
    return rounded(search(docs_index(spark, sf, spec), "anstin the", K))


def _found(spark, sf):
    docs = table(spark, sf, "documents")
    index = build_index(docs, SPEC)
    return index, docs.select("doc_id", "text").join(search(index, "anstin", K), "doc_id")


@query("bm25_snippet")
def bm25_snippet_query(spark, sf):
    index, rows = _found(spark, sf)
    return bm25_snippet(index, rows, "anstin").select("doc_id", "snippet")


from . import catalogue_life  # noqa: E402, F401  it registers its queries here
