"""Registered queries of stored, streamed, named and inherited indexes, of SQL access and of highlights, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .catalogue import K, ONE, SPEC, WORDS, bag, best, corpus, docs_index, query, rounded, scored, standard
from .conf import SearchConf
from .operators import admin
from .operators.highlight import bm25_headline, bm25_snippet_positions
from .operators.index import IndexCatalog, build_index, build_inherited
from .operators.search import Searcher, search
from .plans.query import BM25Query
from .sources.store import IndexStore, working_root
from .sources.tables import read, table, write
from .sqlapi import register_functions, register_index
from .streaming.ingest import ingest

# ---- stored indexes


def _stored(spark, sf, parts: int = 3, levels: int = 8) -> IndexStore:
    """The documents as a stored index, appended in parts."""
    store = IndexStore(spark, working_root(spark), replace(SPEC, conf=SearchConf(segments_per_level=levels)))
    docs = table(spark, sf, "documents")
    for i in range(parts):
        store.append(docs.where(F.pmod("doc_id", F.lit(parts)) == i))
    return store


_NO_FR = "SELECT doc_id, 0 AS f, text FROM documents WHERE lang <> 'fr'"


@query("bm25_stored", standard(WORDS, best(20)))
def bm25_stored(spark, sf):
    """Three segments on disk, searched as one index."""
    return rounded(search(_stored(spark, sf).open(), WORDS, 20))


@query("bm25_stored_delete", standard(WORDS, best(20), src=_NO_FR))
def bm25_stored_delete(spark, sf):
    """Tombstones hide documents of three segments."""
    store = _stored(spark, sf)
    store.delete(table(spark, sf, "documents").where("lang = 'fr'").select("doc_id"))
    return rounded(search(store.open(), WORDS, 20))


@query("bm25_vacuum", f"WITH {corpus(_NO_FR)} SELECT (SELECT n FROM n)::BIGINT AS n_docs, 1::INTEGER AS n_segments")
def bm25_vacuum(spark, sf):
    store = _stored(spark, sf)
    store.delete(table(spark, sf, "documents").where("lang = 'fr'").select("doc_id"))
    return store.vacuum()


@query("bm25_compaction", standard(WORDS, best(20)))
def bm25_compaction(spark, sf):
    """Two segments a level: appending merges them, and scores stay."""
    return rounded(search(_stored(spark, sf, 2, 2).open(), WORDS, 20))


@query("bm25_force_merge", f"WITH {corpus()} SELECT 1::BIGINT AS n_segments, (SELECT n FROM n)::BIGINT AS n_docs, (SELECT count(*) FROM tf)::BIGINT AS n_postings")
def bm25_force_merge(spark, sf):
    store = _stored(spark, sf)
    store.force_merge()
    n = len(store.manifest["segments"])
    return admin.summarize(store.open()).select(F.lit(n).cast("long").alias("n_segments"), "n_docs", "n_postings")


@query("bm25_stream_ingest", standard(WORDS, best(20)))
def bm25_stream_ingest(spark, sf):
    """The table as a stream, indexed batch by batch."""
    root = working_root(spark)
    store = IndexStore(spark, root, SPEC)
    source = table(spark, sf, "documents")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/documents.parquet*")
    ingest(stream, store, f"{root}-checkpoint").awaitTermination()
    return rounded(search(IndexStore(spark, root, SPEC).open(), WORDS, 20))


@query("bm25_prewarm", f"WITH {corpus()} SELECT ((SELECT count(*) FROM dl) + (SELECT count(*) FROM tf))::BIGINT AS n_rows")
def bm25_prewarm(spark, sf):
    index = docs_index(spark, sf)
    n = index.prewarm()
    index.docs.unpersist()
    index.postings.unpersist()
    return spark.createDataFrame([(n,)], "n_rows long")


@query("bm25_empty_index", f"WITH {corpus(ONE + ' WHERE false')} SELECT (SELECT n FROM n)::BIGINT AS n_docs, (SELECT count(*) FROM tf)::BIGINT AS n_postings, (SELECT count(*) FROM tok)::BIGINT AS n_found")
def bm25_empty_index(spark, sf):
    """An index of no rows has statistics, and a search in it finds nothing."""
    index = build_index(table(spark, sf, "documents").where("false"), SPEC)
    found = search(index, WORDS, K).agg(F.count(F.lit(1)).alias("n_found"))
    return admin.summarize(index).select("n_docs", "n_postings").join(F.broadcast(found))  # one row by one row


# ---- which index


@query("bm25_implicit_index", standard(WORDS, best()))
def bm25_implicit_index(spark, sf):
    """The query names no index; the one on the field is found, not a partial one."""
    catalog, docs = IndexCatalog(), table(spark, sf, "documents")
    catalog.add(build_index(docs, replace(SPEC, name="part_idx", where="lang = 'en'")))
    catalog.add(build_index(docs, SPEC))
    return rounded(Searcher(catalog).search(WORDS, ["text"], K).found)


@query("bm25_named_index", standard(WORDS, best(), src="SELECT doc_id, 0 AS f, text FROM documents WHERE lang = 'en'"))
def bm25_named_index(spark, sf):
    """Names with a schema and in any case; a partial index is used by its name."""
    catalog, docs = IndexCatalog(), table(spark, sf, "documents")
    catalog.add(build_index(docs, replace(SPEC, where="lang = 'en'")), "Lib.Part_Idx")
    catalog.add(build_index(docs, SPEC))
    return rounded(Searcher(catalog).search(BM25Query.parse(f"LIB.part_idx:{WORDS}"), ["text"], K).found)


@query("bm25_inheritance", standard(WORDS, best(20)))
def bm25_inheritance(spark, sf):
    """A parent and two children whose columns lie in another order, matched by name."""
    docs = table(spark, sf, "documents")
    parent, child, other = docs.where("lang = 'en'").select("doc_id", "text"), docs.where("lang = 'fr'").select("source", "text", "doc_id"), docs.where("lang not in ('en', 'fr')").select("n_chars", "doc_id", "text")
    return rounded(search(build_inherited(parent, [child, other], SPEC), WORDS, 20))


# ---- SQL


@query("bm25_sql_search", standard("anstin the", best(columns="doc_id, round(score, 4) AS score, rank::INTEGER AS rank", source="(SELECT *, row_number() OVER (ORDER BY score, doc_id) AS rank FROM sc)")))
def bm25_sql_search(spark, sf):
    name = register_index(docs_index(spark, sf), "sqlsearch_idx")
    return rounded(spark.sql(f"SELECT doc_id, score, rank FROM {name}_search('anstin the', {K})"))


@query("bm25_sql_vector", f"WITH {corpus('SELECT item_id AS doc_id, 0 AS f, text FROM benchmark')} SELECT doc_id AS item_id, 'items:{{' || string_agg(term || ':' || tf, ',' ORDER BY term) || '}}' AS vector FROM tf GROUP BY doc_id")
def bm25_sql_vector(spark, sf):
    register_functions(spark)
    return table(spark, sf, "benchmark").selectExpr("item_id", "to_bm25vector('items', 'simple', text) AS vector")


@query("bm25_sql_builders", "SELECT item_id, text || '*' AS prefix, '\"' || text || '\"' AS phrase, '\"' || text || '*\"' AS phrase_prefix FROM benchmark")
def bm25_sql_builders(spark, sf):
    register_functions(spark)
    return table(spark, sf, "benchmark").selectExpr("item_id", "bm25_prefix(text) AS prefix", "bm25_phrase(text) AS phrase", "bm25_phrase_prefix(text) AS phrase_prefix")


@query("bm25_sql_query", "SELECT item_id, 'items:' || text AS query FROM benchmark")
def bm25_sql_query(spark, sf):
    register_functions(spark)
    return table(spark, sf, "benchmark").selectExpr("item_id", "to_bm25query(text, 'items') AS query")


@query(
    "bm25_binary",
    f"WITH {corpus('SELECT item_id AS doc_id, 0 AS f, text FROM benchmark')}, v AS (SELECT doc_id AS item_id, 'items:{{' || string_agg(term || ':' || tf, ',' ORDER BY term) || '}}' AS vector FROM tf GROUP BY doc_id) "
    "SELECT item_id, '03010000056974656D73' || hex(text) AS query_hex, 'items:' || text AS query, '01' || hex(vector) AS vector_hex, vector FROM benchmark JOIN v USING (item_id)",
)
def bm25_binary(spark, sf):
    """Binary forms of queries and vectors, and what they are read back as."""
    register_functions(spark)
    own = table(spark, sf, "benchmark").selectExpr("item_id", "bm25query_to_bytes(text, 'items') AS q", "bm25vector_to_bytes(to_bm25vector('items', 'simple', text)) AS v")
    return own.selectExpr("item_id", "hex(q) AS query_hex", "bm25query_from_bytes(q) AS query", "hex(v) AS vector_hex", "bm25vector_from_bytes(v) AS vector")


@query("bm25_has_grammar", r"""SELECT conv_id, turn, regexp_matches(text, '[":*()]') AS plain, true AS starred FROM conversations""")
def bm25_has_grammar(spark, sf):
    register_functions(spark)
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", "bm25_has_grammar(text) AS plain", "bm25_has_grammar(concat(text, ' x*')) AS starred")


_FORMATS = ("parquet", "orc", "json", "csv", "tsv")


@query("bm25_formats", " UNION ALL ".join(f"SELECT '{x}' AS format, count(*)::BIGINT AS n, sum(length(t))::BIGINT AS n_chars, count(DISTINCT t)::BIGINT AS n_texts FROM (SELECT regexp_replace(text, '[\\\\\"\\s]', '.', 'g') AS t FROM documents)" for x in _FORMATS))
def bm25_formats(spark, sf):
    """The documents on one line each, written and read back in every format."""
    out, docs = None, table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r'[\\"\t\n\f\r ]', ".").alias("text"))  # white space as RE2 has it, without \v
    for kind in _FORMATS:
        path = working_root(spark)
        write(docs, path, kind)
        own = read(spark, path, kind, docs.schema).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("text").alias("n_texts"))
        own = own.select(F.lit(kind).alias("format"), "n", "n_chars", "n_texts")
        out = own if out is None else out.unionByName(own)
    return out


# ---- highlights; offsets are bytes of UTF-8

_TOP = f"SELECT doc_id, text FROM documents JOIN (SELECT doc_id FROM sc ORDER BY score, doc_id LIMIT {K}) USING (doc_id)"
_W = "[A-Za-z0-9_\\x{80}-\\x{10FFFF}]+"


def _marks(columns: str, match: str, terms: str | None) -> str:
    """Where words begin and end: sums of the lengths of the words and of what lies between them. terms None: in all documents."""
    top = "WITH top AS (SELECT doc_id, text FROM documents)," if terms is None else f"WITH {corpus()}, {terms}, {scored()}, top AS ({_TOP}),"
    return f"""{top}
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS word, unnest(string_split_regex(text, '{_W}')[1:len(regexp_extract_all(text, '{_W}'))]) AS gap, unnest(range(len(regexp_extract_all(text, '{_W}')))) AS i FROM top),
p AS (SELECT doc_id, word, (sum(strlen(gap) + strlen(word)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop FROM w)
SELECT doc_id, {columns} FROM p WHERE {match} GROUP BY doc_id"""


@query("bm25_snippet_positions", _marks("""'[' || string_agg('{"start":' || (stop - strlen(word)) || ',"end":' || stop || '}', ',' ORDER BY stop) || ']' AS positions""", "lower(word) = 'anstin'", bag("anstin")))
def bm25_snippet_positions_query(spark, sf):
    index = docs_index(spark, sf)
    rows = table(spark, sf, "documents").select("doc_id", "text").join(search(index, "anstin", K), "doc_id")
    return bm25_snippet_positions(index, rows, "anstin").select("doc_id", F.to_json("positions").alias("positions"))


@query(
    "bm25_sql_snippet",
    f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '{_W}') AS w, string_split_regex(text, '{_W}') AS g FROM conversations WHERE strlen(text) <= 150)
SELECT conv_id, turn, CASE WHEN list_contains(list_transform(w, lambda x: lower(x)), 'the')
  THEN array_to_string(list_transform(range(len(w)), lambda i: g[i + 1] || CASE WHEN lower(w[i + 1]) = 'the' THEN '<b>' || w[i + 1] || '</b>' ELSE w[i + 1] END), '') || g[len(g)] ELSE '' END AS snippet FROM t""",
)
def bm25_sql_snippet(spark, sf):
    """Texts that fit into a snippet whole."""
    register_functions(spark)
    return table(spark, sf, "conversations").where("octet_length(text) <= 150").selectExpr("conv_id", "turn", "bm25_snippet(text, 'the', 'simple') AS snippet")


@query("bm25_sql_positions", _marks("""'[' || string_agg('{"start":' || (stop - strlen(word)) || ',"end":' || stop || '}', ',' ORDER BY stop) || ']' AS positions""", "lower(word) = 'the' OR starts_with(lower(word), 'anst')", None))
def bm25_sql_positions(spark, sf):
    """Over the whole table, with the query and the configuration as arguments."""
    register_functions(spark)
    found = table(spark, sf, "documents").selectExpr("doc_id", "bm25_snippet_positions(text, 'the anst*', 'simple') AS p")
    return found.where("size(p) > 0").select("doc_id", F.to_json("p").alias("positions"))


@query("bm25_headline_matches", _marks("string_agg(word || ':' || (stop - strlen(word)) || ':' || stop || ':prefix', ',' ORDER BY stop) AS matches", "starts_with(lower(word), 'anst')", "q AS (SELECT 0 AS f, term, 1.0 AS w FROM (SELECT DISTINCT term FROM tok WHERE starts_with(term, 'anst') ORDER BY term LIMIT 50))"))
def bm25_headline_matches(spark, sf):
    index = docs_index(spark, sf)
    rows = table(spark, sf, "documents").select("doc_id", "text").join(search(index, BM25Query("anst*", grammar=True), K), "doc_id")
    found = bm25_headline(index, rows, "anst*").select("doc_id", F.col("headline.text.matches").alias("m"))
    return found.select("doc_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["matched_text"], x["start"], x["end"], x["match_type"])), ",").alias("matches"))
