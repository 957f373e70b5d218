"""The inverted index: four tables that are plain DataFrames.

    docs      (doc_id, field_idx, dl, dlq [, part])            a row for each field of a document that has a term
    postings  (field_idx, term, doc_id, tf, dlq, positions [, part])
    terms     (field_idx, term, df [, part])
    stats     (n_docs, total_len, and the total of each field [, part])

Built lazily they cost nothing until a search asks for some of them, and a filter on terms reaches down to the exploded
tokens. Saved, postings are parquet sorted by (field_idx, term, doc_id), so that the literal terms of a query prune row
groups. Lengths are quantised in postings; averages use raw lengths.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from ..conf import SearchConf
from ..errors import QuillError
from ..functions import analysis
from ..functions.markup import check_format, normalise_col
from ..functions.norms import quantised_length_col

MAX_FIELDS = 16


@dataclass(frozen=True)
class IndexSpec:
    """What is indexed and how. fields: column names, or names with expressions. where: only rows that satisfy it.
    partition_by: documents of each value of this expression have statistics of their own. content_format: one of plain,
    html and markdown for all fields, or one for each named field."""

    name: str
    fields: tuple[str, ...] | dict[str, Column | str]
    text_config: str
    id_col: str = "id"
    k1: float = 1.2
    b: float = 0.75
    field_weights: tuple[float, ...] = ()
    content_format: str | dict[str, str] = "plain"
    where: Column | str | None = None
    partition_by: Column | str | None = None
    conf: SearchConf = field(default_factory=SearchConf)

    def __post_init__(self):
        if not self.text_config:
            raise QuillError("text_config is required")
        analysis.check_config(self.text_config)
        if not 0.1 <= self.k1 <= 10:
            raise QuillError("k1 must be between 0.1 and 10")
        if not 0 <= self.b <= 1:
            raise QuillError("b must be between 0 and 1")
        if not 1 <= len(self.fields) <= MAX_FIELDS:
            raise QuillError(f"an index has 1 to {MAX_FIELDS} fields")
        weights = self.field_weights
        if weights:
            if len(weights) != len(self.fields):
                raise QuillError(f"field_weights has {len(weights)} values for {len(self.fields)} fields")
            if not all(0 < w <= 1e6 for w in weights):
                raise QuillError("field weights are above 0 and at most 1000000")
        formats = self.content_format
        if isinstance(formats, dict):
            lower = {f.lower() for f in self.names}
            for f, kind in formats.items():
                check_format(kind)
                if f.lower() not in lower:
                    raise QuillError(f"content_format names an unknown field {f!r}")
        else:
            check_format(formats)

    @property
    def names(self) -> list[str]:
        return list(self.fields)

    def column(self, name: str) -> Column:
        c = self.fields[name] if isinstance(self.fields, dict) else name
        return F.expr(c) if isinstance(c, str) and isinstance(self.fields, dict) else F.col(c) if isinstance(c, str) else c

    def weight(self, i: int) -> float:
        return self.field_weights[i] if self.field_weights else 1.0

    def format(self, name: str) -> str:
        if isinstance(self.content_format, str):
            return check_format(self.content_format)
        return check_format({f.lower(): k for f, k in self.content_format.items()}.get(name.lower(), "plain"))

    def parsed_weights(self, text: str) -> IndexSpec:
        """field_weights from 'w0,w1,...'."""
        try:
            return replace(self, field_weights=tuple(float(x) for x in text.split(",")))
        except ValueError:
            raise QuillError(f"malformed field_weights {text!r}") from None


@dataclass(frozen=True)
class Stats:
    n_docs: int
    total_len: int
    by_field: tuple[int, ...]

    def average(self, i: int) -> float:
        """Average length of a field over all documents; of whole documents where the field is empty everywhere."""
        if not self.n_docs:
            return 0.0
        return (self.by_field[i] or self.total_len) / self.n_docs


def text_of(df: DataFrame, spec: IndexSpec, name: str) -> Column:
    """The text of a field before analysis: arrays flattened, markup normalised, null kept."""
    c = spec.column(name)
    kind = df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, ArrayType):
        c = analysis.flatten_array(c)
    elif kind.typeName() not in ("string", "char", "varchar"):
        c = c.cast("string")
    return normalise_col(spec.format(name), c)


def analysed(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """(doc_id, field_idx, tokens [, part]): one row for each field of a document. Those without a term are left in: a filter
    on tokens would move below the analysis and repeat it."""
    if spec.where is not None:
        df = df.where(spec.where)
    part = [] if spec.partition_by is None else [(F.expr(spec.partition_by) if isinstance(spec.partition_by, str) else spec.partition_by).alias("part")]
    cells = [F.struct(F.lit(i).alias("field_idx"), analysis.tokens_col(spec.text_config, text_of(df, spec, n)).alias("tokens")) for i, n in enumerate(spec.names)]
    if len(cells) == 1:
        out = df.select(F.col(spec.id_col).alias("doc_id"), *part, cells[0].alias("c"))
    else:
        out = df.select(F.col(spec.id_col).alias("doc_id"), *part, F.explode(F.array(*cells)).alias("c"))
    return out.select("doc_id", *(["part"] if part else []), "c.field_idx", "c.tokens")


class Index:
    """An index over DataFrames; see build_index and sources.store for saved ones."""

    def __init__(self, spec: IndexSpec, docs: DataFrame, postings: DataFrame, documents: DataFrame | None = None, lengths: DataFrame | None = None, tokens: DataFrame | None = None):
        """lengths: docs with rows of length 0 besides, which cost less to read where docs are analysed on the fly. tokens: of
        an index that is not stored, (doc_id, field_idx, dl, dlq, tokens [, part]), for what needs no postings."""
        self.spec, self.docs, self.postings, self.documents = spec, docs, postings, documents
        self.lengths = docs if lengths is None else lengths
        self.tokens = tokens
        self.vectors = None  # (doc_id, field_idx, dlq, ps [, part]) of an index that is not stored: the postings of a text as one array
        self.holding = None  # tokens of the rows whose texts hold one of some words

    @property
    def part(self) -> list[str]:
        return ["part"] if "part" in self.docs.columns else []

    @property
    def _words(self) -> Column:
        return analysis.token_terms(self.spec.text_config, F.col("tokens"))

    @cached_property
    def terms(self) -> DataFrame:
        if self.tokens is not None:  # no positions are gathered
            own = self.tokens.select(*self.part, "field_idx", F.explode_outer(F.array_distinct(self._words)).alias("term"))
            return own.where("term is not null").groupBy(*self.part, "field_idx", "term").agg(F.count(F.lit(1)).alias("df"))
        return self.postings.groupBy(*self.part, "field_idx", "term").agg(F.count(F.lit(1)).alias("df"))

    @property
    def words(self) -> DataFrame:
        """(field_idx, term) of the dictionary, with repeats: what a look-up filters before it takes distinct ones."""
        if self.tokens is None:
            return self.terms.select("field_idx", "term")
        return self.tokens.select("field_idx", F.explode_outer(F.array_distinct(self._words)).alias("term")).where("term is not null")

    @cached_property
    def stats_table(self) -> DataFrame:
        """One row (a row for each part). A document counts once whatever fields it has."""
        own, n = self.lengths, len(self.spec.fields)
        if n > 1:
            own = own.groupBy(*self.part, "doc_id").agg(F.sum("dl").alias("dl"), *[F.sum(F.when(F.col("field_idx") == i, F.col("dl")).otherwise(0)).alias(f"f{i}") for i in range(n)])
        else:
            own = own.withColumn("f0", F.col("dl"))
        sums = [F.sum((F.col("dl") > 0).cast("long")).alias("n_docs"), F.sum("dl").alias("total_len"), *[F.sum(f"f{i}").alias(f"total_len_{i}") for i in range(n)]]
        return own.groupBy(*self.part).agg(*sums) if self.part else own.agg(*sums)

    @cached_property
    def stats(self) -> Stats:
        if self.part:
            raise QuillError("a partitioned index has statistics for each part; use stats_table")
        r = self.stats_table.first()
        return Stats(r["n_docs"] or 0, r["total_len"] or 0, tuple(r[f"total_len_{i}"] or 0 for i in range(len(self.spec.fields))))

    def facts(self, by_field: dict[int, set[str]]) -> tuple[Stats, dict[tuple[int, str], int]]:
        """The statistics, and in how many documents each of these terms is: one pass if the index is not stored."""
        wanted = [(f, t) for f, ts in sorted(by_field.items()) for t in sorted(ts)]
        if self.tokens is None or "stats" in self.__dict__ or len(wanted) > 200:
            ok = F.lit(False)
            for f, ts in sorted(by_field.items()):
                ok = ok | ((F.col("field_idx") == f) & F.col("term").isin(sorted(ts)))
            return self.stats, {(r["field_idx"], r["term"]): r["df"] for r in self.terms.where(ok).collect()}
        # the words that are asked for, once for each text
        found = self.tokens.select("doc_id", "field_idx", "dl", F.array_intersect(self._words, F.array(*[F.lit(t) for t in sorted({t for _, t in wanted})])).alias("found"))
        own = found.select("doc_id", "field_idx", "dl", *[((F.col("field_idx") == f) & F.array_contains("found", t)).cast("long").alias(f"t{k}") for k, (f, t) in enumerate(wanted)])
        n = len(self.spec.fields)
        sums = [F.sum(f"t{k}").alias(f"t{k}") for k in range(len(wanted))]
        totals = [F.sum(F.when(F.col("field_idx") == i, F.col("dl")).otherwise(0)).alias(f"f{i}") for i in range(n)]
        if n > 1:
            own = own.groupBy("doc_id").agg(F.sum("dl").alias("dl"), *totals, *sums)
            totals = [F.sum(f"f{i}").alias(f"f{i}") for i in range(n)]
        r = own.agg(F.sum((F.col("dl") > 0).cast("long")).alias("n"), F.sum("dl").alias("total"), *totals, *sums).first()
        self.__dict__["stats"] = Stats(r["n"] or 0, r["total"] or 0, tuple(r[f"f{i}"] or 0 for i in range(n)))
        return self.stats, {key: r[f"t{k}"] for k, key in enumerate(wanted) if r[f"t{k}"]}

    def postings_of(self, keys: DataFrame) -> DataFrame:
        """(field_idx, term, doc_id, tf, dlq [, part]) of the terms of keys (field_idx, term), which is small enough to broadcast."""
        if self.tokens is None:
            return self.postings.drop("positions")  # the join with the terms' weights comes anyway
        own = self.tokens.select("doc_id", *self.part, "field_idx", "dlq", F.explode_outer(self._words).alias("term"))
        own = own.join(F.broadcast(keys), ["field_idx", "term"], "left_semi")
        return own.groupBy(*self.part, "field_idx", "term", "doc_id", "dlq").agg(F.count(F.lit(1)).alias("tf"))

    def postings_where(self, ok: Column, words: list[str] | None = None, positions: bool = False) -> DataFrame:
        """The postings that satisfy ok (on field_idx and term), with positions if they are asked for. words: texts without any of
        them have no such posting, and are not analysed if the index is not stored."""
        if self.tokens is None:
            own = self.postings.where(ok)
            return own if positions else own.drop("positions")
        tokens = self.tokens if words is None or self.holding is None else self.holding(words)
        by = [*self.part, "field_idx", "term", "doc_id", "dlq"]
        own = tokens.select("doc_id", *self.part, "field_idx", "dlq", F.posexplode_outer("tokens").alias("i", "t"))
        simple = self.spec.text_config == "simple"
        own = own.select(*by[:-3], F.col("t" if simple else "t.term").alias("term"), "doc_id", "dlq", ((F.col("i") + 1) if simple else F.col("t.pos")).alias("pos")).where(ok)
        tf = F.count(F.lit(1)).alias("tf")
        return own.groupBy(*by).agg(tf, F.array_sort(F.collect_list("pos")).alias("positions")) if positions else own.groupBy(*by).agg(tf)

    def field(self, name: str) -> int:
        try:
            return self.spec.names.index(name)
        except ValueError:
            raise QuillError(f"field {name!r} does not exist") from None

    def persist(self) -> Index:
        """Cache the tables, as a warm-up; returns itself."""
        self.docs = self.lengths = self.docs.persist()
        self.postings.persist()
        self.tokens = self.holding = self.vectors = None
        self.__dict__.pop("terms", None)
        return self

    def prewarm(self) -> int:
        """Cache the tables and return how many rows they hold."""
        self.persist()
        return self.docs.count() + self.postings.count()

    def without(self, dead: DataFrame) -> Index:
        """The index without the documents of dead(doc_id): a filter until the next compaction, with live statistics."""
        gone = dead.select("doc_id").distinct()
        live = lambda df: df.join(gone, "doc_id", "left_anti")
        return Index(self.spec, live(self.docs), live(self.postings), self.documents, live(self.lengths), self.tokens and live(self.tokens))

    def plus(self, other: Index) -> Index:
        """Both indexes as one. Their documents are distinct."""
        documents = self.documents.unionByName(other.documents) if self.documents is not None and other.documents is not None else None
        return Index(self.spec, self.docs.unionByName(other.docs), self.postings.unionByName(other.postings), documents, self.lengths.unionByName(other.lengths), self.tokens and other.tokens and self.tokens.unionByName(other.tokens))

    def append(self, df: DataFrame) -> Index:
        """More documents, visible at once. A document whose id exists already is replaced."""
        new = build_index(df, self.spec)
        return self.without(df.select(F.col(self.spec.id_col).alias("doc_id"))).plus(new)

    def delete(self, ids: DataFrame) -> Index:
        return self.without(ids.select(F.col(ids.columns[0]).alias("doc_id")))

    def update(self, df: DataFrame) -> Index:
        return self.append(df)


#: Stored bytes a core up to which a table is dealt to all cores before it is analysed: its files may have few row groups.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """A small table, dealt to all cores by its id, which also keeps a document's postings together. A large one has row groups
    enough and stays where it lies: its texts would cost more to move than the terms of a query."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, F.col(id_col)) if size <= SPREAD_BYTES * cores else df


def build_index(df: DataFrame, spec: IndexSpec) -> Index:
    """Analyse every row of df. Rows without a term are not counted as documents. An id stands in one row.

    A document's postings are made where its text lies, without a shuffle."""
    part = ["part"] if spec.partition_by is not None else []
    dl = F.size("tokens").cast("long")

    def sized(df: DataFrame) -> DataFrame:
        return analysed(df, spec).select("doc_id", *part, "field_idx", dl.alias("dl"), quantised_length_col(dl).alias("dlq"), "tokens")

    own = spread(df, spec.id_col)
    tokens = sized(own)
    lengths = tokens.drop("tokens")
    own_tokens = tokens.drop("dl")
    kinds = StructType([f for f in own_tokens.schema if f.name != "tokens"])
    cells = own_tokens.mapInArrow(analysis.postings_of_rows, StructType([*kinds, StructField("ps", _parse_datatype_string(analysis.POSTINGS))]))
    postings = own_tokens.mapInArrow(analysis.postings_rows, StructType([*kinds, *_parse_datatype_string(analysis.POSTING)]))
    postings = postings.select(*part, "field_idx", "term", "doc_id", "dlq", "tf", "positions")
    index = Index(spec, lengths.where("dl > 0"), postings, df, lengths, tokens)
    index.vectors = cells
    if spec.text_config == "simple" and all(spec.format(n) == "plain" for n in spec.names):
        index.holding = lambda words: sized(own.where(_holds(own, spec, words)))
    return index


def _holds(df: DataFrame, spec: IndexSpec, words: list[str]) -> Column:
    """Does a field's text hold one of the words as a string?"""
    texts = [F.lower(text_of(df, spec, n)) for n in spec.names]
    return F.coalesce(reduce(or_, [F.coalesce(t.contains(w), F.lit(False)) for t in texts for w in words]), F.lit(False))


def build_inherited(parent: DataFrame, children: list[DataFrame], spec: IndexSpec) -> Index:
    """One index over a table and tables that inherit from it. Columns are matched by name, in any order; those of a child that
    the parent has not are left out, and each child must have the parent's."""
    out = parent
    for c in children:
        lacking = [n for n in parent.columns if n not in c.columns]
        if lacking:
            raise QuillError(f"a child has no column {', '.join(lacking)}")
        out = out.unionByName(c.select(*parent.columns))
    return build_index(out, spec)


class IndexCatalog:
    """Indexes by name or schema.name; names fold to lower case unless quoted."""

    def __init__(self):
        self._indexes: dict[str, Index] = {}

    @staticmethod
    def key(name: str) -> str:
        parts, at = [], 0
        while at <= len(name):
            if name[at : at + 1] == '"':
                end = at + 1
                while True:
                    end = name.find('"', end)
                    if end < 0:
                        raise QuillError(f"malformed name {name!r}")
                    if name[end : end + 2] == '""':
                        end += 2
                        continue
                    break
                parts.append(name[at + 1 : end].replace('""', '"'))
                at = end + 1
            else:
                end = name.find(".", at)
                end = len(name) if end < 0 else end
                parts.append(name[at:end].lower())
                at = end
            if at < len(name) and name[at] != ".":
                raise QuillError(f"malformed name {name!r}")
            at += 1
        if not all(parts) or len(parts) > 2:
            raise QuillError(f"malformed name {name!r}")
        return "\0".join(parts)

    def add(self, index: Index, name: str | None = None) -> Index:
        key = self.key(name or index.spec.name)
        if key in self._indexes:
            raise QuillError(f"index {name or index.spec.name!r} exists already")
        self._indexes[key] = index
        return index

    def replace(self, index: Index, name: str | None = None) -> Index:
        self._indexes[self.key(name or index.spec.name)] = index
        return index

    def get(self, name: str) -> Index:
        from ..errors import UnknownIndexError

        key = self.key(name)
        if key in self._indexes:
            return self._indexes[key]
        found = [v for k, v in self._indexes.items() if k.split("\0")[-1] == key] if "\0" not in key else []
        if len(found) != 1:
            raise UnknownIndexError(f"index {name!r} does not exist" if not found else f"index {name!r} is ambiguous")
        return found[0]

    def drop(self, name: str) -> None:
        self.get(name)
        key = self.key(name)
        self._indexes = {k: v for k, v in self._indexes.items() if k != key and not ("\0" not in key and k.split("\0")[-1] == key)}

    def find(self, fields: list[str]) -> Index:
        """The index whose fields are these, in this order; partial indexes are only used by name."""
        from ..errors import UnknownIndexError

        same = [x for x in self._indexes.values() if x.spec.names == fields]
        whole = [x for x in same if x.spec.where is None]
        if not whole:
            raise UnknownIndexError(f"{'only partial indexes' if same else 'no index'} on ({', '.join(fields)})" + ("; name one" if same else ""))
        return whole[0]
