"""Benchmark decontamination by spaced-seed hashing (DataFrame operations only).

A mask such as 1101011 covers a run of words and ignores those at its zeros, so a passage with a few words replaced still
shares seeds with its source at the places where the replaced words fall on zeros. The seeds of the benchmark are joined
to the seeds of every position of every document; hits of one diagonal become one place, and there the two texts are laid
over each other and the overlap is verified word by word. The masks are chosen so that every overlap leaves a seed.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, table

#: Share of the words of a run that must agree along one diagonal.
OVERLAP = 0.8
#: Least item words of a quoted part, most words by which a neighbouring diagonal may be off, its least run of agreeing words.
PART, SHIFT, RUN = 13, 2, 3
#: Windows of PART to MOST words suffice: a longer one can be cut into such, one of which agrees as much as the whole.
MOST = 2 * PART - 1
#: Most seeds (24 bytes each) and most bytes of item texts that are broadcast; beyond, the joins shuffle.
SEED_ROWS, ITEM_BYTES = 2_000_000, 32 << 20
#: Diagonals that begin in so many words of a document are verified together.
SPAN = 8192


def _words(text):
    """Words in lower case, white space removed."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def _seeds(hashes, size, mask: str, number: int):
    """array<struct<at, seed>>: the hash of the words under the mask at each position."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    places = F.when(size >= len(mask), F.sequence(F.lit(0), size - len(mask))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(number), *[F.get(hashes, i + j) for j in ones]).alias("seed")))


def _all_seeds(df: DataFrame, masks: tuple[str, ...], only: tuple[str, ...] | None = None) -> DataFrame:
    """Seeds of the masks, or of some of them under the numbers they have among all."""
    # the outer transform binds the hashes to a variable: a plain column would be inlined and hashed anew at every position
    hashes = F.array(F.transform("words", lambda w: F.xxhash64(w)))
    seeds = F.transform(hashes, lambda h: F.concat(*[_seeds(h, F.size(h), m, k) for k, m in enumerate(masks) if only is None or m in only]))
    return df.withColumn("seeds", F.element_at(seeds, 1))


def part_masks(n: int) -> tuple[str, ...]:
    """Masks for items of n words: each way to replace words within OVERLAP leaves a seed of one of them.

    Up to 12 words that holds for the whole item, beyond for every window of PART to MOST words.
    """
    if n < 4:
        return ("1" * n,)
    return ("1111", "1110111", *{5: ("11011", "11101", "10111"), 6: ("111011", "110111"), 10: ("1110110111",)}.get(n, ()))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(text_col)).alias("item")).where("item_id is not null and size(item) > 0").distinct()


def _places(known: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, start), distinct: diagonals that hold a seed. known: (doc_id, words); no text is carried."""
    spark = known.sparkSession
    lengths = [r[0] for r in items.select(F.least(F.size("item"), F.lit(MOST)).alias("n")).distinct().collect()]  # at most MOST numbers
    of = {n: part_masks(n) for n in sorted(lengths)}
    masks = tuple(dict.fromkeys(m for n in of for m in of[n])) or ("1",)
    test = None
    for n, mine in of.items():
        some = items.where(F.least(F.size("item"), F.lit(MOST)) == n).withColumnRenamed("item", "words")
        some = _all_seeds(some, masks, mine).select("item_id", F.size("words").alias("n_item"), F.explode("seeds").alias("s")).select("item_id", "n_item", F.col("s.at").alias("item_at"), "s.seed")
        test = some if test is None else test.unionByName(some)
    if test is None:
        test = items.select("item_id", F.size("item").alias("n_item"), F.lit(0).alias("item_at"), F.lit(0).cast("long").alias("seed"))
    test = saved(spark, test.distinct(), "decon-seeds")
    # outer: an inner explode would be given a filter that computes all seeds a second time
    seeded = _all_seeds(known, masks).select("doc_id", F.explode_outer("seeds").alias("s")).select("doc_id", F.col("s.at").alias("at"), "s.seed")
    hits = seeded.join(F.broadcast(test) if test.count() <= SEED_ROWS else test, "seed")
    return saved(spark, hits.select("doc_id", "item_id", "n_item", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "decon-places")


def _laid(known: DataFrame, items: DataFrame, places: DataFrame, item_bytes: int) -> DataFrame:
    """Places with the item's words and the document's words beside them: piece begins at the document's word `first`."""
    near = places.groupBy("doc_id", F.floor(F.col("start") / SPAN).alias("span")).agg(F.collect_list(F.struct("item_id", "n_item", "start")).alias("at")).drop("span")
    joined = known.join(F.broadcast(near) if places.count() <= BROADCAST_ROWS else near, "doc_id")
    first = lambda x: F.greatest(x["start"] - SHIFT, F.lit(0))
    piece = lambda w, x: F.slice(w, first(x) + 1, F.greatest(x["start"] + x["n_item"] + SHIFT - first(x), F.lit(0)))
    # the words are bound to a variable: a plain column would be split anew for every place
    cut = F.transform(F.array("words"), lambda w: F.transform("at", lambda x: F.struct(x["item_id"].alias("item_id"), x["start"].alias("start"), first(x).alias("first"), piece(w, x).alias("piece"))))
    # outer: see above
    out = joined.select("doc_id", F.explode_outer(F.element_at(cut, 1)).alias("x")).select("doc_id", "x.item_id", "x.start", "x.first", "x.piece")
    return out.join(F.broadcast(items) if item_bytes <= ITEM_BYTES else items, "item_id")


def _agree(shift: int):
    """array<boolean> over the item's words: the document has the word at its place on the diagonal `shift` words on. Off the
    diagonal itself only runs of RUN agreeing words count."""
    begin = F.col("start") - F.col("first") + shift
    one = F.transform("item", lambda w, j: F.coalesce(F.when(begin + j >= 0, F.get("piece", begin + j) == w), F.lit(False)))
    if not shift:
        return one
    at = lambda m, j: F.coalesce(F.when(j >= 0, F.get(m, j)), F.lit(False))
    covers = lambda m, i, b: reduce(and_, [at(m, i + b + k) for k in range(RUN)])
    inside = lambda m: F.transform(m, lambda _, i: reduce(or_, [covers(m, i, -b) for b in range(RUN)]))
    return F.element_at(F.transform(F.array(one), inside), 1)


def _holds(same):
    """Whether of some run of least(PART, the item's) words or more OVERLAP agree; same: array<boolean>."""
    least = F.least(F.size("item"), F.lit(PART))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(False).alias("ok"))

    def step(x, w):
        n, k = x["n"] + 1, x["k"] + w.cast("int")
        return F.struct(n.alias("n"), k.alias("k"), (x["ok"] | ((n >= least) & (k >= F.lit(OVERLAP) * n))).alias("ok"))

    # bound to a variable by the outer exists: a plain column would be computed anew for every window
    fits = lambda m: F.exists(F.sequence(F.lit(1), F.size(m)), lambda i: F.aggregate(F.slice(m, i, F.lit(MOST)), state, step)["ok"])
    return F.exists(F.array(same), fits)


def _candidates(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    items = saved(docs.sparkSession, _items(benchmark, item_col, item_text_col), "decon-items")
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))
    size = items.agg(F.sum(F.octet_length(F.array_join("item", " ")))).first()[0] or 0
    return _laid(known, items, _places(known, items), size)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, at, n_item, n_same): verified overlaps; at is the document's word where the item would begin.

    The two texts are laid over each other along a diagonal; of some run of PART item words or more (of the whole item, if it
    is shorter) OVERLAP must agree. n_same of the item's n_item words agree in all on that diagonal. Words that lie outside
    the document do not agree. The masks leave a seed in every such overlap, so none is lost: the result is that of a
    comparison along all diagonals. Several places of one pair are all listed. Null and empty texts and items are in no
    overlap. Rows that repeat an id, of documents or items, count as one. Rows without an id are left out.
    """
    found = _candidates(docs, benchmark, id_col, text_col, item_col, item_text_col).withColumn("same", _agree(0))
    found = found.where(_holds(F.col("same")))
    return found.select("doc_id", "item_id", F.col("start").alias("at"), F.size("item").alias("n_item"), F.size(F.filter("same", lambda x: x)).alias("n_same")).distinct()


def quoted(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold an item or a part of it, also with words inserted or left out.

    As overlaps, but a word also agrees if the document has it in a run of RUN agreeing words on a diagonal at most SHIFT
    away from the hit's.
    """
    found = _candidates(docs, benchmark, id_col, text_col, item_col, item_text_col)
    lanes = [_agree(s) for s in range(-SHIFT, SHIFT + 1)]
    same = reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a | b), lanes)
    return found.where(_holds(same)).select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_items, item_ids): the documents that hold an item or a part of it (see quoted), and which."""
    found = quoted(docs, benchmark, **options)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no item and no part of one (see quoted). Rows without an id, with a null or
    empty text stay; rows that repeat an id go together."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__id"))
    return docs.join(bad, docs[id_col] == bad["__id"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified overlap of a benchmark item and a document."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("at").cast("long").alias("start_word"), F.col("n_item").cast("long").alias("n_item"), F.col("n_same").cast("long").alias("n_same"))


# Along all diagonals, without seeds: equal words vote for their diagonal.
def _sql() -> str:
    def split(name: str, key: str) -> str:
        words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
        return f"{name}_w AS (SELECT {key}, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n FROM (SELECT {key}, {words} AS w FROM {name}))"

    return f"""
WITH {split('documents', 'doc_id')}, {split('benchmark', 'item_id')},
m AS (SELECT doc_id, item_id, d.p - b.p AS start, b.p AS p, b.n AS n FROM documents_w d JOIN benchmark_w b USING (word)),
c AS (SELECT doc_id, item_id, start, n, count(*) AS n_same FROM m GROUP BY ALL HAVING count(*) >= {OVERLAP} * least(any_value(n), {PART})),
r AS (SELECT m.*, c.n_same, row_number() OVER (PARTITION BY doc_id, item_id, start ORDER BY p) AS k FROM m JOIN c USING (doc_id, item_id, start, n)),
h AS (SELECT DISTINCT a.doc_id, a.item_id, a.start, a.n, a.n_same FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.start = b.start
      AND b.p >= a.p AND b.k - a.k + 1 >= {OVERLAP} * greatest(b.p - a.p + 1, least(a.n, {PART})))
SELECT doc_id, item_id, start::BIGINT AS start_word, n::BIGINT AS n_item, n_same::BIGINT AS n_same FROM h
"""


SQL5 = _sql()
