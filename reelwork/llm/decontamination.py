"""Benchmark passages in training documents, found by spaced seeds. DataFrame functions only.

A seed is a fixed mask over consecutive words that ignores some positions; its hash stays equal
when the ignored words are substituted. The masks below are complete: wherever a fifth of an item's
words, or fewer, are substituted or cut off, some seed of it is left whole (the tests show it for
every length). Seeds of documents and benchmark items are joined on their hashes; the diagonals of
the hits of one document and item are made distinct, the whole item is laid over the document at
each of them, and its equal words are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stage, table

#: Shortest and longest item (in words) that a mask serves, and the offsets of the words it reads.
#: Items under five words allow no substitution.
MASKS = [
    (1, 1, (0,)), (2, 2, (0, 1)), (3, 3, (0, 1, 2)), (4, 4, (0, 1, 2, 3)),
    (5, 11, (0, 1, 2)), (5, 11, (0, 1, 3)),
    (12, 1 << 30, (0, 1, 2, 4, 5)), (12, 1 << 30, (0, 1, 2, 3, 4)),
]
#: Up to so many places of benchmark seeds are broadcast (some 20 MB); more are joined by shuffle.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits. An empty or null text has one word, an empty one."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _seeds(rows: DataFrame, tokens: str, masks: list[int]) -> DataFrame:
    """All columns of ``rows``, and _m (place in MASKS), _at, _h and _whole for each place of each of
    the masks.

    A place too near the end for its mask isn't whole: its hash is of fewer words and equals no
    whole seed. It is never null, so that joins on it need no null check that hashes once more.
    """
    n, k = F.size(tokens), len(masks)
    one = rows.select("*", F.explode(F.sequence(F.lit(0), k * n - 1)).alias("_i")).withColumn("_at", (F.col("_i") / k).cast("int"))
    word = lambda o: F.get(F.col(tokens), F.col("_at") + o)
    m, h, end = [F.lit(x) for x in masks], [F.xxhash64(F.lit(x), *[word(o) for o in MASKS[x][2]]) for x in masks], [F.lit(MASKS[x][2][-1]) for x in masks]
    of = [c[-1] for c in (m, h, end)]
    for i in range(k - 1):
        of = [F.when(F.col("_i") % k == i, c[i]).otherwise(o) for c, o in zip((m, h, end), of, strict=True)]
    return one.select("*", of[0].alias("_m"), of[1].alias("_h"), (F.col("_at") + of[2] < n).alias("_whole"))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, size, text): rows that are equal in the first three hold one text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.octet_length(text).alias("size"), text.alias("text"))


def _equal_words(diagonal: Column) -> Column:
    """How many words are equal where the item is laid over the document at a diagonal."""
    start = F.greatest(diagonal, F.lit(0))
    skip = start - diagonal
    n = F.least(F.size("item_words") - skip, F.size("doc_words") - start)
    equal = F.zip_with(F.slice("doc_words", start + 1, n), F.slice("item_words", skip + 1, n), lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(equal, F.lit(0), lambda a, b: a + b)


def _matches(docs: DataFrame, benchmark: DataFrame, least: float, least_words: int) -> DataFrame:
    """(doc_id, th, size, item_id, matched, n_words, back) for each text and item that it holds; back
    is the best diagonal with its sign changed."""
    item = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("item_words"))
    item = item.where((F.size("item_words") >= least_words) & (F.col("item_words")[0] != "")).groupBy("item_words").agg(F.min("item_id").alias("item_id"))
    items = stage(item.withColumn("n_item", F.size("item_words")), "benchmark")
    long = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high, _) in enumerate(MASKS)])
    used = items.select("n_item", F.explode(long).alias("m")).where("n_item between m.low and m.high").select("m.i").distinct()
    masks = sorted(r["i"] for r in used.collect())  # at most as many as MASKS
    low, high = (F.element_at(F.array(*[F.lit(x[k]) for x in MASKS]), F.col("_m") + 1) for k in (0, 1))
    own = _seeds(items, "item_words", masks or [0]).where(F.col("_whole") & F.col("n_item").between(low, high))
    seeds = stage(own.groupBy("_h", "item_id", "n_item").agg(F.collect_set("_at").alias("ats")), "seeds")
    few = (seeds.agg(F.sum(F.size("ats"))).first()[0] or 0) <= MOST_BROADCAST
    sent = F.broadcast if few else lambda df: df

    text = ["doc_id", "th", "size"]
    pair = [*text, "item_id"]
    read = _texts(docs).select(*text, words(F.col("text")).alias("doc_words"))
    # Only hashes and places leave a text, as a benchmark too large to be sent is joined by shuffle;
    # Spark puts a Bloom filter of its hashes before that where the documents are large.
    laid_out = _seeds(read.withColumn("n_doc", F.size("doc_words")), "doc_words", masks or [0]).select(*text, "n_doc", "_h", "_at")
    found = laid_out.join(sent(seeds.select("_h", "item_id", "n_item", F.size("ats").alias("n_at"))), "_h")
    places = stage(found.select(*pair, "n_item", "n_doc", "_h", "_at", "n_at"), "places")
    # Where texts repeat themselves there can be more hits than diagonals: then each diagonal is
    # tried. A pair's places are no more than the words of its text, times the masks.
    places = places.withColumn("every", F.sum("n_at").over(Window.partitionBy(*pair)) >= F.col("n_doc") + F.col("n_item"))
    each = F.when(F.col("every"), F.array(F.lit(None).cast("int"))).otherwise(F.transform("ats", lambda a: F.col("_at") - a))
    tried = places.join(sent(seeds.select("_h", "item_id", "ats")), ["_h", "item_id"]).select(*pair, "n_item", "n_doc", "every", F.explode(each).alias("d"))
    tried = tried.groupBy(*pair, "n_item", "n_doc", "every").agg(F.collect_set("d").alias("d"))
    tried = stage(tried.select(*pair, F.when(F.col("every"), F.sequence(1 - F.col("n_item"), F.col("n_doc") - 1)).otherwise(F.col("d")).alias("diagonals")), "diagonals")

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"]) & (a["size"] == b["size"])
    hit, again = tried.select(*text).distinct(), _texts(docs)
    again = again.join(hit, same(again, hit), "left_semi").groupBy(*text).agg(F.first("text").alias("text"))
    again = again.select(*[F.col(c).alias(f"_{c}") for c in text], words(F.col("text")).alias("doc_words"))
    laid = tried.join(again, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")) & (F.col("size") == F.col("_size"))).join(items, "item_id")
    best = F.array_max(F.transform("diagonals", lambda d: F.struct(_equal_words(d).alias("matched"), (-d).alias("back"))))
    laid = laid.select(*pair, F.col("n_item").alias("n_words"), best.alias("b")).where(F.col("b.matched") >= least * F.col("n_words"))
    return laid.select(*pair, "b.matched", "n_words", "b.back")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, least_words: int = 1) -> DataFrame:
    """doc_id, item_id, start (word of the document, negative if the item's beginning is cut off),
    matched, n_words (of the item) and overlap: one row per document and benchmark item that it
    holds, with the best alignment; of equal ones the first.

    With ``least`` 0.8 or more no alignment is lost, however short the item; items of fewer than
    ``least_words`` words aren't looked for. Benchmark items with equal words count as one, named by
    the smallest item_id; items without words, empty or null ones match nothing. Documents with a
    null doc_id are reported together under null; repeated rows give one result; an empty table on
    either side gives an empty result; other columns are not read.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the masks are complete for a least overlap of 0.8 to 1")
    found = _matches(docs, benchmark, least, least_words)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "back", "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.matched", "b.n_words", F.round(F.col("b.matched") / F.col("b.n_words"), 6).alias("overlap"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, least_words: int = 1) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item of least_words words or more.

    It is texts that are judged, not ids: a row without a doc_id, or whose doc_id another text also
    has, goes only for its own text. Null and empty texts stay; an empty table gives an empty
    result; all columns pass through.
    """
    th, size = fresh(docs, "_th", "_size")
    found = _matches(docs, benchmark, least, least_words).select(F.col("th").alias(th), F.col("size").alias(size)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({th: F.xxhash64(text), size: F.octet_length(text)}).join(found, [th, size], "left_anti").select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"


def _sql_seeds(source: str, tokens: str, key: str, own: bool) -> str:
    of = lambda low, high: f" where len({tokens}) between {low} and {high}" if own else ""
    places = [f"select {key}, {tokens}, {m} as mask, unnest(range(0, greatest(0, len({tokens}) - {mask[-1]}))) as p from {source}{of(low, high)}" for m, (low, high, mask) in enumerate(MASKS)]
    seed = " ".join(f"when {m} then concat_ws(' ', {', '.join(f'{tokens}[p + {o + 1}]' for o in mask)})" for m, (_, _, mask) in enumerate(MASKS))
    return f"select {key}, mask, p, case mask {seed} end as seed from ({' union all '.join(places)})"


OP4_SQL = f"""
with items as (select min(item_id) as item_id, item_words from (select item_id, {_WORDS} as item_words from benchmark) where item_words[1] <> '' group by item_words),
docs as (select doc_id, {_WORDS} as doc_words from documents),
item_seeds as ({_sql_seeds('items', 'item_words', 'item_id', True)}),
doc_seeds as ({_sql_seeds('docs', 'doc_words', 'doc_id', False)}),
hits as (select distinct d.doc_id, i.item_id, cast(d.p - i.p as integer) as diagonal from doc_seeds d join item_seeds i on d.mask = i.mask and d.seed = i.seed),
counted as (
  select h.doc_id, h.item_id, h.diagonal, len(i.item_words) as n_words,
    len(list_filter(range(0, len(i.item_words)), lambda k: h.diagonal + k >= 0 and d.doc_words[h.diagonal + k + 1] = i.item_words[k + 1])) as matched
  from hits h join items i on h.item_id = i.item_id join docs d on h.doc_id = d.doc_id
)
select doc_id, item_id, cast(diagonal as integer) as start, cast(matched as integer) as matched, cast(n_words as integer) as n_words, round(matched / n_words, 6) as overlap
from counted where matched >= 0.8 * n_words
qualify row_number() over (partition by doc_id, item_id order by matched desc, diagonal) = 1
"""
