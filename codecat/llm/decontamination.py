"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask takes five of eight neighbouring words and ignores the other three.  The
taken words of every such window of a document are hashed and joined with those
of the benchmark items, so a hit survives substituted words.  Hits of one
document and item on the same shift are one alignment; along it, ``WINDOW``
consecutive places (or the whole item, if shorter) must agree in ``AGREE`` of
100 words at least.  With two substitutions in 13 words either mask still
hits, wherever they are.

Words are runs of letters and digits, in lower case.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 8
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
WINDOW, AGREE = 13, 84
# Largest number of benchmark seeds (24 bytes each) and of bytes of item texts that are broadcast; beyond it both sides are shuffled.
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 32 << 20


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _seeds(hashes: Column) -> Column:
    """The seeds of all windows, mask after mask; null with fewer words than the span."""
    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (SPAN - 1)), lambda i: F.xxhash64(
            F.lit(k), *(F.element_at(hashes, i + at) for at in MASKS[k])))
    return F.when(F.size(hashes) >= SPAN, F.concat(*(of(k) for k in range(len(MASKS)))))


def _seeded(rows: DataFrame) -> DataFrame:
    """A row for each seed, with the place (from 0) of its window's first word."""
    hashed = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    seeded = hashed.withColumn("n", F.size("words") - (SPAN - 1)).withColumn("seeds", _seeds(F.col("hashes")))
    # The outer form: from the inner one Spark infers a filter on the seeds, and computes all hashes anew in it for each window.
    out = seeded.select(*rows.columns, "n", F.posexplode_outer("seeds").alias("at", "seed")).where(F.col("at").isNotNull())
    return out.withColumn("at", F.pmod("at", "n")).drop("n")


def _agrees(item: Column, text: Column) -> Column:
    """Whether some stretch of the alignment agrees in enough places."""
    length = F.least(F.size(item), F.lit(WINDOW))
    equal = F.zip_with(item, text, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    need = F.ceil(length * AGREE / 100)
    return F.exists(F.sequence(F.lit(1), F.size(item) - length + 1), lambda i: F.aggregate(
        F.slice(equal, i, length), F.lit(0), lambda n, x: n + x) >= need)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, shift, n_equal): each alignment of a document with a benchmark item that agrees.

    shift: the word of the document (from 0, may be negative) at which the item's
    first word would lie; n_equal: agreeing places over the whole item.  Rows
    without an id take part under a null id; rows that repeat give one alignment.
    Documents or items that share an id, or have none, are told apart by their
    words, so an alignment of one never hides that of another.
    Null, empty and wordless texts, and texts or items under ``SPAN`` words, have
    none.  Other columns are not read.
    """
    bench = items.select(F.col(item_col).alias("item"), F.array_remove(_words(F.col(item_text_col)), "").alias("item_words"))
    bench = bench.withColumn("item_key", F.xxhash64("item", "item_words")).dropDuplicates(["item_key"])
    seeds = _seeded(bench.select("item_key", F.col("item_words").alias("words"))).select("seed", "item_key", F.col("at").alias("item_at")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    texts = texts.withColumn("text_key", F.xxhash64("id", "words"))
    if _fits(bench, seeds):
        # The words of a document stay in the task that reads it.
        hits = _seeded(texts).join(F.broadcast(seeds), "seed").withColumn("shift", F.col("at") - F.col("item_at"))
        hits = hits.join(F.broadcast(bench), "item_key")
    else:
        # Only keys and places are shuffled with the seeds; words are fetched for what hit.
        narrow = texts.select("text_key", "words").transform(_seeded).select("text_key", "seed", "at").join(seeds, "seed")
        places = narrow.select("text_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        hits = places.join(texts.dropDuplicates(["text_key"]), "text_key").join(bench, "item_key")
    # The stretch of the document beside the item; where the item begins before it, nulls stand for the missing words.
    missing = F.greatest(-F.col("shift"), F.lit(0))
    beside = F.concat(F.array_repeat(F.lit(None).cast("string"), missing),
                      F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item_words") - missing))
    # The partial step, in the task that reads the document, leaves one row of each alignment.
    aligned = hits.select("id", "item", "shift", "text_key", "item_key", "item_words", beside.alias("beside")).groupBy(
        "id", "item", "shift", "text_key", "item_key").agg(F.min(F.struct("item_words", "beside")).alias("pair"))
    good = aligned.where(_agrees(F.col("pair.item_words"), F.col("pair.beside")))
    n_equal = F.aggregate(F.zip_with("pair.item_words", "pair.beside", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")),
                          F.lit(0), lambda n, x: n + x)
    return good.select("id", "item", "shift", n_equal.alias("n_equal"))


def _fits(bench: DataFrame, seeds: DataFrame) -> bool:
    """Whether a benchmark is small enough to broadcast, by its seeds and by the bytes of its words."""
    size = F.aggregate("item_words", F.lit(0).cast("bigint"), lambda n, w: n + F.octet_length(w) + 24)
    return (bench.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES
            and seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS)


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``items``; rows with a null id are judged by their text alone."""
    marked = docs.withColumn("_key", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    found = overlaps(marked.select("_key", F.col(f"`{text_col}`").alias("text")), items, "_key", "text")
    return marked.join(found.select(F.col("id").alias("_key")).distinct(), "_key", "left_anti").select(
        *(f"`{c}`" for c in docs.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("n_equal").cast("bigint").alias("n_equal"), F.count("*").alias("n_alignments"))


def _oracle() -> str:
    def seeds(of: str, key: str, words: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, {words}, i - 1 AS at, [{k}::VARCHAR, " + ", ".join(f"{words}[i + {at}]" for at in mask)
            + f"] AS seed FROM (SELECT {key}, {words}, unnest(range(1, len({words}) - {SPAN - 2})) AS i FROM {of})"
            for k, mask in enumerate(MASKS))

    return rf"""
WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS item FROM benchmark),
ds AS ({seeds("d", "doc_id", "words")}),
bs AS ({seeds("b", "item_id", "item")}),
al AS (SELECT DISTINCT doc_id, item_id, ds.at - bs.at AS shift, words, item FROM ds JOIN bs ON ds.seed = bs.seed),
eq AS (SELECT doc_id, item_id, shift, least(len(item), {WINDOW}) AS w,
  [CASE WHEN shift + j >= 1 AND words[greatest(shift + j, 1)] = item[j] THEN 1 ELSE 0 END FOR j IN range(1, len(item) + 1)] AS e FROM al),
ok AS (SELECT doc_id, item_id, list_sum(e) AS n FROM eq
  WHERE list_max([list_sum(list_slice(e, i, i + w - 1)) FOR i IN range(1, len(e) - w + 2)]) >= ceil(w * {AGREE} / 100.0))
SELECT doc_id, item_id, max(n)::BIGINT AS n_equal, count(*)::BIGINT AS n_alignments FROM ok GROUP BY ALL
"""


ORACLE = _oracle()
