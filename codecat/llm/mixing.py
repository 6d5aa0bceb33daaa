"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source is cut into ``BLOCKS`` blocks of documents by a keyed hash.  Its
target gives a number of whole passes over the source and a rest; the rest is
filled with blocks in a permuted order, the last of them up to the word.  Each
pass over a block is a draw, so the quota of draws of every source is exact.
The tree divides these quotas among the output shards: at each node a
multivariate-hypergeometric draw says how many of each source's draws go to the
left half of the shards, given how many go there in all.  The permuted draws of
a source then fill its leaves in turn, so the blocks of shards are disjoint, and
a keyed order shuffles the documents of each shard.

Only counts pass through the tree: a row for each node, with an array of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import stage

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE, MOST_PASSES = 1.5, 2
BLOCKS = 1024
SHARDS = 16
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _hash(*parts: Column | str) -> Column:
    """60 bits of a keyed hash; equal in any engine."""
    texts = [F.lit(SEED), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("bigint")


def row_key(docs: DataFrame, columns: list[str]) -> Column:
    """Equal for rows that repeat in these columns, and but for chance only for them."""
    def plain(c: str) -> Column:  # hashes skip nulls, and take no maps
        col = F.col(f"`{c}`")
        return F.to_json(F.struct(col)) if "map<" in docs.schema[c].dataType.simpleString() else col
    nulls = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in columns))
    return F.xxhash64(nulls, *map(plain, columns))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, target) from (source, size): one row per source.

    Sources by code point, null last, weigh ``WEIGHTS`` in turn and share
    ``TOTAL_SHARE`` of all words; a target stops at ``MOST_PASSES`` times its source, and
    the excess goes to the others by weight until none is above.  Sorted by cap over
    weight, the stopped sources come first, so running sums find the common level.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("source_no", F.row_number().over(by_name))
    out = out.withColumns({
        "weight": F.get(weights, F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS)))),
        "cap": F.col("source_size").cast("double") * MOST_PASSES,
        "all": F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE),
    })
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    out = out.withColumn("level", level)
    out = out.withColumn("free", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))
    out = out.withColumn("common", F.max("free").over(everything))
    return out.select("source", "source_no", "source_size",
                      F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` of ``total`` are among ``drawn`` of them: the quantile at ``u``, walking the probabilities."""
    low = F.greatest(F.lit(0).cast("bigint"), drawn - (total - marked))
    high = F.least(marked, drawn)

    def ratio(k: Column) -> Column:  # log of p(k + 1) / p(k)
        up = (marked - k).cast("double") * (drawn - k)
        down = (k + 1).cast("double") * (total - marked - drawn + k + 1)
        return F.log(up) - F.log(down)

    # Sum of the probabilities relative to the largest so far, and the log of that.
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        log = s["log"] + ratio(k)
        top = F.greatest(s["top"], log)
        return F.struct(log.alias("log"), top.alias("top"), (s["sum"] * F.exp(s["top"] - top) + F.exp(log - top)).alias("sum"))

    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = F.aggregate(steps, start, add)
    goal = u * whole["sum"]

    def walk(s: Column, k: Column) -> Column:
        log = s["log"] + ratio(k)
        done = s["sum"] >= s["goal"]
        return F.struct(log.alias("log"), F.when(done, s["sum"]).otherwise(s["sum"] + F.exp(log - s["top"])).alias("sum"),
                        F.when(done, s["k"]).otherwise(k + 1).alias("k"), s["goal"].alias("goal"), s["top"].alias("top"))

    first = F.struct(F.lit(0.0).alias("log"), F.exp(-whole["top"]).alias("sum"), low.alias("k"), goal.alias("goal"), whole["top"].alias("top"))
    return F.aggregate(steps, first, walk, lambda s: s["k"])


def splitting_tree(quotas: DataFrame, n_shards: int) -> DataFrame:
    """(shard, source_no, first, quota): the draws [first, first + quota) of each source that go to each shard.

    ``quotas``: (source_no, quota).  Level by level, every node is split in two.
    """
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(
        "source_no", F.lit(0).cast("bigint").alias("first"), F.col("quota").cast("bigint").alias("quota")))).alias("held")).select(
        F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), "held")
    width = n_shards
    while width > 1:
        n_left = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        every = F.aggregate("held", F.lit(0).cast("bigint"), lambda n, x: n + x["quota"])
        go = F.when(F.col("hi") - F.col("lo") > 1, F.round(every * n_left / (F.col("hi") - F.col("lo"))).cast("bigint")).otherwise(every)

        def take(state: Column, x: Column) -> Column:
            u = (_hash(F.concat_ws("/", F.col("lo"), F.col("hi")), x["source_no"]) + 0.5) / F.lit(float(16 ** 15))
            k = _hypergeometric(state["total"], x["quota"], state["drawn"], u)
            return F.struct((state["total"] - x["quota"]).alias("total"), (state["drawn"] - k).alias("drawn"),
                            F.concat(state["left"], F.array(k)).alias("left"))

        start = F.struct(every.alias("total"), go.alias("drawn"), F.array().cast("array<bigint>").alias("left"))
        split = nodes.withColumn("left", F.aggregate("held", start, take, lambda s: s["left"]))
        # A written step would cost more than it saves: the rows are few, but each level must be computed once only.
        middle = F.col("lo") + F.greatest(n_left, F.lit(1))
        left = F.transform("held", lambda x, i: F.struct(x["source_no"].alias("source_no"), x["first"].alias("first"), F.get("left", i).alias("quota")))
        right = F.transform("held", lambda x, i: F.struct(
            x["source_no"].alias("source_no"), (x["first"] + F.get("left", i)).alias("first"), (x["quota"] - F.get("left", i)).alias("quota")))
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi"), left.alias("held")),
                         F.struct(middle.alias("lo"), F.col("hi").alias("hi"), right.alias("held")))
        nodes = split.select(F.explode_outer(halves).alias("x")).select("x.*").where(F.col("hi") > F.col("lo"))
        width = -(-width // 2)
        nodes = stage(nodes, "mix-level")
    return nodes.select(F.col("lo").alias("shard"), F.explode_outer("held").alias("x")).select("shard", "x.*").where(F.col("quota") > 0)


def mix(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        key_cols: list[str] | None = None) -> DataFrame:
    """(id, row_key, size, source, source_size, target, draws) per row of ``docs``; columns beyond these and ``key_cols``
    (id, source and text unless given, of which row_key is made) are not read.

    draws: a struct (pass, shard, words, place) for each time that the mix takes the
    document; words is its size but for the one document of a source at which the
    target is reached, and the documents of a shard go in the order of place.  Ids
    may repeat or be null; a null text has no words and is never cut, an empty
    source no target.  Null sources are a source of their own, sorted last.  The
    same rows give the same mix, however they are partitioned.  An empty table gives
    an empty result.
    """
    sized = stage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        row_key(docs, key_cols or [id_col, source_col, text_col]).alias("row_key"), _hash(id_col).alias("place")), "mix-sizes")
    sized = sized.withColumn("block", F.pmod("place", F.lit(BLOCKS)))
    sources = stage(targets(sized).withColumns({
        "quota": F.round("target").cast("bigint")}).withColumns({
            "passes": F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")})
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size")), "mix-sources")

    order = Window.partitionBy("source_no").orderBy("turn", "block")
    words = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = words.join(sources, words["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    blocks = blocks.withColumn("turn", _hash("source_no", "block"))
    blocks = blocks.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    last = F.col("passes") - F.when(F.col("before") < F.col("rest"), 0).otherwise(1)
    drawn = blocks.where(last >= 0).select("source_no", "block", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), last)).alias("pass"))
    drawn = drawn.withColumn("no", F.row_number().over(
        Window.partitionBy("source_no").orderBy(_hash("source_no", "block", "pass"), "block", "pass")) - 1)
    leaves = splitting_tree(drawn.groupBy("source_no").agg(F.count("*").alias("quota")), n_shards)
    places = leaves.select("source_no", "shard", F.explode_outer(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("no"))
    shards = drawn.join(places, ["source_no", "no"]).groupBy("source_no", "block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("given"))

    plan = blocks.select("source", "source_no", "block", "source_size", "target", "passes", "rest", "before").join(
        shards, ["source_no", "block"], "left").withColumnRenamed("source", "named").withColumnRenamed("block", "in_block")
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["named"]) & (sized["block"] == plan["in_block"])).drop("named", "in_block")
    inside = Window.partitionBy("source", "block").orderBy("place", "id", "size", "row_key")
    so_far = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rest = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("rest") - so_far))
    rows = rows.withColumn("last_words", rest)
    draws = F.filter(F.transform(F.coalesce("given", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda g: F.struct(
        g["pass"].alias("pass"), g["shard"].alias("shard"),
        F.when(g["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("last_words")).alias("words"),
        _hash(F.col("id"), g["shard"], g["pass"]).alias("place"))), lambda d: d["words"] > 0)
    return rows.select("id", "row_key", "size", "source", "source_size", "target", draws.alias("draws"))


def mixture(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with shard, place, pass and words.

    The document at which its source's target is reached is cut after that many words.
    A row keeps its own columns: only rows that are equal in all of them stand for each other.
    """
    new = ("pass", "shard", "words", "place")
    plan = mix(docs, n_shards, id_col, source_col, text_col, docs.columns).select("row_key", "size", F.explode("draws").alias("_draw"))
    keyed = docs.select(row_key(docs, docs.columns).alias("row_key"), *(F.col(f"`{c}`") for c in docs.columns if c not in new))
    rows = plan.join(keyed.dropDuplicates(["row_key"]), "row_key")
    cut = F.when(F.col("_draw.words") < F.col("size"), F.array_join(
        F.slice(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_draw.words").cast("int")), " "))
    return rows.select(*(F.coalesce(cut, F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in new),
                       *(F.col(f"_draw.{c}").alias(c) for c in new))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda n, d: n + d["words"])
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(source_no - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
  sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM s),
l AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN cap > level * weight THEN max(CASE WHEN cap > level * weight THEN level END) OVER () * weight ELSE cap END AS target FROM l),
q AS (SELECT *, round(target)::BIGINT AS quota, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
b AS (SELECT d.source, place % {BLOCKS} AS block, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
o AS (SELECT q.*, block, sum(words) OVER (PARTITION BY source_no ORDER BY
    ('0x' || substr(md5('{SEED}|' || source_no || '|' || block), 1, 15))::BIGINT, block ROWS UNBOUNDED PRECEDING) - words AS before
  FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source),
r AS (SELECT doc_id, size, source_size, target, passes, quota - passes * source_size AS rest,
  before + sum(size) OVER (PARTITION BY source_no, block ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS so_far
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.place % {BLOCKS} = o.block)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest - so_far)))::BIGINT AS taken FROM r
"""
