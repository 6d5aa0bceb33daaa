"""Source divergence audit: how far the word use of each source lies from its language and from the other sources.

Terms are counted per (lang, source) group.  Each language keeps the terms of
enough of its documents; a group's share of a kept term is a smoothed integer
(parts per ``SCALE``), so that everything after the counting is exact.

The terms that stand out most in a group are found by a *dominance skyband*.
Of two terms of a group, one dominates the other if its count in the group is
not lower, its count in the language not higher and its UTF-8 form earlier.
The dominating term has no smaller excess of share over the language, and goes
first among equal ones; so a term that k others dominate cannot be among the
first k.  Every partition of terms retains, per group, those that fewer than k
of its terms dominate (its k-skyband); skybands are merged by group in salted
parts, again to skybands, and what is left is ranked exactly.

Sources of a language are compared in blocks of terms: a task holds the shares
of all its sources for one block as a dense matrix of bounded size and adds up
absolute differences per pair of sources, so that only sums leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import stage
from .textblocks import LOWER, Words, laid_out, slices

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
# Cells (terms x sources) of one dense block of shares: 16 MB.
BLOCK_CELLS = 1 << 21
# Entries a counting task holds before it hands them on, and rows a skyband task gathers before it thins them out.
HELD_TERMS = 1 << 18
HELD_ROWS = 1 << 16
# Parts of a group's terms in which partial skybands are merged.
SALTS = 32

_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
U = np.uint64


class Terms(Words):
    """Runs of letters and of characters beyond ASCII."""

    table = _TERM


# ------------------------------------------------------------------ counting

class _Tally:
    """Occurrences and documents per (group, term) of one task, handed on when there are many."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[pd.DataFrame] = []
        self.held = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> None:
        low = LOWER[data]
        terms = Terms(low, offsets)
        if not len(terms):
            return
        row, keys = terms.rows(), terms.hashes()
        order = np.lexsort((row, keys))
        row, keys = row[order], keys[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        new_doc = new_key | np.append(True, row[1:] != row[:-1])
        # One entry per (term, row); then per (term, group).
        at = np.flatnonzero(new_doc)
        n = np.diff(np.append(at, len(keys)))
        group, code = groups[row[at]], (np.cumsum(new_key) - 1)[at]
        first = order[np.flatnonzero(new_key)]
        raw = low.tobytes()
        words = np.array([raw[a:b] for a, b in zip(terms.lo[first].tolist(), terms.hi[first].tolist(), strict=True)], object)
        pair = code.astype(np.int64) * (int(groups.max()) + 1) + group
        uniq, inverse = np.unique(pair, return_inverse=True)
        self.parts.append(pd.DataFrame({
            "group": uniq % (int(groups.max()) + 1), "term": words[uniq // (int(groups.max()) + 1)],
            "n": np.bincount(inverse, weights=n).astype(np.int64), "docs": np.bincount(inverse).astype(np.int64)}))
        self.held += len(uniq)

    def merged(self) -> pd.DataFrame:
        table = pd.concat(self.parts).groupby(["group", "term"], sort=False, as_index=False).sum()
        self.parts, self.held = [table], len(table)
        return table

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        table = self.merged()
        names = np.array([*self.groups], object)
        group = table["group"].to_numpy()
        yield pa.record_batch([pa.array(names[group, 0], pa.string()), pa.array(names[group, 1], pa.string()),
                               pa.array([t.decode() for t in table["term"]], pa.string()),
                               pa.array(table["n"].to_numpy()), pa.array(table["docs"].to_numpy())],
                              names=["lang", "source", "term", "n", "docs"])
        self.parts, self.held = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        group = np.array([tally.groups.setdefault(x, len(tally.groups)) for x in names], np.int64)
        data, offsets = laid_out(batch.column(2))
        for i, j in slices(offsets):
            tally.add(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], group[i:j])
            if tally.held > HELD_TERMS:
                tally.merged()
                if tally.held > HELD_TERMS // 2:
                    yield from tally.out()
    yield from tally.out()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Staged (lang, source, term, n, l, lead): counts of kept terms in groups that have them, and in the language.

    lead marks one row of each (lang, term).  Counts arrive summed per task, are
    dealt by (lang, term) once, and are summed by group and by language there.
    """
    raw = docs.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    # AQE may not split or join these partitions: the sums by group and by language share them.
    dealt = raw.repartition(F.col("lang"), F.col("term"))
    per = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    per = per.select("lang", "source", "term", "n", F.sum("n").over(w).alias("l"), F.sum("docs").over(w).alias("df"),
                     (F.min("source").over(w) == F.col("source")).alias("lead"))
    return stage(per.where(F.col("df") >= min_docs).drop("df"), "kept-terms")


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * v)), in decimals wide enough for any long."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, below = F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + SMOOTHING), wide(total) + SMOOTHING * wide(v)
    # Rows without a kept term in their language have nothing to divide by, and no share that is used.
    return F.when(below > 0, F.expr("1L") + F.call_function("div", top, below))


# ------------------------------------------------------------------ skyband

def skyband(g: np.ndarray, low: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that fewer than ``k`` others dominate; ``term``: ranks in UTF-8 order, all different.

    Rows are taken so that those that dominate a row come before it.  It is enough
    to count among rows already retained: if k rows dominate one, the first k of
    them have fewer than k above themselves.
    """
    order = np.lexsort((term, low, -g))
    # Among equal counts only the first k in UTF-8 order can stay.
    gs, ls = g[order], low[order]
    new = np.append(True, (gs[1:] != gs[:-1]) | (ls[1:] != ls[:-1])) if len(order) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    order = order[np.arange(len(order)) - start < k]
    ls, ts = low[order], term[order]
    keep_l, keep_t = np.empty(len(order), ls.dtype), np.empty(len(order), ts.dtype)
    kept, n = [], 0
    for i in range(len(order)):
        # Retained rows come first in the order, so their group count is not lower.
        if n < k or np.count_nonzero((keep_l[:n] <= ls[i]) & (keep_t[:n] < ts[i])) < k:
            keep_l[n], keep_t[n] = ls[i], ts[i]
            kept.append(i)
            n += 1
    return order[kept]


def _thin(table: pa.Table, k: int) -> pa.Table:
    """The k-skyband of each (lang, source) of a table (lang, source, term, n, l, value)."""
    if not table.num_rows:
        return table
    codes = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
    lang, source = (c.indices.to_numpy().astype(np.int64) for c in codes)
    group = lang * len(codes[1].dictionary) + source
    # Arrow compares strings by their UTF-8 bytes.
    rank = np.empty(table.num_rows, np.int64)
    rank[pc.sort_indices(table.column("term")).to_numpy()] = np.arange(table.num_rows)
    g, low = table.column("n").to_numpy(), table.column("l").to_numpy()
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    take = []
    for rows in np.split(order, cut[1:]):
        take.append(rows[skyband(g[rows], low[rows], rank[rows], k)])
    return table.take(pa.array(np.concatenate(take)))


def partial_skybands(rows: DataFrame, k: int) -> DataFrame:
    """What each partition of ``rows`` (lang, source, term, n, l, value) retains; memory is bounded by its skybands."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, HELD_ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > limit:
                held = _thin(pa.Table.from_batches(held), k).combine_chunks().to_batches()
                n = sum(b.num_rows for b in held)
                limit = max(HELD_ROWS, 2 * n)
        if held:
            yield from _thin(pa.Table.from_batches(held), k).to_batches()

    return rows.mapInArrow(work, rows.schema)


def standing_out(rows: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the first ``top`` terms of each group by value and UTF-8.

    ``rows`` (lang, source, term, n, l, value) hold the terms whose share in the group is
    above that in the language.  A term dominated by one of these is dominated in the whole
    group as well, and what dominates one of these is among them.
    """
    local = partial_skybands(rows, top)
    merged = partial_skybands(local.repartition(F.col("lang"), F.col("source"), F.pmod(F.xxhash64("term"), F.lit(SALTS))), top)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("term"))
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


# ------------------------------------------------------------- pairs of sources

def _distances(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of absolute share differences over the terms of one block, per pair a < b of the language's sources.

    left: (lang, block, source, term, p) of groups that have the term; right: (lang, block, source, zero), the
    share that each source gives terms it lacks.
    """
    lang, names = right.column("lang")[0].as_py(), np.array(right.column("source").to_pylist(), object)
    zero = right.column("zero").to_numpy()
    order = np.argsort(names)
    names, zero = names[order], zero[order]
    place = {s: i for i, s in enumerate(names.tolist())}
    term = left.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(zero[:, None], len(term.dictionary), axis=1)
    shares[[place[s] for s in left.column("source").to_pylist()], term.indices.to_numpy()] = left.column("p").to_numpy()
    a, b, d = [], [], []
    for i in range(len(names) - 1):
        a.append(np.full(len(names) - 1 - i, i))
        b.append(np.arange(i + 1, len(names)))
        d.append(np.abs(shares[i + 1:] - shares[i]).sum(axis=1))
    a, b = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (a, b))
    d = np.concatenate([np.empty(0, np.int64), *d]).astype(np.int64)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(names[a], pa.string()),
                     "b": pa.array(names[b], pa.string()), "d": pa.array(d)})


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each group from every other source of its language.

    kept (lang, source, term, p); groups (lang, source, zero, v, n_sources).  Blocks per language follow from its
    terms and sources, so that a block has about ``BLOCK_CELLS`` cells.  Pairs of languages without kept terms are 0.
    """
    langs = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n_sources"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("n_sources") / BLOCK_CELLS)).cast("int")
    langs = langs.select("lang", blocks.alias("n_blocks"))
    cells = kept.join(langs, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("n_blocks")).cast("int").alias("block"), "source", "term", "p")
    sides = groups.where(F.col("v") > 0).join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "source", "zero")
    part = cells.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(
        _distances, "lang string, a string, b string, d bigint")
    total = part.groupBy("lang", "a", "b").agg(F.sum("d").alias("d"))
    both = total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "d").unionByName(
        total.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "d"))
    # Languages without a kept term have no block; their pairs are rows of the result all the same.
    bare = groups.where(F.col("v") == 0).select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    return both.withColumnRenamed("d", "value").unionByName(bare.withColumn("value", F.lit(0).cast("bigint")))


# ------------------------------------------------------------------ audit

def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) over all rows of ``docs``; other columns are not read.

    Part ``pair`` ranks, per group, the other sources of its language by distance; part
    ``term`` its ``top`` terms by excess over the language.  Ties go by UTF-8.  Null
    texts, languages and sources count as empty strings; repeated rows are documents of
    their own.  A group without terms takes part in pairs; the only source of a
    language has none; an empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = kept_terms(rows, min_docs)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum(F.when(F.col("lead"), F.col("l"))).alias("lang_total"),
                                     F.count_if("lead").alias("v"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    groups = stage(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
                   .join(langs, "lang", "left").select("lang", "source", number("total"), number("lang_total"), number("v"))
                   .withColumn("zero", _share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    shared = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "l", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _share(F.col("l"), F.col("lang_total"), F.col("v")).alias("q"))
    above = shared.where(F.col("p") > F.col("q")).select("lang", "source", "term", "n", "l", (F.col("p") - F.col("q")).alias("value"))
    terms = standing_out(above, top).withColumn("part", F.lit("term"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = source_pairs(shared.select("lang", "source", "term", "p"), groups)
    pairs = pairs.withColumns({"rank": F.row_number().over(by_value), "part": F.lit("pair")})
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
x AS (SELECT i, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
l AS (SELECT lang, term, count(*) AS l FROM x GROUP BY ALL HAVING count(DISTINCT i) >= 30),
lt AS (SELECT lang, sum(l)::BIGINT AS n, count(*) AS v FROM l GROUP BY lang),
g AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN l USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS n FROM grp LEFT JOIN g USING (lang, source) GROUP BY ALL),
dense AS (SELECT gt.lang, gt.source, l.term, coalesce(g.n, 0) AS c,
    (1 + (1000000000::HUGEINT * (coalesce(g.n, 0) + 5)) // (gt.n + 5 * lt.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (l.l + 5)) // (lt.n + 5 * lt.v))::BIGINT AS q
  FROM gt JOIN lt USING (lang) JOIN l USING (lang) LEFT JOIN g ON g.lang = gt.lang AND g.source = gt.source AND g.term = l.term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(dist.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM dense WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
