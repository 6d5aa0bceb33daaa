"""N-gram Jaccard join with a token-group matrix.

A document is its set of word 5-grams (tokens).  The join is exact for the
threshold, and gives components rather than all pairs:

1. Every token learns how often it occurs.  A document of n tokens can only be
   similar to another one if the rest of the corpus holds four fifths of them:
   with more than a fifth of its tokens unique it is a group that nobody opens.
   Most documents end here.
2. Equal sets are one class.  Classes share tokens in their prefix, the fifth of
   their tokens (and one) that is rarest; every similar pair has a common one.
   Each token has a leader, its class with the fewest unique tokens, and each class
   joins the group of its tokens' first leader; so groups hold similar documents.
   A class is compared with its leader at once, and linked if similar.
3. Groups are cut into parts of about ``PART`` classes, those linked with the leader
   apart from the others.  The token-group matrix holds the prefix tokens of whole
   parts, so parts with a common one are candidates, but for two parts that their
   leader connects already.  In a pair of parts, a query is bounded by its overlap
   with the other part's token union, and opened only if it can qualify; the links
   found leave as a spanning forest.

Tokens and classes are 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .repeats import U, buckets_for, exchange, pack, tell, told_keys, total_bytes, unpacked
from .stages import drop, stage
from .textblocks import LOWER, Words, mix, slices, windows

WORDS, PERCENT = 5, 80
PART = 128
_TOKEN_BYTES = 6


def token_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each row and their row numbers, row after row."""
    words = Words(LOWER[data], offsets)
    h, row = words.hashes(), words.rows()
    tokens = windows(h, WORDS, 31)
    whole = words.left()[: len(tokens)] >= WORDS
    parts, rows = [tokens[whole]], [row[: len(tokens)][whole]]
    for k in range(1, WORDS):  # fewer words: the whole sequence is one token
        short = np.flatnonzero(words.counts == k)
        if len(short):
            parts.append(windows(h, k, 31)[words.bounds[short]])
            rows.append(short)
    tokens, row = np.concatenate(parts), np.concatenate(rows)
    if len(parts) > 1:
        order = np.argsort(row, kind="stable")
        tokens, row = tokens[order], row[order]
    own = tokens + row.astype(U) * U(0x9E3779B97F4A7C15)
    order = np.argsort(own)
    first = np.append(True, own[order][1:] != own[order][:-1])[: len(own)]
    keep = np.sort(order[first])
    return tokens[keep], row[keep]


def _emit(data: np.ndarray, offsets: np.ndarray, _: list) -> tuple:
    parts = [token_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])[0] for i, j in slices(offsets)]
    tokens = np.concatenate(parts)
    return tokens, mix(tokens + U(1)), np.zeros(len(tokens), np.uint8)


def _needed(n):
    """Tokens that a set of n must share with any similar one."""
    return -(-PERCENT * n // 100)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their set's size and class; tokens, rarest first, only of those that can be similar to others."""
    for batch in batches:
        for _, ids, data, offsets, told in unpacked(batch, ("keys", "size")):
            keys, level = told_keys(told[0], _TOKEN_BYTES), np.frombuffer(b"".join(told[1]), np.uint8)
            order = np.argsort(keys)
            keys, level = keys[order], level[order]
            for i, j in slices(offsets):
                tokens, row = token_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                rows = j - i
                n = np.bincount(row, minlength=rows)
                bounds = np.append(0, np.cumsum(n))
                total = np.append(U(0), np.cumsum(mix(tokens ^ U(0x5851F42D4C957F2D)), dtype=U))
                cls = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U)).view(np.int64)
                rank = np.full(len(tokens), -1, np.int16)
                if len(keys):
                    short = tokens & U((1 << (8 * _TOKEN_BYTES)) - 1)
                    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    rank = np.where(keys[at] == short, level[at].astype(np.int16), -1)
                unique = np.bincount(row[rank < 0], minlength=rows)
                reach = n - _needed(n) + 1
                alive = (n > 0) & (unique < reach)
                use = alive[row]
                tokens, row, rank = tokens[use], row[use], rank[use]
                tokens = tokens[np.lexsort((tokens, rank, row))]
                ends = np.cumsum(np.where(alive, n, 0))
                sets = [tokens[e - k: e].tobytes() if a else None for e, k, a in zip(ends.tolist(), n.tolist(), alive.tolist(), strict=True)]
                yield pa.record_batch([ids.slice(i, rows), pa.array(n.astype(np.int64)), pa.array(cls),
                                       pa.array(unique.astype(np.int64)), pa.array(sets, pa.binary())],
                                      names=["id", "n", "cls", "n_unique", "tokens"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cls) for the prefix tokens that are not unique."""
    for batch in batches:
        cls, n, unique = (batch.column(k).to_numpy() for k in range(3))
        out, count = [], []
        for r in range(batch.num_rows):
            tokens = np.frombuffer(batch.column(3)[r].as_buffer(), np.int64)
            out.append(tokens[unique[r]: n[r] - _needed(n[r]) + 1])
            count.append(len(out[-1]))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(out)), pa.array(np.repeat(cls, count))], names=["token", "cls"])


def similar(a: int, b: int, common: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of a batch whose sets are similar."""
    for batch in batches:
        good = []
        for r in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[r].as_buffer(), U) for k in (2, 3))
            good.append(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        yield pa.record_batch([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])


def links_between(queries: list[np.ndarray], members: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Similar pairs of a query and a member: bound by the union of all members first, opened only then."""
    flat, size = np.concatenate(members), np.array([len(m) for m in members])
    owner = np.repeat(np.arange(len(members)), size)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    union, count = flat[at], np.diff(np.append(at, len(flat)))
    for q, query in enumerate(queries):
        fits = (PERCENT * len(query) <= 100 * size) & (PERCENT * size <= 100 * len(query))
        if not fits.any():
            continue
        place = np.minimum(np.searchsorted(union, query), len(union) - 1)
        place = place[union[place] == query]
        if len(place) < _needed(len(query)):
            continue
        n = count[place]
        rows = np.repeat(at[place] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        common = np.bincount(owner[rows], minlength=len(members))
        for m in np.flatnonzero(100 * common >= PERCENT * (len(query) + size - common)):
            yield q, int(m)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between the two parts of each row, or within one part."""
    for batch in batches:
        left, right = [], []
        for r in range(batch.num_rows):
            names, sets = [], []
            for k in (2, 3):
                rows = batch.column(k)[r].values
                names.append(rows.field("cls").to_numpy())
                sets.append([np.frombuffer(x.as_buffer(), U) for x in rows.field("tokens")])
            above = {c: c for part in names for c in part.tolist()}

            def top(c: int) -> int:
                while above[c] != c:
                    above[c] = above[above[c]]
                    c = above[c]
                return c

            for q, m in links_between(*sets):
                a, b = top(int(names[0][q])), top(int(names[1][m]))
                if a != b:
                    above[a] = b
                    left.append(int(names[0][q]))
                    right.append(int(names[1][m]))
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def join_classes(sets: DataFrame) -> DataFrame:
    """(node, root) over the classes of ``sets`` (cls, n, n_unique, tokens) that are linked with others."""
    postings = stage(sets.select("cls", "n", "n_unique", "tokens").mapInArrow(_prefixes, "token bigint, cls bigint"), "postings")
    known = sets.select("cls", "n", "n_unique")
    order = F.struct((F.col("n_unique") / F.col("n")).alias("share"), "cls")
    leaders = postings.join(known, "cls").groupBy("token").agg(F.min(order).alias("lead"), F.count("*").alias("held")).where("held > 1")
    groups = stage(postings.join(leaders, "token").groupBy("cls").agg(F.min("lead")["cls"].alias("grp")), "groups")
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    star = groups.where(F.col("cls") != F.col("grp")).select(F.col("cls").alias("a"), F.col("grp").alias("b")).join(
        left, "a").join(right, "b").select("a", "b", "x", "y")
    links = stage(star.mapInArrow(_verified, "a bigint, b bigint"), "links")

    near = links.select(F.col("a").alias("cls"), F.lit(True).alias("near"))
    grouped = groups.join(near, "cls", "left").withColumn("near", F.coalesce("near", F.col("cls") == F.col("grp")))
    held = grouped.groupBy("grp", "near").agg(F.count("*").alias("held"))
    grouped = stage(grouped.join(held, ["grp", "near"]).select("cls", "grp", "near", F.concat_ws(
        "/", "grp", "near", F.pmod(F.xxhash64("cls"), F.ceil(F.col("held") / PART))).alias("part")), "grouped")
    packed = stage(grouped.join(sets.select("cls", "n", "tokens"), "cls").groupBy("part", "grp", "near").agg(
        F.collect_list(F.struct("cls", "tokens")).alias("sets"), F.min("n").alias("least"), F.max("n").alias("most")), "parts")
    about = packed.select("part", "grp", "near", "least", "most")
    matrix = stage(postings.join(grouped.select("cls", "part"), "cls").select("token", "part").distinct().join(about, "part"), "matrix")
    other = matrix.select("token", *(F.col(c).alias(f"{c}2") for c in about.columns))
    # Some prefix token must be common, and the sizes must overlap within the threshold.
    fits = (100 * F.col("most") >= PERCENT * F.col("least2")) & (100 * F.col("most2") >= PERCENT * F.col("least"))
    connected = F.col("near") & F.col("near2") & (F.col("grp") == F.col("grp2"))
    pairs = matrix.join(other, "token").where((F.col("part") <= F.col("part2")) & fits & ~connected).select("part", "part2").distinct()
    one = packed.select("part", F.col("sets").alias("x"))
    two = packed.select(F.col("part").alias("part2"), F.col("sets").alias("y"))
    opened = pairs.join(one, "part").join(two, "part2").select("part", "part2", "x", "y")
    merged = opened.mapInArrow(_opened, "a bigint, b bigint").union(links)
    out = stage(components(merged), "linked")
    drop(postings, groups, links, grouped, packed, matrix)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``; other columns are not read.

    A set: the distinct 5-word shingles of the text, A-Z in lower case; with one to
    four words the whole sequence; with none, or a null text, it is empty and linked
    with nothing.  Rows link when 100 * common >= 80 * union; component_id is the
    smallest id reachable, the row's own included.  Rows that repeat are linked rows,
    each in the result; ids may repeat, and a null id is passed over in the smallest.
    An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = pack(docs, id_col, text_col)
    counts = stage(exchange(chunks, _emit, buckets_for(total_bytes(chunks) // 6), _TOKEN_BYTES, size=True), "tokens")
    rows = stage(tell(chunks, counts, "keys", "size").mapInArrow(
        _classes, f"id {kind}, n bigint, cls bigint, n_unique bigint, tokens binary"), "classes")
    drop(chunks, counts)
    sets = stage(rows.where(F.col("tokens").isNotNull()).dropDuplicates(["cls"]), "sets")
    linked = join_classes(sets)
    found = rows.join(linked, rows["cls"] == linked["node"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("grp"))
    least = found.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.min("id").alias("least"))
    return found.join(least, "grp", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Every row is judged by its own component, also where rows share an id or have
    none; of equal ids the smaller hash of the text comes first, null ids come last.
    Of rows with one id and text the first by all columns stays; rows without words
    and id are linked with nothing and stay.
    """
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(key.alias("_key"), F.struct(*columns).alias("_row"))
    found = stage(jaccard_components(docs.select(key.alias("_key"), F.col(f"`{text_col}`").alias("_text")), "_key", "_text"), "components")
    gone = found.where(F.col("component_id") != F.col("id")).select(F.col("id").alias("_key")).distinct()
    twice = found.where(~F.col("id.none") | (F.col("n_shingles") > 0)).groupBy("id").count().where("count > 1")
    # The list grows with the corpus, so it is joined in the same way at every size.
    rest = keyed.join(gone.hint("merge"), "_key", "left_anti")
    if not twice.isEmpty():
        twice = twice.select(F.col("id").alias("_key"))
        some = rest.join(twice, "_key", "left_semi")
        rest = rest.join(twice, "_key", "left_anti").union(some.groupBy("_key", F.col(f"_row.`{text_col}`")).agg(F.min("_row").alias("_row")).select("_key", "_row"))
    return rest.select(*(F.col(f"_row.`{c}`") for c in docs.columns))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
