"""Substring dedup by fixed-block anchors.

A repeat of at least ``2 * block - 1`` words holds a whole block of the grid of
either text that has it.  So the blocks of every text, at word 0, block,
2 * block and so on, are the index; every window of ``block`` words of every
text probes it.  A block that is met at any other place is an anchor.  The
repeats are then extended around anchors only: each window of ``length`` words
that holds an anchor is compared with all other such windows, and the union of
those that repeat is the union of the maximal exact repeats.

Both steps deal fingerprints to buckets, see ``repeats``.  The first compares 48
bits and the bucket (a false anchor only costs work), the second 64 bits and the
bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import U, among, buckets_for, exchange, key_set, pack, tell, total_bytes, unpacked
from .stages import drop, stage
from .textblocks import Words, covered, slices, windows

LENGTH = 35
_ANCHOR_BYTES = 6


def _in_slices(work: Callable) -> Callable:
    """Apply ``work(words, told)`` to each slice of a chunk and join its arrays."""
    def emit(data: np.ndarray, offsets: np.ndarray, told: list) -> tuple:
        found = key_set(told[0], _ANCHOR_BYTES) if told else np.empty(0, U)
        parts = [work(Words(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]), found)
                 for i, j in slices(offsets)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return emit


def _probes(block: int) -> Callable:
    def work(words: Words, _: np.ndarray) -> tuple:
        h = words.hashes()
        first, second = windows(h, block, 11), windows(h, block, 12)
        whole = words.left()[: len(first)] >= block
        place = np.arange(len(words)) - np.repeat(words.bounds[:-1], words.counts)
        on_grid = (place[: len(first)] % block == 0).astype(np.uint8)
        return first[whole], second[whole], on_grid[whole]
    return _in_slices(work)


def _around_anchors(block: int, length: int) -> Callable:
    mask = U((1 << (8 * _ANCHOR_BYTES)) - 1)

    def work(words: Words, anchors: np.ndarray) -> tuple:
        h = words.hashes()
        first, second = windows(h, length, 13), windows(h, length, 14)
        n = len(first)
        hit = among(windows(h, block, 11) & mask, anchors)
        sums = np.append(0, np.cumsum(hit))
        near = sums[length - block + 1:][:n] > sums[:n]
        near &= words.left()[:n] >= length
        return first[near], second[near], np.zeros(int(near.sum()), np.uint8)
    return _in_slices(work)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, spans, kept) per row of ``docs``; other columns are not read.

    spans: the removed word ranges [lo, hi), every word that lies in a window of
    ``length`` words (at least 3) whose words also start anywhere else.  kept: the
    other words joined by one space.  Windows are judged on the input.  A null or
    empty text, or one without words, has no span and an empty ``kept``; a text
    shorter than ``length`` keeps all its words.  Repeated rows are texts of their
    own, so they remove each other; ids are carried and may repeat or be null.
    An empty table gives an empty result.
    """
    block = (length + 1) // 2
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = pack(docs, id_col, text_col)
    n_buckets = buckets_for(total_bytes(chunks) // 6)
    anchors = stage(exchange(chunks, _probes(block), n_buckets, _ANCHOR_BYTES, need=1), "anchors")
    near = tell(chunks, anchors, "keys")
    repeated = stage(exchange(near, _around_anchors(block, length), n_buckets, more=("keys",)), "repeats")
    drop(anchors)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, data, offsets, told in unpacked(batch, ("keys",)):
                found = key_set(told[0])
                for i, j in slices(offsets):
                    yield _kept(ids.slice(i, j - i), data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], found, length)

    return tell(chunks, repeated, "keys").mapInArrow(
        cut, f"id {kind}, n_words bigint, spans array<struct<lo:bigint,hi:bigint>>, kept string")


def _kept(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, found: np.ndarray, length: int) -> pa.RecordBatch:
    words = Words(data, offsets)
    gone = np.zeros(len(words), bool)
    if len(found):
        first = windows(words.hashes(), length, 13)
        hit = among(first, found) & (words.left()[: len(first)] >= length)
        gone = covered(np.flatnonzero(hit), length, len(words))
    raw, spans, kept = data.tobytes(), [], []
    for r in range(len(ids)):
        split = raw[offsets[r]: offsets[r + 1]].split()
        mine = gone[words.bounds[r]: words.bounds[r + 1]]
        if mine.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            spans.append([{"lo": int(a), "hi": int(b)} for a, b in edges.reshape(-1, 2)])
            split = [w for w, x in zip(split, mine.tolist(), strict=True) if not x]
        else:
            spans.append([])
        kept.append(b" ".join(split).decode())
    return pa.record_batch([
        ids, pa.array(words.counts.astype(np.int64)),
        pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.string()),
    ], names=["id", "n_words", "spans", "kept"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"])
    return out.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"),
                      F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 34) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
edge AS (SELECT doc_id, p, sum(v) AS v FROM (
  SELECT doc_id, s AS p, 1 AS v FROM rep UNION ALL SELECT doc_id, s + 35, -1 FROM rep) GROUP BY ALL),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
mark AS (SELECT word.doc_id, word.p, x, sum(coalesce(v, 0)) OVER (PARTITION BY word.doc_id ORDER BY word.p) > 0 AS gone
  FROM word LEFT JOIN edge ON edge.doc_id = word.doc_id AND edge.p = word.p),
per AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""
