"""Suffix-array dedup by a difference cover, to a bounded depth.

Suffixes need no order beyond ``length`` bytes here, only to know which begin
with the same bytes.  The steps are those of the difference-cover construction,
with period 64 in place of 3 (two thirds of all bytes would be sampled else):

1. Sampled suffixes: those at places whose remainder modulo 64 is in a cover of
   nine residues.  Whatever two places are, some shift below 64 brings both into
   the sample.
2. Names: a sampled tuple of 64 bytes is named by its fingerprint.  The string
   of names is taken once more, two neighbours (64 bytes apart, so both sampled)
   making the name of 128 bytes; with a shift of at most 63 these lie within any
   200 bytes, so the recursion ends at this depth.  Names are sorted in buckets;
   equal neighbours are the sampled suffixes that repeat.
3. Merge: any other suffix takes part by its shift to a sampled one, and only if
   that one repeats; the first ``length`` bytes of these are sorted likewise.
4. Neighbours with equal prefixes mark their bytes.

The order is that of the fingerprints, not of the bytes: equal prefixes still
stand side by side.  Whole texts that occur more than once go out first: all
their bytes repeat, and one of them stands for all in the steps above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import U, among, buckets_for, exchange, key_set, pack, tell, told_keys, total_bytes, unpacked
from .stages import drop, stage
from .textblocks import byte_prefix, covered, mix, ranges, slices

LENGTH = 200
PERIOD = 64
# Every difference modulo 64 is that of two of these.
COVER = (1, 2, 3, 6, 15, 17, 35, 43, 60)
_SAMPLED = np.zeros(PERIOD, bool)
_SAMPLED[list(COVER)] = True
_NAME_BYTES = 6


def _texts(length: int):
    """Fingerprints of the whole texts that are long enough to have a window."""
    def emit(data: np.ndarray, offsets: np.ndarray, _: list) -> tuple:
        one, two, n = [], [], np.diff(offsets)
        for i, j in slices(offsets):
            part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            for seed, to in ((21, one), (22, two)):
                to.append(mix(ranges(byte_prefix(part, seed), at[:-1], at[1:], seed) + at[1:].astype(U) - at[:-1].astype(U)))
        use = n >= length
        return np.concatenate(one)[use], np.concatenate(two)[use], np.zeros(int(use.sum()), np.uint8)
    return emit


def _copies(data: np.ndarray, offsets: np.ndarray, told: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts occur more than once, and which take part further (one of each)."""
    first, _, _ = _texts(length)(data, offsets, [])
    long = np.flatnonzero(np.diff(offsets) >= length)
    keys, lead = told_keys(told[0]), np.frombuffer(b"".join(told[1]), np.uint8)
    order = np.argsort(keys)
    keys, lead = keys[order], lead[order]
    twice = among(first, keys)
    copy, part = np.zeros(len(offsets) - 1, bool), np.zeros(len(offsets) - 1, bool)
    part[long] = True
    copy[long[twice]] = True
    part[long[twice]] = False
    if twice.any():
        value, at = np.unique(first[twice], return_index=True)
        stands = lead[np.searchsorted(keys, value)] > 0
        part[long[twice][at[stands]]] = True
    return copy, part


def _sampled(data: np.ndarray, offsets: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sampled places of the texts that take part, and for each byte what is left of its text (0: no part)."""
    n = np.diff(offsets)
    left = np.repeat(np.where(part, offsets[1:], 0), n) - np.arange(len(data))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], n)
    return np.flatnonzero(_SAMPLED[place % PERIOD] & (left >= 2 * PERIOD)), left


def _names(data: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    sums = byte_prefix(data, seed)
    low, high = (mix(ranges(sums, at + k, at + k + PERIOD, seed)) for k in (0, PERIOD))
    return mix(low * U(0x9E3779B97F4A7C15) + high)


def _sliced(work, length: int):
    def emit(data: np.ndarray, offsets: np.ndarray, told: list) -> tuple:
        _, part = _copies(data, offsets, told, length)
        found = key_set(told[2], _NAME_BYTES) if len(told) > 2 else None
        parts = [work(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], part[i:j], found)
                 for i, j in slices(offsets) if part[i:j].any()]
        if not parts:
            return np.empty(0, U), np.empty(0, U), np.empty(0, np.uint8)
        first, second = (np.concatenate(x) for x in zip(*parts, strict=True))
        return first, second, np.zeros(len(first), np.uint8)
    return emit


def _sample_names(data, offsets, part, _):
    at, _ = _sampled(data, offsets, part)
    return _names(data, at, 23), _names(data, at, 24)


def _merged(length: int):
    def work(data, offsets, part, found):
        at, left = _sampled(data, offsets, part)
        hit = np.zeros(len(data) + PERIOD, np.int32)
        hit[at[among(_names(data, at, 23) & U((1 << (8 * _NAME_BYTES)) - 1), found)]] = 1
        sums = np.append(0, np.cumsum(hit))
        at = np.flatnonzero((sums[PERIOD:][: len(data)] > sums[: len(data)]) & (left >= length))
        return tuple(mix(ranges(byte_prefix(data, s), at, at + length, s)) for s in (25, 26))
    return work


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept) per row of ``docs``; other columns are not read.

    spans: the maximal removed byte ranges [lo, hi) of the UTF-8 text, every byte
    in a string of ``length`` bytes (191 at least) that also starts anywhere else, in this row or
    another; strings are judged on the input and never cross rows.  kept: the
    other bytes (binary, as a cut may fall inside a character).  A null text is
    empty; a text shorter than ``length`` keeps all; repeated rows are rows of
    their own and remove each other; ids may repeat or be null.  An empty table
    gives an empty result.
    """
    if length < 3 * PERIOD - 1:
        raise ValueError(f"length must be at least {3 * PERIOD - 1}")
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = pack(docs, id_col, text_col)
    n_bytes = total_bytes(chunks)
    texts = stage(exchange(chunks, _texts(length), buckets_for(n_bytes // 1000), lead=True), "texts")
    known = texts.withColumn("names", F.lit(None).cast("binary"))
    n_buckets = buckets_for(n_bytes * len(COVER) // PERIOD)
    samples = stage(exchange(tell(chunks, texts, "keys", "lead"), _sliced(_sample_names, length), n_buckets, _NAME_BYTES,
                             more=("keys", "lead")), "samples")
    told = known.unionByName(samples.select("chunk", F.lit(None).cast("binary").alias("keys"),
                                            F.lit(None).cast("binary").alias("lead"), F.col("keys").alias("names")))
    repeated = stage(exchange(tell(chunks, told, "keys", "lead", "names"), _sliced(_merged(length), length), n_buckets,
                              more=("keys", "lead", "names")), "repeats")
    drop(samples)
    told = known.unionByName(repeated.select("chunk", F.lit(None).cast("binary").alias("keys"),
                                             F.lit(None).cast("binary").alias("lead"), F.col("keys").alias("names")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, data, offsets, told in unpacked(batch, ("keys", "lead", "names")):
                copy, _ = _copies(data, offsets, told, length)
                found = key_set(told[2])
                for i, j in slices(offsets):
                    yield _kept(ids.slice(i, j - i), data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i],
                                copy[i:j], found, length)

    return tell(chunks, told, "keys", "lead", "names").mapInArrow(
        cut, f"id {kind}, n_bytes bigint, spans array<struct<lo:bigint,hi:bigint>>, kept binary")


def _kept(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, copy: np.ndarray, found: np.ndarray, length: int) -> pa.RecordBatch:
    n = np.diff(offsets)
    gone = np.zeros(len(data), bool)
    if len(found):
        sums = byte_prefix(data, 25)
        starts = np.arange(max(len(data) - length + 1, 0))
        inside = np.repeat(offsets[1:], n)[: len(starts)] - starts >= length
        hit = among(mix(ranges(sums, starts, starts + length, 25)), found) & inside
        gone = covered(np.flatnonzero(hit), length, len(data))
    gone |= np.repeat(copy, n)
    spans, kept = [], []
    for r in range(len(ids)):
        mine, text = gone[offsets[r]: offsets[r + 1]], data[offsets[r]: offsets[r + 1]]
        if mine.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            spans.append([{"lo": int(a), "hi": int(b)} for a, b in edges.reshape(-1, 2)])
            text = text[~mine]
        else:
            spans.append([])
        kept.append(text.tobytes())
    return pa.record_batch([
        ids, pa.array(n.astype(np.int64)),
        pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary()),
    ], names=["id", "n_bytes", "spans", "kept"])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
win AS (SELECT doc_id, s, md5(substr(t, 2 * s - 1, 400)) AS g
  FROM (SELECT doc_id, t, unnest(range(1, len(t) // 2 - 198)) AS s FROM d)),
rep AS (SELECT doc_id, s FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
run AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM rep)),
span AS (SELECT doc_id, min(s) AS lo, max(s) + 200 AS hi FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS since FROM span),
per AS (SELECT gap.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans,
  string_agg(substr(t, 2 * since - 1, 2 * (lo - since)), '' ORDER BY lo) || substr(max(t), 2 * max(hi) - 1) AS kept
  FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id)
SELECT d.doc_id, (len(t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(kept, t))) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""
