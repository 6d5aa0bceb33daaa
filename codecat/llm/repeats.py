"""Fingerprints that occur more than once in a corpus, told to the chunks that hold them.

Texts are packed into chunks of a few MB (compressed, written once to the shared
folder, each with a lasting number).  ``exchange`` lets every chunk emit
fingerprints, deals them by hash to buckets, finds equal ones by sorting each
bucket, and returns to each chunk those of its own fingerprints that repeat.
A fingerprint travels once per chunk, however often it occurs there, and text
never travels with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import stage
from .textblocks import SLICE_BYTES, laid_out, slices

CHUNK_BYTES = 2 * SLICE_BYTES
# Fingerprints that one bucket is to hold on average: 4 MB, sorted in one Python call.
BUCKET_KEYS = 1 << 19
U = np.uint64


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stage ``docs`` as chunks: (chunk, ids, lens, n_bytes, blob).  A null text is empty; ids may repeat or be null."""
    kind = docs.schema[id_col].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        ids, parts, lens, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            id_type = pa.list_(ids[0].type)
            flat = pa.concat_arrays(ids)
            return pa.record_batch([
                pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat).cast(id_type),
                pa.array([np.concatenate(lens)], pa.list_(pa.int64())),
                pa.array([held], pa.int64()),
                pa.array([tool.compress(b"".join(parts))], pa.binary()),
            ], names=["ids", "lens", "n_bytes", "blob"])

        for batch in batches:
            data, offsets = laid_out(batch.column(1))
            for i, j in slices(offsets):
                n = int(offsets[j] - offsets[i])
                if held and held + n > CHUNK_BYTES:
                    yield out()
                    ids, parts, lens, held = [], [], [], 0
                ids.append(batch.column(0).slice(i, j - i))
                parts.append(data[offsets[i]: offsets[j]].tobytes())
                lens.append(np.diff(offsets[i: j + 1]))
                held += n
        if ids:
            yield out()

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = frame.mapInArrow(squeeze, f"ids array<{kind}>, lens array<bigint>, n_bytes bigint, blob binary")
    return stage(rows.select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks", row_group=4 << 20)


def unpacked(batch: pa.RecordBatch, more: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(chunk, ids, data, offsets, told) of each chunk; told: for each column of ``more`` a list of byte strings."""
    tool = zstandard.ZstdDecompressor()
    names = batch.schema.names
    told = [batch.column(names.index(c)) for c in more]
    for r in range(batch.num_rows):
        lens = np.asarray(batch.column(names.index("lens"))[r].values, np.int64)
        blob = batch.column(names.index("blob"))[r].as_py()
        n = int(batch.column(names.index("n_bytes"))[r].as_py())
        data = np.frombuffer(tool.decompress(blob, max_output_size=max(n, 1)), np.uint8) if n else np.empty(0, np.uint8)
        offsets = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=offsets[1:])
        yield (batch.column(names.index("chunk"))[r].as_py(), batch.column(names.index("ids"))[r].values,
               data, offsets, [c[r].as_py() or [] for c in told])


def _planes(keys: np.ndarray, width: int) -> bytes:
    """The low bytes of sorted keys, all first bytes before all second ones: their high bytes compress well so."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes | memoryview, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.reshape(-1).view(U)


def told_keys(told: list[bytes], width: int = 8) -> np.ndarray:
    return np.concatenate([np.empty(0, U), *(_from_planes(x, width) for x in told)])


def key_set(told: list[bytes], width: int = 8) -> np.ndarray:
    return np.sort(told_keys(told, width))


def among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``found``."""
    if not len(found) or not len(keys):
        return np.zeros(len(keys), bool)
    if len(keys) < 1 << 16:
        at = np.searchsorted(found, keys)
        at[at == len(found)] = 0
        return found[at] == keys
    seen = np.zeros(1 << 22, bool)  # most keys are not found, and one look shows it
    seen[found & U((1 << 22) - 1)] = True
    out = seen[keys & U((1 << 22) - 1)]
    maybe = np.flatnonzero(out)
    for part in range(0, len(maybe), 1 << 15):
        some = maybe[part: part + (1 << 15)]
        out[some] = among(keys[some], found)
    return out


def buckets_for(n_keys: int) -> int:
    return max(16, -(-n_keys // BUCKET_KEYS))


def exchange(frame: DataFrame, emit: Callable, n_buckets: int, width: int = 8, need: int = 0,
             more: tuple[str, ...] = (), lead: bool = False, size: bool = False) -> DataFrame:
    """(chunk, keys[, lead][, size]) with the fingerprints of each chunk that occur twice or more over all chunks.

    ``emit(data, offsets, told)`` returns two fingerprints for each occurrence and
    a flag byte.  The second deals it to a bucket, ``width`` bytes of the first are
    compared there; so 8 * width + log2(n_buckets) bits must agree.  ``need``: flag
    bits of which some occurrence must have one.  keys: see ``told_keys``; lead: a
    byte each, 1 in the chunk with the smallest number of those that hold the key;
    size: a byte each, eight times the binary logarithm of the number of chunks with it.
    """
    mask = U((1 << (8 * width)) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, data, offsets, told in unpacked(batch, more):
                first, second, flag = emit(data, offsets, told)
                if not len(first):
                    continue
                first = first & mask
                bucket = ((second >> U(40)) % U(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
                order = np.argsort(first)
                order = order[np.argsort(bucket[order], kind="stable")]
                first, bucket, flag = first[order], bucket[order], flag[order]
                new = np.ones(len(first), bool)
                new[1:] = (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1])
                at = np.flatnonzero(new)
                many = np.diff(np.append(at, len(first))) > 1
                marks = (np.bitwise_or.reduceat(flag, at) << 1) | many
                first, bucket = first[at], bucket[at]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cut[1:], len(bucket))
                yield pa.record_batch([
                    pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), chunk, np.int64)),
                    pa.array([_planes(first[a:b], width) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([marks[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                ], names=["bucket", "chunk", "planes", "marks"])

    def meet(table: pa.Table) -> pa.Table:
        chunks, sizes, keys, marks = table.column("chunk").to_numpy(), [], [], []
        for planes, mark in zip(table.column("planes"), table.column("marks"), strict=True):
            keys.append(_from_planes(planes.as_buffer(), width))
            marks.append(np.frombuffer(mark.as_buffer(), np.uint8))
            sizes.append(len(marks[-1]))
        keys, marks = np.concatenate(keys), np.concatenate(marks)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(keys)
        keys, marks, row = keys[order], marks[order], row[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        held = np.diff(np.append(at, len(keys)))
        every = np.bitwise_or.reduceat(marks, at)
        good = (held > 1) | ((every & 1) > 0)
        if need:
            good &= (every & (need << 1)) > 0
        least = np.repeat(np.minimum.reduceat(chunks[row], at), held) == chunks[row] if lead else None
        level = np.repeat(np.round(8 * np.log2(held)), held).astype(np.uint8) if size else None
        take = np.flatnonzero(np.repeat(good, held))
        take = take[np.argsort(row[take], kind="stable")]
        row, keys = row[take], keys[take]
        cut = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
        ends = np.append(cut[1:], len(row))
        out = {"chunk": pa.array(chunks[row[cut]], pa.int64()),
               "keys": pa.array([_planes(keys[a:b], width) for a, b in zip(cut, ends, strict=False)], pa.binary())}
        for name, value in (("lead", least), ("size", level)):
            if value is not None:
                value = value[take].astype(np.uint8)
                out[name] = pa.array([value[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary())
        return pa.table(out)

    sent = frame.mapInArrow(send, "bucket int, chunk bigint, planes binary, marks binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, keys binary" + ", lead binary" * lead + ", size binary" * size)


def tell(chunks: DataFrame, hits: DataFrame, *names: str) -> DataFrame:
    """``chunks`` with what an exchange found, as arrays of byte strings (null where nothing)."""
    by_chunk = hits.groupBy(F.col("chunk").alias("to")).agg(*(F.collect_list(c).alias(c) for c in names))
    return chunks.join(by_chunk, chunks["chunk"] == by_chunk["to"], "left").drop("to")


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.sum("n_bytes")).first()[0] or 0
