"""Fill-in-middle transformation with cuts found by a Fenwick tree over text blocks.

A text is UTF-8 bytes in blocks of fixed size.  A Fenwick (binary indexed) tree
over the blocks holds, side by side, how many units and how many code points
begin in each.  A cut after u units is found by binary lifting: one descent
gives the block in which unit u + 1 begins and the units and code points before
that block; the byte is then located inside this one block.  So a cut costs the
logarithm of the number of blocks and one block, whatever the length of the
text, and all cuts of a text share one tree.

Units are code points, words (with the white space before them) or lines; a
document is cut into prefix, middle and suffix at two unit boundaries and laid
out in one of the forms

    plain   the text as it is
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle

Choices depend on the id and a key alone, so that reruns and other partitions
give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import WORD, laid_out

BLOCK_BYTES = 1024
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Of 100 documents, how many are transformed, and of 100 transformed ones how many are laid out suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
KEY = 1
UNITS = ("chars", "words", "lines")


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit.  The units of a text cover it: the first one begins at its first byte."""
    if unit == "chars":
        return (data & 0xC0) != 0x80
    out = np.zeros(len(data), bool)
    if unit == "words":
        # A unit is the white space before a word and the word; white space after the last word belongs to it.
        word = WORD[data]
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        out[ends] = True
        last = np.flatnonzero(word)
        if len(last):
            out[last[-1] + 1:] = False
    elif unit == "lines":
        out[1:] = data[:-1] == 0x0A
    else:
        raise ValueError(f"unknown unit: {unit}")
    if len(out):
        out[0] = True
    return out


class BlockTree:
    """A Fenwick tree over the blocks of one text; its two columns are the counts of units and of code points."""

    def __init__(self, data: np.ndarray, unit: str = "chars", block: int = BLOCK_BYTES):
        self.data, self.block = data, block
        self.starts = unit_starts(data, unit)
        at = np.arange(0, len(data), block)
        points = (data & 0xC0) != 0x80
        counts = np.zeros((len(at) + 1, 2), np.int64)
        if len(at):
            counts[1:, 0] = np.add.reduceat(self.starts, at, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(points, at, dtype=np.int64)
        self.total = counts.sum(axis=0)
        # Node i holds blocks i - lowbit(i) + 1 to i; children are added to parents level by level.
        node = np.arange(len(counts))
        step = 1
        while step < len(counts):
            child = node[step::2 * step]
            child = child[child + step < len(counts)]
            counts[child + step] += counts[child]
            step *= 2
        self.tree, self.top = counts, step

    @property
    def n_units(self) -> int:
        return int(self.total[0])

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code points before it) of the boundary after ``units`` units."""
        if units >= self.n_units:
            return len(self.data), int(self.total[1])
        at, step, left, points = 0, self.top, units, 0
        while step:
            if at + step < len(self.tree) and self.tree[at + step, 0] <= left:
                at += step
                left -= int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step //= 2
        lo = at * self.block
        byte = lo + int(np.flatnonzero(self.starts[lo: lo + self.block])[left])
        return byte, points + int(np.count_nonzero((self.data[lo: byte] & 0xC0) != 0x80))


@dataclass(frozen=True)
class Fim:
    form: str
    n_units: int
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def _draws(doc_id, key: int) -> list[int]:
    digest = hashlib.sha256(f"{key}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]


def transform(doc_id, text: bytes, data: np.ndarray, unit: str = "chars", key: int = KEY, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT, block: int = BLOCK_BYTES) -> Fim:
    """One text (its bytes, and the same as an array) in its form."""
    h1, h2, h3, h4 = _draws(doc_id, key)
    tree = BlockTree(data, unit, block)
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Fim("plain", tree.n_units, None, None, text)
    cuts = sorted((h1 % (tree.n_units + 1), h2 % (tree.n_units + 1)))
    (a, a_chars), (b, b_chars) = (tree.cut(u) for u in cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        form, out = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, out = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return Fim(form, tree.n_units, a_chars, b_chars - a_chars, out)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from.

    A transformed text holds no mark of its own and marks cannot overlap, so the first of each mark is the one set.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "chars", key: int = KEY,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, block: int = BLOCK_BYTES,
                   digests: bool = False) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row of ``docs``; other columns are not read.

    n counts units; prefix_chars and middle_chars are code points, null in plain
    form.  A null or empty text has no unit and stays plain and empty; so does any
    text that holds one of the marks.  Rows are judged one by one: repeated ids give
    the same cuts for the same text, a null id draws like an empty one.  An empty
    table gives an empty result.  With ``digests`` the columns output_sha256 and
    restored_sha256 (of the text rebuilt from output and form) take the place of output.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    kind = docs.schema[id_col].dataType.simpleString()
    last = ("output_sha256", "restored_sha256") if digests else ("output",)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = laid_out(batch.column(1))
            made, tails = [], [[] for _ in last]
            for r, doc_id in enumerate(batch.column(0).to_pylist()):
                part = data[offsets[r]: offsets[r + 1]]
                got = transform(doc_id, part.tobytes(), part, unit, key, fim_percent, spm_percent, block)
                if digests:
                    tails[0].append(hashlib.sha256(got.output).hexdigest())
                    tails[1].append(hashlib.sha256(restore(got.output, got.form)).hexdigest())
                    made.append((got.n_units, got.form, got.prefix_chars, got.middle_chars))
                else:
                    tails[0].append(got.output.decode())
                    made.append((got.n_units, got.form, got.prefix_chars, got.middle_chars))
            n, form, prefix, middle = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.record_batch([
                batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), *(pa.array(t, pa.string()) for t in tails),
            ], names=["id", "n", "form", "prefix_chars", "middle_chars", *last])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                                 + ", ".join(f"{c} string" for c in last))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` cut by code points."""
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True).withColumnRenamed("id", "doc_id")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
