"""Quality rules by weak supervision.

Each rule looks at counts of one document and casts its vote (good or bad) or
abstains.  A
document's votes are a pattern, of which there are at most 2 ** rules; the
patterns of all documents are counted in Spark, and expectation-maximisation on
these counts estimates how often each rule is right and the share of good
documents.  A document is kept if
the posterior probability that it is good reaches the threshold, instead of
having to pass every rule.  Base rules on length and repetition come before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .stages import stage
from .textblocks import Words, byte_prefix, covered, laid_out, mix, ranges, slices, windows

# Each rule says good (True) or bad (False) of a document, or abstains.
RULES = (
    ("many symbols", False),
    ("words with a symbol", False),
    ("duplicate lines", False),
    ("repeated words", False),
    ("few different words", False),
    ("upper case", False),
    ("shouting", False),
    ("words without a letter", False),
    ("odd word length", False),
    ("plain and varied words", True),
    ("sentences on lines of their own", True),
)
N_PATTERNS = 2 ** len(RULES)
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_ROUNDS, _SETTLED = 500, 1e-9
# How often a rule is believed to vote on its own class and on the other, the share of good documents, and the
# weight of these beliefs as a share of all documents.
RIGHT, WRONG, PRIOR, BELIEF_SHARE = 0.5, 0.02, 0.8, 0.02

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[0x80:] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = (*BASE, "pattern")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[bounds[1:]] - total[bounds[:-1]]


def _own(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal only within a row."""
    return mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    n_rows = len(offsets) - 1
    row, sums = words.rows(), byte_prefix(data, 1)
    hashes = mix(ranges(sums, words.lo, words.hi, 1))
    out = {"n_words": words.counts, "n_symbols": _sums(_SYMBOL[data], offsets),
           "word_chars": _sums(words.word & _FIRST_BYTE[data], offsets)}

    newline = np.flatnonzero(data == 0x0A)
    lo, hi = np.sort(np.append(offsets[:-1], newline + 1)), np.sort(np.append(newline, offsets[1:]))
    per_row = np.diff(np.searchsorted(newline, offsets)) + 1
    line_row = np.repeat(np.arange(n_rows), per_row)
    use = np.searchsorted(words.lo, hi) > np.searchsorted(words.lo, lo)
    keys = _own(mix(ranges(sums, lo[use], hi[use], 1) + (hi - lo)[use].astype(np.uint64)), line_row[use])
    order = np.argsort(keys)
    again = line_row[use][order[1:]][keys[order[1:]] == keys[order[:-1]]]
    out["n_dup_lines"] = np.bincount(again, minlength=n_rows)
    out["n_lines"] = np.bincount(line_row[use], minlength=n_rows)

    starts = np.flatnonzero(words.left() >= 3)
    keys = _own(windows(hashes, 3, 2)[starts] if len(starts) else hashes[:0], row[starts])
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out["n_repeat_words"] = _sums(covered(starts[twice], 3, len(words)), words.bounds)

    def having(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[data]))
        return total[words.hi] > total[words.lo]

    letter, symbol = having(_LETTER), having(_SYMBOL)
    last, before = data[words.hi - 1], data[np.maximum(words.hi - 2, 0)]
    stop, mark = _STOP[last], (last == 0x21) & (before == 0x21)
    inner = np.append(0, np.cumsum(_LETTER[data]))
    plain = inner[words.hi] - inner[words.lo] == words.hi - words.lo - (stop | (last == 0x2C))
    for name, flag in (("no_letter", ~letter), ("with_symbol", symbol), ("stops", stop), ("marks", mark), ("plain", plain & letter)):
        out[name] = _sums(flag, words.bounds)
    out["upper"] = _sums(_UPPER[data], offsets)
    out["ascii_letters"] = _sums(_ASCII_LETTER[data], offsets)
    keys = _own(hashes, row)
    order = np.argsort(keys)
    out["different"] = np.bincount(row[order][np.append(True, np.diff(keys[order]) != 0)[: len(keys)]], minlength=n_rows)
    return out


def _votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """The pattern of each row, a bit for each rule that does not abstain; without words all abstain."""
    n = np.maximum(c["n_words"], 1)
    share = {k: 100 * c[k] / n for k in ("n_symbols", "with_symbol", "n_repeat_words", "different", "marks", "no_letter", "plain", "stops")}
    lines = 100 * c["n_dup_lines"] / np.maximum(c["n_lines"], 1)
    upper = 100 * c["upper"] / np.maximum(c["ascii_letters"], 1)
    length = c["word_chars"] / n
    repeat = share["n_repeat_words"]
    said = (
        share["n_symbols"] >= 10,
        share["with_symbol"] >= 10,
        lines >= 30,
        repeat >= 30,
        # A text of n words has about n ** 0.75 different ones or more; half of that is few.
        c["different"] < 0.5 * n ** 0.75,
        upper >= 40,
        share["marks"] >= 20,
        share["no_letter"] >= 25,
        (length < 2) | (length > 15),
        (share["plain"] >= 90) & (repeat < 25),
        (share["stops"] >= 1) & (share["stops"] <= 40) & (lines < 20) & (upper < 30) & (share["with_symbol"] < 5),
    )
    pattern = np.zeros(len(n), np.int64)
    for r, vote in enumerate(said):
        pattern |= (vote & (c["n_words"] > 0)).astype(np.int64) << r
    return pattern


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = laid_out(texts)
    parts = []
    for i, j in slices(offsets):
        counts = _counts(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        parts.append({**{k: counts[k] for k in BASE}, "pattern": _votes(counts)})
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for k in _FIELDS}


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the vote pattern of each text as one struct column, ``quality_counts``."""
    names = docs.columns
    new = "quality_counts"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = features(batch.column(names.index(text_col)))
            extra = pa.StructArray.from_arrays([pa.array(got[k]) for k in _FIELDS], list(_FIELDS))
            yield pa.record_batch([*batch.columns, extra], names=[*names, new])

    schema = StructType([*docs.schema.fields, StructField(new, StructType([StructField(k, LongType()) for k in _FIELDS]))])
    return docs.mapInArrow(add, schema)


def fit(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior probability of good for every pattern, by expectation-maximisation on pattern counts.

    A rule votes at one rate on documents of the class that it speaks for and at
    another, not higher, on the rest; its accuracy follows from the two and the share
    of good documents.  Votes are independent given the class.  Rates start at, and
    are held by a share ``BELIEF_SHARE`` of all documents to, the belief that a rule
    speaks up on ``RIGHT`` of its own class and ``WRONG`` of the other.  Without any
    document the posteriors follow from the start.
    """
    codes = np.arange(N_PATTERNS)
    voted = np.stack([codes >> r & 1 for r in range(len(RULES))]).astype(float)
    own = np.array([good for _, good in RULES])
    weight = np.bincount(patterns, weights=counts, minlength=N_PATTERNS).astype(float)
    hold = BELIEF_SHARE * weight.sum() + 1
    belief = np.array([np.where(own, WRONG, RIGHT), np.where(own, RIGHT, WRONG)])
    rate, share = belief, PRIOR
    for _ in range(_ROUNDS):
        log = np.log(rate) @ voted + np.log(1 - rate) @ (1 - voted) + np.log([[1 - share], [share]])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        member = np.stack([weight * (1 - good), weight * good])
        new = (member @ voted.T + belief * hold / 2) / (member.sum(axis=1, keepdims=True) + hold / 2)
        mine, other = np.where(own, new[1], new[0]), np.where(own, new[0], new[1])
        other = np.minimum(mine, other)
        new = np.stack([np.where(own, other, mine), np.where(own, mine, other)])
        new_share = float((member[1].sum() + PRIOR * hold) / (weight.sum() + hold))
        moved = max(np.abs(new - rate).max(), abs(new_share - share))
        rate, share = new, new_share
        if moved < _SETTLED:
            break
    return good


def learn(patterns: DataFrame) -> np.ndarray:
    """Posteriors from the counts of all documents that pass the base rules; at most ``N_PATTERNS`` sums come to the driver."""
    rows = patterns.where(~_base_failed()).groupBy("pattern").count().collect()
    return fit(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float))


def _base_failed(prefix: str = ""):
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def _decided(df: DataFrame, posterior: np.ndarray) -> DataFrame:
    """Add base_failed, p_good and kept; the posteriors are a literal of ``N_PATTERNS`` numbers."""
    chance = F.get(F.lit([float(x) for x in posterior]), F.col("pattern").cast("int"))
    failed = _base_failed()
    return df.withColumns({"base_failed": failed, "p_good": chance, "kept": ~failed & (chance >= THRESHOLD)})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, base_failed, p_good, kept) per row of ``docs``; other columns are not read.

    A null, empty or blank text has no words, so it fails the base rules.  Ids are
    carried and may repeat or be null.  An empty table gives an empty result.
    """
    rows = with_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    counted = stage(rows.select("id", "quality_counts.*"), "quality")
    return _decided(counted, learn(counted)).drop("pattern")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; counted in one pass and filtered in another."""
    rows = with_features(docs, text_col)
    alone = with_features(docs.select(text_col), text_col).select("quality_counts.*")
    posterior = F.get(F.lit([float(x) for x in learn(alone)]), F.col("quality_counts.pattern").cast("int"))
    good = rows.where(~_base_failed("quality_counts.") & (posterior >= THRESHOLD))
    return good.select(*(f"`{c}`" for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), *BASE, "base_failed", "p_good", "kept")
