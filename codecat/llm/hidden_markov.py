"""Language-model scoring with a hidden Markov model trained by Baum-Welch.

Latent states follow each other by a transition matrix and emit the words of a
text and its end.  Emissions are tied by word class:

    P(word | state) = P(class | state) * P(word | class)

A word with at least one in ``OWN_SHARE`` of the training tokens is a class of
its own (there cannot be more than ``OWN_SHARE`` such words); other words share
a class by their last three bytes.  ``P(word | class)`` comes from the counts of
all training words, which Spark gathers and which grow with the corpus; what the
states learn is of fixed size.  A word that training does not hold has the
probability the unigram base gives it, in every state; with a single state the
model is that base.

Training: every round each partition of the training texts runs the scaled
forward and backward recursions over its texts, sends its expected counts of
starts, transitions and emissions, and Spark adds them up.  Scoring: the scaled
forward recursion gives the exact likelihood of the whole text.  A long text is
cut into pieces: transfer matrices of all its pieces are found side by side and
multiplied along the text, which gives each piece the exact messages at its
ends, so long texts cost no long loops and nothing is approximated.

Words are compared by 54 bits of a fingerprint and their class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import buckets_for, pack, tell, total_bytes, unpacked
from .stages import drop, stage
from .textblocks import LOWER, Words, mix, slices

STATES = 8
ROUNDS = 8
# Training ends before ``ROUNDS`` when a token's mean log-likelihood gains less than this.
SETTLED = 2e-4
OWN_SHARE = 4096
# Words with at least one in so many training tokens are known to every task (16 bytes each); others are looked up.
KNOWN_SHARE = 1 << 19
# Classes: the end, words of their own, endings.
ENDINGS = 1024
# Weight of the unigram base in each state's emissions, and of the first guess in starts and transitions, in tokens.
EMISSION_PRIOR, TRANSITION_PRIOR = 200.0, 10.0
# Tokens of a piece, cells (steps x pieces) that are worked on at once, and tokens gathered to fill them well.
PIECE, TOGETHER, GATHERED = 4096, 1 << 19, 1 << 20
# Tokens between two scalings, in doubles (scoring) and in single precision (expected counts).
RESCALE, RESCALE_SINGLE = 8, 2
U = np.uint64
END_KEY = 0


# ---------------------------------------------------------------- tokens

def _ending(words: Words) -> np.ndarray:
    """The class number of each word's last three bytes."""
    last = np.zeros(len(words), U)
    for back in (1, 2, 3):
        at = words.hi - back
        last = last * U(257) + np.where(at >= words.lo, words.data[np.maximum(at, 0)].astype(U) + U(1), U(0))
    return mix(last) % U(ENDINGS)


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word, lower-cased, and the number of words of each text.

    A key is a fingerprint with the ending's class as its low bits; no word has the key of the end.
    """
    keys, counts = [np.empty(0, U)], [np.empty(0, np.int64)]
    for i, j in slices(offsets):
        words = Words(LOWER[data[offsets[i]: offsets[j]]], offsets[i: j + 1] - offsets[i])
        keys.append((np.maximum(words.hashes() >> U(10), U(1)) << U(10)) | _ending(words))
        counts.append(words.counts.astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


# ---------------------------------------------------------------- vocabulary

@dataclass
class Vocabulary:
    """Training counts that every task holds; at most ``KNOWN_SHARE`` keys."""

    n: int                    # training tokens
    v: int                    # distinct ones
    keys: np.ndarray          # common keys, sorted
    counts: np.ndarray
    own: np.ndarray           # class of each common key: 0 the end, 1.. words of their own, 0 where it is its ending
    n_own: int
    mass: np.ndarray          # sum of count + 1 of each class

    @property
    def n_classes(self) -> int:
        return 1 + self.n_own + ENDINGS

    @property
    def unknown(self) -> int:
        """The class of words that training does not hold."""
        return self.n_classes

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each key among the common ones, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def classes(self, keys: np.ndarray) -> np.ndarray:
        """The class of each word key, known or not."""
        at, there = self.find(keys)
        out = (keys & U(ENDINGS - 1)).astype(np.int64) + 1 + self.n_own
        if len(self.keys):
            own = np.where(there, self.own[at], 0)
            out = np.where(own > 0, own, out)
        return out


def _counted(chunks: DataFrame) -> DataFrame:
    """Staged (key, n): training counts of all words and of the end."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            n = np.concatenate([c for _, c in held])
            uniq, inverse = np.unique(keys, return_inverse=True)
            return pa.record_batch([pa.array(_signed(uniq)), pa.array(np.bincount(inverse, weights=n).astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for _, ids, data, offsets, _ in unpacked(batch):
                learn = _learns(ids)
                keys, counts = word_keys(data, offsets)
                uniq, n = np.unique(keys[np.repeat(learn, counts)], return_counts=True)
                held.append((uniq, n))
                ends += int(learn.sum())
                if sum(len(k) for k, _ in held) > 1 << 20:
                    yield out()
                    held = []
        if ends:
            held.append((np.array([END_KEY], U), np.array([ends])))
            yield out()
        elif held:
            yield out()

    return stage(chunks.mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "vocabulary")


def _learns(ids: pa.Array) -> np.ndarray:
    return np.array(ids.field("learn").to_pylist(), bool)


def _vocabulary(words: DataFrame) -> Vocabulary:
    """What tasks need to hold, from the counts of all training words."""
    n, v = (int(x or 0) for x in words.agg(F.sum("n"), F.count(F.lit(1))).first())
    common = words.where((F.col("n") * KNOWN_SHARE >= n) | (F.col("key") == END_KEY)).toArrow()  # at most KNOWN_SHARE + 1 rows
    keys, counts = common.column("key").to_numpy().view(U), common.column("n").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    is_own = (counts * OWN_SHARE >= n) & (keys != U(END_KEY))
    own = np.where(is_own, np.cumsum(is_own), 0)
    n_own = int(is_own.sum())
    mass = np.zeros(1 + n_own + ENDINGS)
    mass[own[is_own]] = counts[is_own] + 1
    mass[0] = counts[keys == U(END_KEY)].sum() + 1 if n else 0
    rest = words.where((F.col("n") * OWN_SHARE < n) & (F.col("key") != END_KEY))
    for cls, total in rest.groupBy(F.col("key").bitwiseAND(ENDINGS - 1)).agg(F.sum(F.col("n") + 1)).collect():  # ENDINGS rows
        mass[1 + n_own + cls] = total
    return Vocabulary(n, v, keys, counts, own, n_own, mass)


# ---------------------------------------------------------------- the model

@dataclass
class Model:
    start: np.ndarray         # S
    move: np.ndarray          # S x S
    emit: np.ndarray          # (classes + 1) x S; the last row is an unknown word's

    @property
    def n_states(self) -> int:
        return len(self.start)

    @property
    def rescale(self) -> int:
        return RESCALE if self.emit.dtype == np.float64 else RESCALE_SINGLE

    def single(self) -> "Model":
        """The same in single precision: expected counts need no more, and are summed in doubles."""
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))


def first_model(vocab: Vocabulary, n_states: int) -> Model:
    """States that differ a little, and rather last; the same for the same vocabulary."""
    rng = np.random.default_rng(17)
    base = _base_classes(vocab)[:, None]
    return _model(vocab, np.full(n_states, 1 / n_states), 0.5 * np.eye(n_states) + 0.5 / n_states,
                  base * np.exp(0.5 * rng.standard_normal((vocab.n_classes, n_states))) if n_states > 1 else base)


def _base_classes(vocab: Vocabulary) -> np.ndarray:
    total = vocab.mass.sum()
    return vocab.mass / total if total else vocab.mass


def _model(vocab: Vocabulary, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Normalised; known classes share what the unknown word leaves."""
    unknown = 1 / (vocab.n + vocab.v + 1)
    total = emit.sum(axis=0)
    emit = (1 - unknown) * emit / np.where(total > 0, total, 1)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), np.vstack([emit, np.full((1, emit.shape[1]), unknown)]))


@dataclass
class Batch:
    """Pieces of texts, longest first: classes[t, piece], and what reaches each piece from outside."""

    classes: np.ndarray
    length: np.ndarray
    before: np.ndarray        # S per piece: distribution of the state of its first token, given what comes before
    live: np.ndarray          # pieces that have a token t

    @classmethod
    def of(cls, tokens: np.ndarray, lo: np.ndarray, length: np.ndarray, before: np.ndarray) -> "Batch":
        steps = np.arange(int(length[0]))
        live = np.searchsorted(-length, -steps, side="left")
        at = np.minimum(lo[None, :] + steps[:, None], len(tokens) - 1)
        return cls(tokens[at], length, before, live)


def _forward(model: Model, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and last state distribution per piece; all messages, their scales, and emissions.

    Messages are scaled every few tokens (``Model.rescale``) and at the end of a piece: in between they stay far
    above the smallest number.  Cells behind a piece's end are 0.
    """
    steps, width = batch.classes.shape
    kind, every = model.emit.dtype, model.rescale
    emitted, live, ones = model.emit[batch.classes], [*batch.live.tolist(), 0], np.ones(model.n_states, kind)
    last, scales = np.empty((width, model.n_states)), np.ones((steps, width), kind)
    alphas = np.zeros((steps, width, model.n_states), kind)
    for t in range(steps):
        m, left = live[t], live[t + 1]
        a = alphas[t, :m]
        if t:
            np.matmul(alphas[t - 1, :m], model.move, out=a)
            a *= emitted[t, :m]
        else:
            np.multiply(batch.before[:m], emitted[t, :m], out=a, casting="same_kind")
        lo = 0 if t % every == every - 1 else left
        if lo < m:
            c = a[lo:] @ ones
            a[lo:] /= c[:, None]
            scales[t, lo:m] = c
        if left < m:
            last[left:m] = a[left:]
    return np.log(scales).sum(axis=0, dtype=np.float64), last, alphas, scales, emitted


def _backward(model: Model, batch: Batch, scales: np.ndarray, emitted: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled backward messages, and per token the emission times the message over its scale (``emitted`` is used up)."""
    steps, width = batch.classes.shape
    betas, weights = np.zeros((steps, width, model.n_states), emitted.dtype), emitted
    live, back, every = [*batch.live.tolist(), 0], model.move.T.copy(), model.rescale
    for t in range(steps - 1, -1, -1):
        m, had = live[t], live[t + 1]
        if had < m:
            betas[t, had:m] = after[had:m]
        if had:
            np.matmul(weights[t + 1, :had], back, out=betas[t, :had])
        w = weights[t, :m]
        w *= betas[t, :m]
        lo = 0 if t % every == every - 1 else had
        if lo < m:
            w[lo:] /= scales[t, lo:m, None]
        if m < width:
            weights[t, m:] = 0
    return betas, weights


def _pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, tokens, number within the text) of the pieces of texts laid end to end."""
    per = -(-lengths // PIECE)
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    lo = np.repeat(np.cumsum(lengths) - lengths, per) + nth * PIECE
    return text, lo, np.minimum(np.repeat(lengths, per) - nth * PIECE, PIECE), nth


def _grouped(length: np.ndarray, room: int) -> Iterator[np.ndarray]:
    """Positions in groups of about ``room`` cells, longest first."""
    order = np.argsort(-length, kind="stable")
    i = 0
    while i < len(order):
        width = max(1, room // int(length[order[i]]))
        yield order[i: i + width]
        i += width


def _ends(model: Model, tokens: np.ndarray, text: np.ndarray, lo: np.ndarray, length: np.ndarray, nth: np.ndarray,
          with_after: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece: the state distribution before its first token and before that move, and the message from behind.

    Only texts of several pieces need work: a piece's transfer matrix, from each state before it to each at its end,
    is the forward recursion from that state alone.
    """
    s = model.n_states
    before, came = np.tile(model.start, (len(text), 1)), np.zeros((len(text), s))
    after = np.ones((len(text), s))
    long = np.flatnonzero((nth > 0) | np.append(nth[1:] > 0, False)) if len(text) else np.empty(0, np.int64)
    if not len(long):
        return before, came, after
    scaled, first = np.empty((len(long), s, s)), np.empty((len(long), s))
    later, starts = np.flatnonzero(nth[long] > 0), np.flatnonzero(nth[long] == 0)
    for some in _grouped(length[long[later]], TOGETHER // s):
        rows, width = long[later[some]], len(some)
        batch = Batch.of(tokens, np.repeat(lo[rows], s), np.repeat(length[rows], s), np.tile(model.move, (width, 1)))
        log, last = _forward(model, batch)[:2]
        log = log.reshape(width, s, 1)
        scaled[later[some]] = last.reshape(width, s, s) * np.exp(log - log.max(axis=1, keepdims=True))
    for some in _grouped(length[long[starts]], TOGETHER):
        # A first piece comes from the start distribution instead.
        rows = long[starts[some]]
        first[starts[some]] = _forward(model, Batch.of(tokens, lo[rows], length[rows], before[rows]))[1]
    for at, piece in enumerate(long.tolist()):
        if nth[piece] == 0:
            state = first[at]
        else:
            came[piece] = state
            before[piece] = state @ model.move
            state = state @ scaled[at]
            state /= state.sum()
        if with_after:
            after[piece] = state  # for the moment: the state distribution at its end
    if with_after:
        message = np.ones(s)
        for at in range(len(long) - 1, -1, -1):
            piece = long[at]
            end = after[piece].copy()
            if at + 1 < len(long) and text[long[at + 1]] == text[piece]:
                message = scaled[at + 1] @ message
            else:
                message = np.ones(s)
            message = message / (end @ message)
            after[piece] = message
    return before, came, after


def log_likelihoods(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of the likelihood of each text of classes (every text has its end, so none is empty)."""
    text, lo, length, nth = _pieces(lengths)
    before, _, _ = _ends(model, tokens, text, lo, length, nth, False)
    out = np.zeros(len(lengths))
    for some in _grouped(length, TOGETHER):
        log = _forward(model, Batch.of(tokens, lo[some], length[some], before[some]))[0]
        np.add.at(out, text[some], log)
    return out


@dataclass
class Expected:
    """Expected counts of a partition: what Spark adds up."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float = 0.0
    tokens: int = 0

    @classmethod
    def none(cls, n_states: int, n_classes: int) -> "Expected":
        return cls(np.zeros(n_states), np.zeros((n_states, n_states)), np.zeros((n_classes + 1, n_states)))

    def add(self, model: Model, tokens: np.ndarray, lengths: np.ndarray) -> None:
        """The forward-backward pass over texts of classes."""
        text, lo, length, nth = _pieces(lengths)
        before, came, after = _ends(model, tokens, text, lo, length, nth, True)
        s = model.n_states
        for some in _grouped(length, TOGETHER):
            batch = Batch.of(tokens, lo[some], length[some], before[some])
            log, _, alphas, scales, emitted = _forward(model, batch)
            betas, weights = _backward(model, batch, scales, emitted, after[some])
            # Cells behind a piece's end hold 0 and add nothing.
            classes = batch.classes.ravel()
            for k in range(s):
                self.emit[:, k] += np.bincount(classes, weights=(alphas[:, :, k] * betas[:, :, k]).ravel(), minlength=len(self.emit))
            self.move += model.move * (alphas[:-1].reshape(-1, s).T @ weights[1:].reshape(-1, s))
            first = nth[some] == 0
            self.start += (alphas[0] * betas[0])[first].sum(axis=0)
            self.move += model.move * (came[some][~first].T @ weights[0][~first])
            self.log += float(log.sum())
            self.tokens += int(batch.length.sum())


def _sums(sequences: DataFrame, model: Model, vocab: Vocabulary) -> Expected:
    """Expected counts over all training texts: partitions send theirs, Spark adds them by position."""
    s, c = model.n_states, vocab.n_classes
    shared = sequences.sparkSession.sparkContext.broadcast(model.single())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, tokens, lengths = Expected.none(s, c), [], []
        for batch in batches:
            for lens, raw in zip(batch.column(0), batch.column(1), strict=True):
                lengths.append(np.asarray(lens.values, np.int64))
                tokens.append(np.frombuffer(raw.as_buffer(), np.uint16))
                if sum(len(x) for x in tokens) >= GATHERED:
                    got.add(shared.value, np.concatenate(tokens).astype(np.int64), np.concatenate(lengths))
                    tokens, lengths = [], []
        if tokens:
            got.add(shared.value, np.concatenate(tokens).astype(np.int64), np.concatenate(lengths))
        flat = np.concatenate([got.start, got.move.ravel(), got.emit.ravel(), [got.log, got.tokens]])
        at = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["place", "x"])

    total = sequences.mapInArrow(work, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow()
    shared.unpersist()
    flat = np.zeros(s + s * s + (c + 1) * s + 2)  # the size of the model, whatever the corpus
    flat[total.column("place").to_numpy()] = total.column("x").to_numpy()
    start, move, emit, last = np.split(flat, np.cumsum([s, s * s, (c + 1) * s]))
    return Expected(start, move.reshape(s, s), emit.reshape(c + 1, s), last[0], int(round(last[1])))


def improved(model: Model, vocab: Vocabulary, got: Expected) -> Model:
    """The model that the expected counts ask for, held by the priors."""
    s, seen = model.n_states, got.emit[:-1]
    # The base's one for every distinct word goes to the states as they are taken.
    ones = (vocab.mass - seen.sum(axis=1))[:, None] * seen.sum(axis=0) / seen.sum()
    emit = seen + ones + EMISSION_PRIOR * _base_classes(vocab)[:, None]
    return _model(vocab, got.start + TRANSITION_PRIOR / s,
                  got.move + TRANSITION_PRIOR * (0.5 * np.eye(s) + 0.5 / s), emit)


def _sequences(chunks: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Staged class sequences of the training texts, a row per chunk."""
    shared = chunks.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, data, offsets, _ in unpacked(batch):
                learn = _learns(ids)
                if not learn.any():
                    continue
                keys, counts = word_keys(data, offsets)
                uniq, inverse = np.unique(keys, return_inverse=True)
                tokens, lengths = _with_ends(shared.value.classes(uniq)[inverse], counts)
                tokens, lengths = tokens[np.repeat(learn, lengths)], lengths[learn]
                yield pa.record_batch([pa.array([lengths], pa.list_(pa.int64())), pa.array([tokens.astype(np.uint16).tobytes()], pa.binary())],
                                      names=["lens", "classes"])

    return stage(chunks.mapInArrow(work, "lens array<bigint>, classes binary"), "sequences", row_group=8 << 20)


def _with_ends(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences with the end (class 0) behind each text, and their lengths."""
    return np.insert(classes, np.cumsum(counts), 0), counts + 1


def train(chunks: DataFrame, vocab: Vocabulary, n_states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the training texts of ``chunks``."""
    model = first_model(vocab, n_states)
    if not vocab.n:
        return model
    sequences = _sequences(chunks, vocab)
    before = -math.inf
    for _ in range(rounds):
        got = _sums(sequences, model, vocab)
        model = improved(model, vocab, got)
        mean = got.log / got.tokens
        if mean - before < SETTLED:
            break
        before = mean
    drop(sequences)
    return model


# ---------------------------------------------------------------- scoring

def _asked(chunks: DataFrame, vocab: Vocabulary, n_buckets: int) -> DataFrame:
    """(bucket, chunk, keys): the words of each chunk that not every task knows, sorted."""
    shared = chunks.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, data, offsets, _ in unpacked(batch):
                uniq = np.unique(word_keys(data, offsets)[0])
                bucket, keys, cut = _by_bucket(uniq[~shared.value.find(uniq)[1]], n_buckets)
                ends = [*cut[1:].tolist(), len(keys)]
                yield pa.record_batch([
                    pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), chunk, np.int64)),
                    pa.array([keys[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=False)], pa.binary()),
                ], names=["bucket", "chunk", "keys"])

    return chunks.mapInArrow(work, "bucket int, chunk bigint, keys binary")


def _by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys dealt to buckets: the bucket of each, the keys by bucket, and where each bucket begins."""
    bucket = (keys >> U(16)) % U(n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, keys = bucket[order], keys[order]
    return bucket, keys, np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.empty(0, np.int64)


def _answered(asked: pa.Table, words: pa.Table) -> pa.Table:
    """(chunk, bucket, counts): the training count of each key that a chunk asked for, in its order."""
    keys, counts = words.column("key").to_numpy().view(U), words.column("n").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    out = []
    for raw in asked.column("keys"):
        want = np.frombuffer(raw.as_buffer(), U)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            n = np.where(keys[at] == want, counts[at], 0)
        else:
            n = np.zeros(len(want), np.int64)
        out.append(n.astype(np.int64).tobytes())
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "counts": pa.array(out, pa.binary())})


def _scored(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, model: Model, look_up) -> pa.RecordBatch:
    """The scores of a chunk's texts; ``look_up`` tells the counts of sorted keys that are not common."""
    keys, counts = word_keys(data, offsets)
    uniq, word = np.unique(keys, return_inverse=True)
    at, there = vocab.find(uniq)
    c = np.zeros(len(uniq), np.int64)
    c[there] = vocab.counts[at[there]]
    c[~there] = look_up(uniq[~there])
    known = c > 0
    classes = np.where(known, vocab.classes(uniq), vocab.unknown)
    # Within its class a known word has the share (c + 1) / mass; an unknown one and the end are all of theirs.
    inner = np.zeros(len(uniq))
    inner[known] = np.log(c[known] + 1.0) - np.log(vocab.mass[classes[known]])
    text = np.repeat(np.arange(len(counts)), counts)
    end = int(vocab.counts[vocab.keys == U(END_KEY)].sum())
    total = math.log(vocab.n + vocab.v + 1)
    base = np.bincount(text, weights=np.log(c + 1.0)[word], minlength=len(counts)) + math.log(end + 1) - (counts + 1) * total
    classes, known, inner = classes[word], known[word], inner[word]
    tokens, lengths = _with_ends(classes, counts)
    score = np.bincount(text, weights=inner, minlength=len(counts))
    if vocab.n:
        score = score + log_likelihoods(model, tokens, lengths)
    return pa.record_batch([
        ids.field("id"), pa.array(lengths.astype(np.int64)),
        pa.array((np.bincount(text, weights=known, minlength=len(counts)) + (end > 0)).astype(np.int64)),
        pa.array(base / math.log(10)), pa.array(score / math.log(10)),
    ], names=["id", "n_tokens", "n_known", "base_score", "score"])


def _looked_up(rare: np.ndarray, n_buckets: int, told: dict[int, bytes]) -> np.ndarray:
    """The counts of the sorted keys ``rare`` from what the buckets answered."""
    where, _, cut = _by_bucket(rare, n_buckets)
    out = np.empty(len(rare), np.int64)
    out[np.argsort((rare >> U(16)) % U(n_buckets), kind="stable")] = np.concatenate(
        [np.empty(0, np.int64), *(np.frombuffer(told[int(b)], np.int64) for b in where[cut])])
    return out


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", n_states: int = STATES,
                rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``; other columns are not read.

    Learns from the rows where ``learn`` holds (where it is null a row is learned from)
    and scores all.  Scores are logarithms to base 10; the base is the unigram model with
    one added to every count.  A null, empty or blank text is its end alone.  With nothing
    to learn from both scores are 0.  Repeated rows are texts of their own; ids are carried
    and may repeat or be null.  An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(True)).alias("learn")).alias("id"),
                       F.col(text_col).alias("text"))
    chunks = pack(rows, "id", "text")
    words = _counted(chunks)
    vocab = _vocabulary(words)
    model = train(chunks, vocab, n_states, rounds)
    # A key is eight bytes; texts hold one that is not common per two dozen bytes or fewer.
    n_buckets = buckets_for(total_bytes(chunks) // 24)
    bucket = F.pmod(F.shiftrightunsigned("key", 16), F.lit(n_buckets)).cast("int").alias("bucket")
    uncommon = words.where(F.col("n") * KNOWN_SHARE < vocab.n).select(bucket, "key", "n")
    answers = stage(_asked(chunks, vocab, n_buckets).groupBy("bucket").cogroup(uncommon.groupBy("bucket")).applyInArrow(
        _answered, "chunk bigint, bucket int, counts binary"), "answers")
    told = tell(chunks, answers.select("chunk", F.struct("bucket", "counts").alias("answer")), "answer")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        for batch in batches:
            for _, ids, data, offsets, found in unpacked(batch, ("answer",)):
                told = {x["bucket"]: x["counts"] for x in found[0]}
                got = _scored(ids, data, offsets, vocab, model, lambda rare, told=told: _looked_up(rare, n_buckets, told))
                held = pa.array(~_learns(ids))
                yield pa.record_batch([got.column(0), held, got.column(1), got.column(2), pa.array(np.full(len(ids), vocab.n, np.int64)),
                                       got.column(3), got.column(4)],
                                      names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return told.mapInArrow(work, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                 "base_score double, score double")


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    return score_texts(docs, learn).withColumnRenamed("id", "doc_id")
