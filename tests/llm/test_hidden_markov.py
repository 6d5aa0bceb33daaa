import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecat.llm import hidden_markov as hm
from codecat.llm.repeats import pack

SPACE = " \t\n\r\v\f"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def learn(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2


def tiny(n_states=3, n_classes=5, seed=0):
    rng = np.random.default_rng(seed)
    one = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.1)
    return hm.Model(one(n_states), one(n_states, n_states), one(n_states, n_classes).T.copy())


def all_paths(model, seq):
    """Likelihood, and expected counts of starts, moves and emissions, by enumeration of every path."""
    s = model.n_states
    total, start, move, emit = 0.0, np.zeros(s), np.zeros((s, s)), np.zeros_like(model.emit)
    for path in itertools.product(range(s), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for c, b in zip(seq, path):
            emit[c, b] += p
    return total, start / total, move / total, emit / total


@pytest.mark.parametrize("piece", [1, 2, 3, 2048])
def test_recursions_equal_enumeration(monkeypatch, piece):
    """Exact likelihoods and counts, texts cut into pieces or whole, in groups of any size."""
    monkeypatch.setattr(hm, "PIECE", piece)
    monkeypatch.setattr(hm, "TOGETHER", 12)
    rng, model = random.Random(1), tiny()
    texts = [[rng.randrange(4) for _ in range(n)] for n in (1, 2, 7, 3, 6, 1, 5, 4)]
    tokens, lengths = np.array([x for t in texts for x in t]), np.array([len(t) for t in texts])
    want = [all_paths(model, t) for t in texts]
    assert np.allclose(hm.log_likelihoods(model, tokens, lengths), [math.log(w[0]) for w in want])
    got = hm.Expected.none(3, 4)
    got.add(model, tokens, lengths)
    assert np.allclose(got.start, sum(w[1] for w in want))
    assert np.allclose(got.move, sum(w[2] for w in want))
    assert np.allclose(got.emit, sum(w[3] for w in want))
    assert got.tokens == len(tokens) and np.isclose(got.log, sum(math.log(w[0]) for w in want))


@pytest.mark.parametrize("piece", [3, 2048])
def test_counts_in_single_precision(monkeypatch, piece):
    monkeypatch.setattr(hm, "PIECE", piece)
    rng = np.random.default_rng(4)
    model = hm.Model(*(x.copy() for x in (tiny().start, tiny().move, tiny().emit)))
    model.emit[2] *= 1e-12  # a class that is hardly ever emitted
    lengths = np.array([700, 1, 33, 260])
    tokens = rng.integers(0, 4, lengths.sum())
    exact, single = hm.Expected.none(3, 4), hm.Expected.none(3, 4)
    exact.add(model, tokens, lengths)
    single.add(model.single(), tokens, lengths)
    assert np.allclose(exact.emit, single.emit, rtol=1e-3, atol=1e-3) and np.allclose(exact.move, single.move, rtol=1e-3, atol=1e-3)
    assert np.isclose(exact.log, single.log, rtol=1e-5)


def test_long_sequences_do_not_underflow():
    model = tiny()
    tokens = np.random.default_rng(3).integers(0, 4, 50_000)
    whole = hm.log_likelihoods(model, tokens, np.array([len(tokens)]))[0]
    log, a = 0.0, model.start
    for k, c in enumerate(tokens.tolist()):
        a = (a if k == 0 else a @ model.move) * model.emit[c]
        log, a = log + math.log(a.sum()), a / a.sum()
    assert np.isclose(whole, log, rtol=1e-10)


def brute_base(rows):
    count = Counter(w for i, t in rows if learn(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    return n, {i: (len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]),
                   sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t in rows}


def corpus_rows():
    rng = random.Random(9)
    kinds = [[f"{a}{b}" for a in "abcdefgh" for b in ("ing", "ed")], [f"{a}{b}" for a in "rstuvwx" for b in ("ux", "é")]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "never seen words"), (904, "AING aing Rux"), (None, "aing ring"), (905, rows[3][1])]


@pytest.fixture(scope="module")
def table(sp):
    rows = corpus_rows()
    return rows, sp.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(5)


@pytest.mark.parametrize("known", [hm.KNOWN_SHARE, 20, 0.5])
def test_base_equals_plain_counts(table, monkeypatch, known):
    """Also where most words, or all, are looked up instead of known to every task."""
    monkeypatch.setattr(hm, "KNOWN_SHARE", known)
    monkeypatch.setattr(hm, "OWN_SHARE", min(20, known))
    rows, docs = table
    n, want = brute_base(rows)
    got = hm.score_texts(docs, fold(), rounds=1).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens, seen, base = want[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, seen, n, not learn(r.id))
        assert abs(r.base_score - base) < 1e-9


def test_one_state_is_the_base(table):
    for r in hm.score_texts(table[1], fold(), n_states=1).collect():
        assert abs(r.score - r.base_score) < 1e-9


def test_training_gains_and_beats_the_base_on_held_out_texts(table):
    rows, docs = table
    chunks = pack(docs.select(F.struct(F.col("doc_id").alias("id"), F.coalesce(fold(), F.lit(True)).alias("learn")).alias("id"), "text"), "id", "text")
    vocab = hm._vocabulary(hm._counted(chunks))
    sequences, model, logs = hm._sequences(chunks, vocab), hm.first_model(vocab, 4), []
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    for _ in range(5):
        got = hm._sums(sequences, model, vocab)
        assert got.tokens == vocab.n and np.isclose(got.emit.sum(), vocab.n, rtol=1e-4)
        logs.append(got.log)
        model = hm.improved(model, vocab, got)
    assert logs == sorted(logs)
    got = [r for r in hm.score_texts(docs, fold()).collect() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


def test_probabilities_of_one_word_texts_add_up(table):
    """Over all known words and the unknown one, after the start, the word's shares are a distribution."""
    rows, docs = table
    count = sorted({w for i, t in rows if learn(i) for w in words(t)})
    spark = docs.sparkSession
    probe = spark.createDataFrame([(10**6 + k, w, 0.0) for k, w in enumerate([*count, "unseen"])], docs.schema)
    learned = docs.withColumn("learn", F.coalesce(fold(), F.lit(True))).unionByName(probe.withColumn("learn", F.lit(False)))
    chunks = pack(learned.select(F.struct(F.col("doc_id").alias("id"), "learn").alias("id"), "text"), "id", "text")
    vocab = hm._vocabulary(hm._counted(chunks))
    model = hm.train(chunks, vocab, 3, 3)
    total = model.emit[:-1].sum(axis=0) + model.emit[-1]
    assert np.allclose(total, 1)
    inner = np.zeros(vocab.n_classes)
    np.add.at(inner, vocab.classes(vocab.keys[vocab.keys != 0]), vocab.counts[vocab.keys != 0] + 1)
    assert np.allclose(inner[1:], vocab.mass[1:])


def test_nothing_to_learn_and_empty_table(sp):
    docs = sp.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.id: r for r in hm.score_texts(docs, F.lit(False)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score, got[1].score) == (3, 0, 0, 0.0, 0.0)
    assert hm.score_texts(docs.where("false"), F.lit(True)).count() == 0
