"""Language identification against a brute-force version: kernels by sets, ridge regression over all sample rows at once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codecat.llm import language_id as L

ODD = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}
VOCABULARY = {"aa": "the and of house water tree old stone river über", "bb": "de la que casa agua viejo árbol piedra río más",
              "cc": "и в не дом вода старый камень река дерево на"}


def grams(text):
    """Hashed n-grams of a text by order; what is no letter counts as a space."""
    b = bytes(c if 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A or c >= 0x80 else 0x20 for c in text.lower().encode())
    return {n: {(int.from_bytes(b[i:i + n], "little") * ODD[n] % 2**32) >> 14 for i in range(len(b) - n + 1)} for n in (2, 3, 4)}


def brute(texts, langs, landmarks, queries):
    """Scores of ``queries`` (queries x languages) by the definition."""
    marks = [grams(t) for t in landmarks]
    columns = {n: {g for m in marks for g in m[n] if sum(g in x[n] for x in marks) > 1} for n in (2, 3, 4)}

    def rows(ts):
        own = [{n: g[n] & columns[n] for n in g} for g in map(grams, ts)]
        mark = [{n: m[n] & columns[n] for n in m} for m in marks]
        return np.array([[sum(len(a[n] & b[n]) / (max(len(a[n]) * len(b[n]), 1) ** 0.5) for n in (2, 3, 4)) / 3 for b in mark] for a in own])
    names = sorted(set(langs))
    value, vector = np.linalg.eigh(rows(landmarks))
    use = value > 1e-6 * value.max()
    whiten = vector[:, use] / np.sqrt(value[use])
    x = rows(texts) @ whiten
    y = np.array([[float(name == lang) for name in names] for lang in langs])
    w = np.array([1 / langs.count(lang) for lang in langs])[:, None]
    return rows(queries) @ whiten @ np.linalg.solve(x.T @ (x * w) + L.RIDGE * np.eye(x.shape[1]), x.T @ (y * w))


def corpus(n, seed):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(rng.randint(1, 30))), lang) for lang in VOCABULARY for _ in range(n)]


def scores(model, texts):
    return model.scores(*L._lowered(pa.array(texts, pa.string())))


def test_equals_brute_force(sp, monkeypatch):
    monkeypatch.setattr(L, "LANDMARKS", 12)
    data = list(dict.fromkeys(corpus(12, 1)))  # no more texts than landmarks: the choice leaves nothing out
    docs = sp.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(data)], "doc_id long, text string, lang string").repartition(5)
    model = L.fit(docs, F.lit(True))
    texts, langs = [t for t, _ in data], [lang for _, lang in data]
    queries = [t for t, _ in corpus(4, 2)] + ["", "x", "QQ the Água 12 дом" * 9]
    want = brute(texts, langs, texts, queries)
    assert model.languages == sorted(VOCABULARY) and np.allclose(scores(model, queries), want, atol=1e-3)
    whole = scores(model, queries)
    for name, small in (("_PIECE", 5), ("_CELLS", 1), ("_WIDTH", 7)):  # room only, no other result
        monkeypatch.setattr(L, name, small)
        assert np.allclose(scores(model, queries), whole, atol=1e-5)


def test_every_ngram_is_a_column():
    """However many n-grams two landmarks share, all are columns."""
    held = [np.arange(0, 600_000, dtype=np.uint32), np.arange(100_000, 786_432, dtype=np.uint32)]
    assert L._columns(held, ["a"]).blocks[-1] == 500_000


def test_long_texts_repeats_and_other_columns(sp):
    """A language of long texts only is learnt; one row repeated thousands of times is one sample text; names may clash."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate(corpus(20, 3)) if lang != "cc"]
    rows += [(1000 + i, (t + " ") * 900, lang) for i, (t, lang) in enumerate(corpus(8, 4)) if lang == "cc"]
    rows = [(i, t if lang != "cc" else t + " вода" * 5000, lang) for i, t, lang in rows]
    rows += [(None, "the and of", "aa")] * 3000 + [(7, None, "aa"), (8, "de la", None), (9, "12 !", "bb")]
    docs = sp.createDataFrame([(*r, "key", "rank", "id") for r in rows],
                              "doc_id long, text string, lang string, `key` string, `rank` string, id string").repartition(4)
    sample = L._sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert sample.where("text = 'the and of'").count() == 1 and sample.where("lang = 'aa'").count() == 21
    model = L.fit(docs, F.lit(True))
    assert model.languages == ["aa", "bb", "cc"]
    out = L.predict(docs.where("text IS NOT NULL"), model)
    assert out.where("lang IS NOT NULL AND lang <> lang_pred AND lang_pred <> 'und'").isEmpty() and {"key", "rank", "id"} < set(out.columns)
    assert out.where("lang_pred = 'cc'").count() == 8
