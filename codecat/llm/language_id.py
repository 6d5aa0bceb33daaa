"""Language identification with string kernels.

Two texts are compared by the byte n-grams (2 to 4) that both hold: for each n
the cosine of their presence vectors, averaged over n (a blended-spectrum
presence kernel).  N-grams are hashed, and all that at least two landmarks hold
are columns.  Landmark texts span the feature space (Nyström), ridge regression
in it learns one scorer per language against the rest, and whole texts are scored
in batches: presence matrix times (landmark matrix times weights), which is one
matrix of columns by languages.

The fit uses a bounded sample, ``SAMPLE`` labelled texts of each language, taken by
hash order; texts of over ``SAMPLE_CHARS`` characters only where a language has too
few others.  The first ``LANDMARKS`` of them are landmarks.  The driver gets the
n-grams of the landmarks and sums over the sample, never its texts.  Prediction
covers every row, over its whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import drop, stage
from .textblocks import laid_out, slices

SAMPLE, LANDMARKS, SAMPLE_CHARS = 300, 32, 20_000
ORDERS = (2, 3, 4)
_BITS = 18
RIDGE = 1e-3
_SHARPNESS = 4.0
_PARTS = 16
# Room: bytes of text whose n-grams are made at once, cells of a presence matrix, columns of a product.
_PIECE, _CELLS, _WIDTH = 1 << 20, 1 << 25, 1 << 12
_ODD = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}
# Letters and bytes of longer characters stay; all else counts as a space.
_CLEAN = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _CLEAN[_lo:_hi] = np.arange(_lo, _hi)
UNDETERMINED = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and hashed n-grams tagged with their order, in pieces, so that a long text needs little room."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for at in range(0, len(data), _PIECE):
        clean = _CLEAN[data[at: at + _PIECE + max(ORDERS) - 1]].astype(np.uint32)
        row = rows[at: at + len(clean)]
        code = clean
        for k in range(1, max(ORDERS)):
            code = code[:-1] | (clean[k:] << np.uint32(8 * k))
            if k + 1 in ORDERS and len(code):
                inside = (row[: len(code)] == row[k:])[:_PIECE]
                bucket = (code[:_PIECE] * np.uint32(_ODD[k + 1])) >> np.uint32(32 - _BITS)
                yield row[: len(inside)][inside], bucket[inside] + np.uint32(ORDERS.index(k + 1) << _BITS)


@dataclass
class Model:
    column: np.ndarray  # of each hashed n-gram, or -1
    blocks: list[int]  # first column of each order, and the number of all
    landmarks: list[np.ndarray]  # the columns that each landmark holds
    languages: list[str]
    scorer: np.ndarray | None = None  # columns x languages

    def _presence(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """The presence of the columns in rows i to j of a batch, for as many rows at a time as fit ``_CELLS``."""
        width = self.blocks[-1]
        step = max(1, _CELLS // max(width, 1))
        for i in range(0, len(offsets) - 1, step):
            j = min(i + step, len(offsets) - 1)
            seen = np.zeros((j - i) * width, np.uint8)
            for row, gram in _grams(data[offsets[i]: offsets[j]], offsets[i: j + 1]):
                column = self.column[gram]
                known = column >= 0
                seen[row[known].astype(np.int64) * width + column[known]] = 1
            yield i, j, seen.reshape(j - i, width)

    def _parts(self) -> Iterator[tuple[int, int, int]]:
        """(order, first column, last column) of pieces of the columns."""
        for order, (a, b) in enumerate(zip(self.blocks[:-1], self.blocks[1:], strict=True)):
            for c in range(a, b, _WIDTH):
                yield order, c, min(c + _WIDTH, b)

    def product(self, data: np.ndarray, offsets: np.ndarray, width: int, right: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """Presence vectors, of unit length in each order, times a matrix whose rows a to b are ``right(a, b)``."""
        out = np.zeros((len(offsets) - 1, width))
        for i, j, seen in self._presence(data, offsets):
            norm = [_norm(seen[:, a:b].sum(axis=1)) for a, b in zip(self.blocks[:-1], self.blocks[1:], strict=True)]
            for order, a, b in self._parts():
                out[i:j] += (seen[:, a:b].astype(np.float32) @ right(a, b)) / norm[order][:, None]
        return out

    def landmark_rows(self) -> Callable[[int, int], np.ndarray]:
        """Rows a to b of the matrix columns x landmarks, made from the columns that each landmark holds."""
        norm = [[_norm(np.diff(np.searchsorted(held, [x, y]))[0]) for held in self.landmarks]
                for x, y in zip(self.blocks[:-1], self.blocks[1:], strict=True)]

        def rows(a: int, b: int) -> np.ndarray:
            order = int(np.searchsorted(self.blocks, a, "right")) - 1
            out = np.zeros((b - a, len(self.landmarks)), np.float32)
            for x, held in enumerate(self.landmarks):
                first, last = np.searchsorted(held, [a, b])
                out[held[first:last] - a, x] = 1 / norm[order][x]
            return out
        return rows

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.product(data, offsets, len(self.landmarks), self.landmark_rows())

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.product(data, offsets, len(self.languages), lambda a, b: self.scorer[a:b])


def _norm(count: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(count * float(len(ORDERS)), 1))


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return laid_out(pc.utf8_lower(texts))


def _columns(held: list[np.ndarray], languages: list[str]) -> Model:
    """The columns, from the distinct n-grams that each landmark holds."""
    gram, count = np.unique(np.concatenate(held or [np.empty(0, np.uint32)]), return_counts=True)
    gram = gram[count > 1].astype(np.int64)
    column = np.full(len(ORDERS) << _BITS, -1, np.int32)
    column[gram] = np.arange(len(gram))
    blocks = [int(x) for x in np.searchsorted(gram, [i << _BITS for i in range(len(ORDERS) + 1)])]
    own = [column[h] for h in held]
    return Model(column, blocks, [np.sort(c[c >= 0]) for c in own], languages)


def _solve(model: Model, gram: np.ndarray, aimed: np.ndarray) -> Model:
    """One-versus-rest ridge regression on the Nyström features, from sums over the sample of the kernel rows k:
    ``gram`` of k k' and ``aimed`` of k times its language, both weighted."""
    rows = model.landmark_rows()
    among = np.zeros((len(model.landmarks),) * 2)
    for _, a, b in model._parts():
        part = rows(a, b).astype(float)
        among += part.T @ part
    value, vector = np.linalg.eigh(among)
    use = value > 1e-6 * max(value.max(initial=0), 1e-12)
    whiten = vector[:, use] / np.sqrt(value[use])
    weights = whiten @ np.linalg.solve(whiten.T @ gram @ whiten + RIDGE * np.eye(int(use.sum())), whiten.T @ aimed)
    model.scorer = np.concatenate([(rows(a, b) @ weights).astype(np.float32) for _, a, b in model._parts()]
                                  or [np.empty((0, len(model.languages)), np.float32)])
    return model


def _sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, rank, text): at most ``SAMPLE`` labelled texts of each language, each of them once, written as a table."""
    rows = docs.where(learn & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").rlike("\\p{L}")).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("id", F.xxhash64("text")))
    # The ranking moves hashes, not texts; repeated rows are one text.
    ranked = keyed.groupBy("lang", "key").agg(F.min(F.length("text") > SAMPLE_CHARS).alias("long"))
    # First within parts of a language, so that its last ranking sees _PARTS * SAMPLE keys at most.
    for by in (["lang", F.pmod("key", F.lit(_PARTS))], ["lang"]):
        order = Window.partitionBy(*by).orderBy("long", "key")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE)
    chosen = ranked.select("lang", "key", "rank")
    # At most SAMPLE rows of each language, a few bytes each.
    return stage(keyed.join(F.broadcast(chosen), ["lang", "key"]).select("lang", "rank", "text").dropDuplicates(["lang", "rank"]), "language-sample")


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the rows of ``docs`` where ``learn`` holds; None without any labelled text."""
    sample = _sample(docs, learn, id_col, text_col, lang_col)
    texts_of = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}  # one row per language
    if not texts_of:
        drop(sample)
        return None

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data, offsets = _lowered(batch.column(2).slice(r, 1))
                seen = np.zeros(len(ORDERS) << _BITS, bool)
                for _, gram in _grams(data, offsets):
                    seen[gram] = True
                yield pa.record_batch([*(batch.column(c).slice(r, 1) for c in (0, 1)),
                                       pa.array([np.flatnonzero(seen).astype(np.uint32).tobytes()], pa.binary())], names=["lang", "rank", "grams"])

    marks = sample.where(F.col("rank") <= LANDMARKS).mapInArrow(held, "lang string, rank int, grams binary")
    grams = [np.frombuffer(r["grams"], np.uint32) for r in sorted(marks.collect(), key=lambda r: (r["lang"], r["rank"]))]
    model = _columns(grams, sorted(texts_of))
    number = {lang: i for i, lang in enumerate(model.languages)}
    n, m = len(grams), len(number)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + m))
        for batch in batches:
            data, offsets = _lowered(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                k = model.kernel(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                # Every language weighs the same, however many sample texts it has.
                k_weighted = k / np.array([texts_of[x] for x in langs[i:j]], float)[:, None]
                total[:, :n] += k.T @ k_weighted
                for r, lang in enumerate(langs[i:j]):
                    total[:, n + number[lang]] += k_weighted[r]
        if total.any():
            for i in range(0, n, 64):
                yield pa.record_batch([pa.array(range(i, min(i + 64, n)), pa.int32()),
                                       pa.array([x.tobytes() for x in total[i: i + 64]], pa.binary())], names=["i", "part"])

    def added(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("part").to_pylist())
        return pa.table({"i": table.column("i").slice(0, 1), "part": pa.array([sum(np.frombuffer(p) for p in parts).tobytes()], pa.binary())})

    shape = "i int, part binary"
    got = sample.select("lang", "text").mapInArrow(sums, shape).groupBy("i").applyInArrow(added, shape).collect()  # one row per landmark
    total = np.zeros((n, n + m))
    for r in got:
        total[r["i"]] = np.frombuffer(r["part"])
    drop(sample)
    return _solve(model, total[:, :n], total[:, n:])


def _judged(texts: pa.Array, model: Model | None) -> tuple[list[str], list[float]]:
    data, offsets = _lowered(texts)
    pred, score = [], []
    for i, j in slices(offsets):
        part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        letter = np.append(0, np.cumsum(_CLEAN[part] != 0x20))
        ascii_letter = np.append(0, np.cumsum((_CLEAN[part] != 0x20) & (part < 0x80)))
        has, sure = letter[at[1:]] > letter[at[:-1]], ascii_letter[at[1:]] > ascii_letter[at[:-1]]
        for r in np.flatnonzero(has & ~sure):
            has[r] = any(c.isalpha() for c in part[at[r]: at[r + 1]].tobytes().decode())
        if model is None:
            pred += [UNDETERMINED] * (j - i)
            score += [0.0] * (j - i)
            continue
        out = model.scores(part, at).astype(float)
        best = out.argmax(axis=1)
        chance = np.exp(_SHARPNESS * (out - out.max(axis=1, keepdims=True)))
        chance = 1 / chance.sum(axis=1)
        pred += [model.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
        score += [float(c) if h else 0.0 for c, h in zip(chance, has, strict=True)]
    return pred, score


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The other columns of ``docs`` with the predicted language and its score (0 to 1).

    A null text, or one without any letter, is ``und`` with score 0; so is every
    text if there was nothing to learn from.  Equal scores go to the language that
    sorts first.  An empty table gives an empty result.
    """
    if model is not None:
        model = replace(model, landmarks=[])  # tasks get the columns and the scorer
    rest = [c for c in docs.columns if c not in (text_col, lang_out, score_out)]
    frame = docs.select(*(f"`{c}`" for c in rest), f"`{text_col}`")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = _judged(batch.column(len(rest)), model)
            yield pa.record_batch([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                  names=[*rest, lang_out, score_out])

    schema = docs.select(*(f"`{c}`" for c in rest)).schema.add(lang_out, "string").add(score_out, "double")
    return frame.mapInArrow(apply, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs, fold != 2)
    return predict(docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), model)
