"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes forwards and backwards; at every position a softmax
over both states gives the probabilities of the languages, and a document's are the mean over all its positions.
Training is backpropagation through time in numpy on the driver, over pieces of a bounded sample of
labelled texts. For prediction, texts are cut into pieces of PIECE bytes, each read with WARM bytes of its
neighbourhood on either side, so every byte of a text is labelled once and pieces of many texts are one matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, short_batches, text_bytes, unused

HIDDEN, PIECE, WARM = 8, 64, 8
#: Bound of the training sample: so many labelled texts a language, of which so many bytes each.
SAMPLE_TEXTS, SAMPLE_BYTES = 150, 4000
#: Languages that are learned: those with the most labelled texts. With the bounds above, the sample is 150 MB at most.
MOST_LANGUAGES = 256
STEPS, BATCH, LENGTH = 260, 192, 40
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    """e: (256, 3H) inputs of update, reset and candidate gates; u: (H, 3H) from the state; both a direction. o: (2H, C), c: (C,)."""

    languages: list[str]
    e: list[np.ndarray]
    u: list[np.ndarray]
    o: np.ndarray
    c: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(e: np.ndarray, u: np.ndarray, x: np.ndarray) -> list[tuple]:
    """x: (L, B) bytes. For each step: the state before, gates z and r, candidate, and the state after, (B, H) each."""
    hid = u.shape[0]
    h = np.zeros((x.shape[1], hid), e.dtype)
    out = []
    for t in range(len(x)):
        a = e[x[t]]
        g = _sigmoid(a[:, : 2 * hid] + h @ u[:, : 2 * hid])
        z, r = g[:, :hid], g[:, hid:]
        n = np.tanh(a[:, 2 * hid :] + (r * h) @ u[:, 2 * hid :])
        after = h + z * (n - h)
        out.append((h, z, r, n, after))
        h = after
    return out


def _backward(e: np.ndarray, u: np.ndarray, x: np.ndarray, steps: list[tuple], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of e and u by backpropagation through time; d: (L, B, H) from the outputs."""
    hid = u.shape[0]
    ge, gu = np.zeros_like(e), np.zeros_like(u)
    dh = np.zeros_like(steps[0][0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, _ = steps[t]
        dh = dh + d[t]
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h) * z * (1 - z)
        drh = dn @ u[:, 2 * hid :].T
        dr = drh * h * r * (1 - r)
        da = np.concatenate([dz, dr, dn], axis=1)
        gu[:, : 2 * hid] += h.T @ da[:, : 2 * hid]
        gu[:, 2 * hid :] += (r * h).T @ dn
        one = np.zeros((256, len(da)), e.dtype)
        one[x[t], np.arange(len(da))] = 1
        ge += one @ da
        dh = dh * (1 - z) + drh * r + da[:, : 2 * hid] @ u[:, : 2 * hid].T
    return ge, gu


def train(rows: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 7) -> Model:
    """rows: (language, text). One language gives a model that always answers it."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    number = {x: i for i, x in enumerate(languages)}
    by = [[np.frombuffer(t, np.uint8) for lang, t in rows if number[lang] == i and len(t)] for i in range(len(languages))]
    weights = [rng.normal(0, 0.3, s).astype(np.float32) for s in ((256, 3 * HIDDEN), (256, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (2 * HIDDEN, len(languages)), (len(languages),))]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    full = [i for i, texts in enumerate(by) if texts]
    for step in range(1, steps + 1 if len(full) > 1 else 1):
        x, y = np.full((BATCH, LENGTH), 32, np.uint8), rng.choice(full, BATCH)
        for i, lang in enumerate(y):
            t = by[lang][rng.integers(len(by[lang]))]
            at = rng.integers(max(1, len(t) - LENGTH + 1))
            piece = t[at : at + LENGTH]
            x[i, : len(piece)] = piece
        xt, back = x.T, x.T[::-1]
        f, b = _forward(weights[0], weights[2], xt), _forward(weights[1], weights[3], back)
        state = np.concatenate([np.stack([s[4] for s in f]), np.stack([s[4] for s in b])[::-1]], axis=2)
        logits = state @ weights[4] + weights[5]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        p /= p.shape[0] * p.shape[1]
        flat = p.reshape(-1, len(languages))
        d = p @ weights[4].T
        g0, g2 = _backward(weights[0], weights[2], xt, f, d[:, :, :HIDDEN])
        g1, g3 = _backward(weights[1], weights[3], back, b, d[::-1, :, HIDDEN:])
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate((g0, g1, g2, g3, state.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            weights[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, weights[:2], weights[2:4], weights[4], weights[5])


def _states(e: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States after each step, (L, H, B); as _forward, laid out for long rows and without allocation in the loop."""
    hid = u.shape[0]
    length, n = x.shape
    # With tanh alone: the halves of the update and reset gates' inputs are scaled beforehand.
    e, u = e.T.copy(), u.T.copy()
    e[: 2 * hid] *= 0.5
    u[: 2 * hid] *= 0.5
    gates, cand = u[: 2 * hid], u[2 * hid :]
    out = np.empty((length, hid, n), np.float32)
    h, a = np.zeros((hid, n), np.float32), np.empty((3 * hid, n), np.float32)
    g, c = np.empty((2 * hid, n), np.float32), np.empty((hid, n), np.float32)
    for t in range(length):
        np.take(e, x[t], axis=1, out=a, mode="clip")
        np.matmul(gates, h, out=g)
        g += a[: 2 * hid]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        z, r = g[:hid], g[hid:]
        r *= h
        np.matmul(cand, r, out=c)
        c += a[2 * hid :]
        np.tanh(c, out=c)
        c -= h
        c *= z
        np.add(h, c, out=out[t])
        h = out[t]
    return out


def positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (L, C, B) of the languages at every position of x (L, B) bytes."""
    f, b = _states(model.e[0], model.u[0], x), _states(model.e[1], model.u[1], x[::-1])[::-1]
    wf, wb = model.o[:HIDDEN].T.copy(), model.o[HIDDEN:].T.copy()
    p = np.matmul(wf, f)
    p += np.matmul(wb, b)
    p += model.c[None, :, None]
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def pooled(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean probabilities over all bytes of each text, (texts, C); zero for empty ones."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    pieces = -(-size // PIECE)
    doc = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = at[:-1][doc] + number * PIECE
    out = np.zeros((len(size), len(model.languages)))
    step = 2048
    steps = np.arange(-WARM, PIECE + WARM)[:, None]
    for i in range(0, len(doc), step):
        d, s = doc[i : i + step], begin[i : i + step]
        where = s[None, :] + steps
        inside = (where >= at[d]) & (where < at[d + 1])
        x = np.where(inside, data[np.clip(where, 0, max(0, len(data) - 1))], np.uint8(32))
        p = positions(model, x)[WARM:-WARM]
        p *= inside[WARM:-WARM, None, :]
        np.add.at(out, d, p.sum(0).T)
    return out / np.maximum(size, 1)[:, None]


def sample(docs: DataFrame, learn: Column) -> list[tuple[str, bytes]]:
    """Of each language, the SAMPLE_TEXTS texts with the smallest hash of doc_id (ties: doc_id, then the text) where learn holds, from each a piece of SAMPLE_BYTES bytes at most; of MOST_LANGUAGES languages."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).select("lang")
    rows = rows.join(F.broadcast(most), "lang", "left_semi")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    rows = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring(text_bytes(), 1, SAMPLE_BYTES).alias("t"))
    # The rank's limit goes before the exchange, so a task sends that many rows of a language at most.
    return [(r["lang"], bytes(r["t"])) for r in rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_TEXTS).orderBy("lang", "k").select("lang", "t").collect()]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, lang_pred, score for every row.

    Learns from rows where learn holds (not held_out() by default) and lang is not null. lang_pred is `und` with score 0 if the text
    is null or has no letter, or if there is nothing to learn from; else the language of the largest mean probability over all bytes. Bytes that are no UTF-8 are read as they are, and are no letters.
    """
    model = learned(docs, learn)

    def work(batches):
        for batch in batches:
            for i, j, names, scores in _named(model, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), names, scores], names=["doc_id", "lang_pred", "score"])

    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def learned(docs: DataFrame, learn: Column | None = None) -> Model:
    found = sample(docs.select("doc_id", "text", "lang"), ~held_out() if learn is None else learn)
    return train(found) if found else Model([], [], [], np.zeros(0), np.zeros(0))


def _named(model: Model, bodies: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """For ranges of texts: their languages and scores."""
    for i, j in chunks(bodies):
        texts = bodies.slice(i, j - i)
        if model.languages:
            p = pooled(model, texts)
            best = p.argmax(1)
            names, scores = [model.languages[k] for k in best], np.clip(p[np.arange(len(p)), best], 0, 1)
        else:
            names, scores = [UNKNOWN] * (j - i), np.zeros(j - i)
        letters = [bool(_LETTER.search(x.decode("utf-8", "replace"))) for x in texts.to_pylist()]
        names = [x if y else UNKNOWN for x, y in zip(names, letters, strict=True)]
        yield i, j, pa.array(names, pa.string()), pa.array(np.where(letters, scores, 0.0))


def labelled(docs: DataFrame, name: str = "lang_pred", score: str = "score", learn: Column | None = None) -> DataFrame:
    """docs with the language and score of each row's own text beside its columns, in one pass without a shuffle; columns of these names are replaced."""
    model = learned(docs, learn)
    (body,) = unused(docs, "_body")
    kept = docs.drop(name, score)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])

    def work(batches):
        for batch in batches:
            for i, j, names, scores in _named(model, batch.column(batch.num_columns - 1)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], names, scores], names=schema.names)

    # By place, as columns may have any names.
    return short_batches(kept).withColumn(body, text_bytes()).toDF(*(f"c{k}" for k in range(len(schema) - 1))).mapInArrow(work, schema)


#: Mean probability from which a prediction overrules a document's own label.
SURE = 0.95


def keep_known(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """docs without the rows that get no language, each judged by its own text; all columns stay.

    lang becomes the predicted one where it is null, or where it is another one and the score is `sure` or more.
    """
    name, score = unused(docs, "_lang", "_score")
    kept = labelled(docs, name, score).where(F.col(name) != UNKNOWN)
    return kept.withColumn("lang", F.when(F.col("lang").isNull() | (F.col(score) >= sure), F.col(name)).otherwise(F.col("lang"))).select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["Model", "cut", "held_out", "identify", "keep_known", "labelled", "learned", "positions", "sample", "train"]
