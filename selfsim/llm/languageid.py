"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, over words and white space alike, and labels every byte
position; a document's probabilities are the mean over all its positions. Texts are
read in windows of WINDOW bytes, side by side, so that a text of any length takes as much memory as
another; each window is entered CONTEXT bytes before its first and left CONTEXT bytes behind
its last position; outside a text the state is zero.

Training (numpy, backpropagation through time, Adam) runs on the driver over the whole texts of a
bounded sample of labelled rows: PER_LANGUAGE documents of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selfsim.llm.common import pieces_of, small_batches, stored, texts_of

#: Labelled rows of each language in the training sample, and the languages that are learned, those with most labelled rows.
PER_LANGUAGE, MOST_LANGUAGES = 100, 256
WINDOW, CONTEXT = 512, 32
#: Bytes of the windows that training reads.
LESSON = 64
HIDDEN = 12
#: Stands for a place outside the text, where the state is zero.
OUTSIDE = 256
UNKNOWN = "und"
#: Share of the way from chance to certainty that a text's score must go for ``reject`` to keep it.
MARGIN = 0.1


@dataclass
class Gru:
    """One direction: x (symbols) indexes the rows of wx (257, 3H: update, reset, candidate)."""

    wx: np.ndarray
    u: np.ndarray

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, H, N) after each position of x (T, N); with keep also what the backward pass needs."""
        t, n = x.shape
        size = self.u.shape[0]
        half, ut, outside = np.float32(0.5), np.ascontiguousarray(self.u.T), x == OUTSIDE
        h, out, tape = np.zeros((size, n), np.float32), np.empty((t, size, n), np.float32), []
        rows, b, c = np.empty((n, 3 * size), np.float32), np.empty((3 * size, n), np.float32), np.empty((size, n), np.float32)
        for k in range(t):
            np.take(self.wx, x[k], 0, out=rows, mode="clip")
            a = rows.T
            np.matmul(ut, h, out=b)
            gates, bn = b[: 2 * size], b[2 * size :]
            gates += a[: 2 * size]
            gates *= half
            np.tanh(gates, out=gates)
            gates += np.float32(1)
            gates *= half
            z, r = gates[:size], gates[size:]
            np.multiply(r, bn, out=c)
            c += a[2 * size :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z.copy(), r.copy(), c.copy(), bn.copy()))
            h = h - c
            h *= z
            h += c
            if outside[k].any():
                h *= ~outside[k]
            out[k] = h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of wx and u, from those of the states."""
        size, n = dout.shape[1:]
        dwx, du, dh, das = np.zeros_like(self.wx), np.zeros_like(self.u), np.zeros_like(dout[0]), np.empty((*x.shape, 3 * size), np.float32)
        for k in range(len(tape) - 1, -1, -1):
            h, z, r, c, bn = tape[k]
            dh = (dh + dout[k]) * (x[k] != OUTSIDE)
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * bn * r * (1 - r)
            das[k] = np.concatenate([dz, dr, dc]).T
            db = np.concatenate([dz, dr, dc * r])
            du += h @ db.T
            dh = dh * z + self.u @ db
        flat, das = x.ravel(), das.reshape(-1, 3 * size)
        order = np.argsort(flat, kind="stable")
        xs = flat[order]
        first = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]])
        dwx[xs[first]] = np.add.reduceat(das[order], first)
        return dwx, du


@dataclass
class Model:
    """languages: the learned lang values in order. A model is some tens of kilobytes."""

    languages: list[str]
    ahead: Gru
    back: Gru
    wo: np.ndarray
    bo: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.wx, self.ahead.u, self.back.wx, self.back.u, self.wo, self.bo]

    def window_sums(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of each window the sum of its own positions' probabilities: (N, K), of symbols x and flags own (T, N)."""
        size, last = self.ahead.u.shape[0], len(x) - 1
        f, b = self.ahead.forward(x)[0], self.back.forward(x[::-1])[0]
        wf, wb, bo = np.ascontiguousarray(self.wo[:size].T), np.ascontiguousarray(self.wo[size:].T), self.bo[:, None]
        out = np.zeros((len(self.languages), x.shape[1]), np.float32)
        for k in np.flatnonzero(own.any(1)).tolist():
            e = wf @ f[k]
            e += wb @ b[last - k]
            e += bo
            e -= e.max(0)
            np.exp(e, out=e)
            e *= own[k] / e.sum(0)
            out += e
        return out.T

    def sums(self, texts: pa.Array, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, sum of the positions' probabilities) of each text; null texts have none."""
        data, bounds = bytes_of(texts)
        out = np.zeros((len(texts), len(self.languages)))
        start, length, owner = windows_of(bounds, WINDOW)
        step = -(-length // CONTEXT) * CONTEXT
        order = np.argsort(step, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(step[order])) + 1):
            for k in range(0, len(group), most):
                some = group[k : k + most]
                x, own = read_windows(data, bounds, start[some], length[some], owner[some], int(step[some[0]]), CONTEXT)
                np.add.at(out, owner[some], self.window_sums(x, own))
        return np.diff(bounds), out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())])
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, bounds


def windows_of(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the windows that texts are read in."""
    size = np.diff(bounds)
    many = -(-size // window)
    owner = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return bounds[owner] + k * window, np.minimum(window, size[owner] - k * window), owner


def read_windows(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, steps: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, flags of own positions), each (steps + 2 context, windows)."""
    at = start[None, :] + np.arange(-context, steps + context)[:, None]
    inside = (at >= bounds[owner]) & (at < bounds[owner + 1])
    x = np.where(inside, data[np.clip(at, 0, len(data) - 1)].astype(np.intp), OUTSIDE)
    return x, (at >= start) & (at < start + length)


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, epochs: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """A model of (text, language) pairs: cross-entropy at every byte position, Adam with a falling rate, all windows of all texts once an epoch.

    Texts of one language alone, or none, need no training: their model gives that language, or none.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    init = lambda a, b, s: (rng.standard_normal((a, b)) * s).astype(np.float32)
    model = Model(languages, Gru(init(257, 3 * hidden, 0.3), init(hidden, 3 * hidden, hidden**-0.5)), Gru(init(257, 3 * hidden, 0.3), init(hidden, 3 * hidden, hidden**-0.5)), init(2 * hidden, len(languages), 0.1), np.zeros(len(languages), np.float32))
    data, bounds = bytes_of(pa.array(texts, pa.large_string()))
    start, length, owner = windows_of(bounds, LESSON)
    if len(languages) < 2 or not len(start):
        return model
    y = np.searchsorted(languages, np.array(labels))
    # languages weigh alike, however long their texts are
    share = np.bincount(y, weights=np.diff(bounds), minlength=len(languages))
    weight = (share.sum() / np.maximum(share, 1) / len(languages)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    total, step = epochs * -(-len(start) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(start))
        for some in (order[k : k + batch] for k in range(0, len(order), batch)):
            step += 1
            x, own = read_windows(data, bounds, start[some], length[some], owner[some], LESSON, 0)
            f, tape_f = model.ahead.forward(x, True)
            b, tape_b = model.back.forward(x[::-1], True)
            both = np.concatenate([f, b[::-1]], 1)
            logits = np.einsum("tcn,ck->tnk", both, model.wo, optimize=True) + model.bo
            e = np.exp(logits - logits.max(2, keepdims=True))
            d = e / e.sum(2, keepdims=True)
            kind = y[owner[some]]
            d[:, np.arange(len(some)), kind] -= 1
            d *= own[:, :, None] * weight[kind][None, :, None] / np.float32(batch * 8)
            dboth = np.einsum("tnk,ck->tcn", d, model.wo, optimize=True)
            grads = [*model.ahead.backward(x, tape_f, dboth[:, :hidden]), *model.back.backward(x[::-1], tape_b, dboth[::-1, hidden:]), np.einsum("tcn,tnk->ck", both, d, optimize=True), d.sum((0, 1))]
            now = rate * (1 - 0.9 * step / total)
            for p, g, (m, v) in zip(model.parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that training must not see: crc32 of the id's text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lowest_ids(usable: DataFrame, per_language: int, salts: int = 16) -> DataFrame:
    """(lang, doc_id): the per_language ids of each language that hash lowest, ranked in salted groups first, so that no task ranks a language's candidates of every partition."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    pick = lambda df, *keys: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= per_language).select("lang", "doc_id")
    salted = usable.select("lang", "doc_id", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(salts)).alias("salt"))
    return pick(pick(salted, "lang", "salt").distinct(), "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Trains on rows with a text, a lang and an id outside the held-out fold.

    Of each of the most_languages commonest languages (ties by name) the per_language ids that hash lowest are taken, so the sample
    is the same however the table is stored; their texts are read whole.
    Of an id that repeats in a language, the smallest text counts. Without such a row the model knows no language.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    common = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    # at most per_language rows of most_languages languages
    ids = stored(lowest_ids(usable.join(F.broadcast(common), "lang", "left_semi"), per_language))
    rows = usable.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def lettered(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False).astype(bool)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, labelled_positions) of every row of docs, from its whole text alone.

    score is the mean probability of the predicted language over all byte positions.
    Null texts, texts without a letter, and any text under a model that learned no
    language give ``und`` with score 0. Ties go to the first language in order.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                texts = part.column("text")
                known = lettered(texts) & bool(model.languages)
                n, totals = model.sums(texts) if model.languages else (bytes_of(texts)[1][1:] * 0, np.zeros((len(texts), 1)))
                score = np.clip(totals.max(1) / np.maximum(n, 1), 0, 1)
                label = np.where(known, np.array([*model.languages, UNKNOWN], object)[totals.argmax(1)], UNKNOWN)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(label, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(n)], ["doc_id", "lang_pred", "score", "labelled_positions"])

    return texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, labelled_positions long")


def reject(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """docs without the rows that have no letter (null and empty texts too), and without those whose score is less than
    1 / K + margin * (1 - 1 / K), K being the number of learned languages; all columns stay as they are.

    A model that learned no language can reject nothing: all rows stay. With one language every lettered row stays.
    The verdict is computed beside each row, so that rows need no id and no shuffle; repeated rows and null ids fare as others do.
    """
    if not model.languages:
        return docs
    small_batches(docs.sparkSession)
    schema, text = docs.schema, docs.columns.index("text")
    least = 1 / len(model.languages) + margin * (1 - 1 / len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [np.zeros(0, bool)]
            for part in pieces_of(pa.RecordBatch.from_arrays([batch.column(text)], ["text"]), "text"):
                n, totals = model.sums(part.column("text"))
                good.append(lettered(part.column("text")) & (totals.max(1) >= (least - 1e-9) * n))
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, schema)
