"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions and labels every
position; a document's probabilities are the mean over all its positions. It is
trained on the driver, in numpy, by backpropagation through time, on a bounded
number of windows of labelled documents; it then labels every byte of every text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import extended, slices, small_or_not, texts
from spanloom.llm.quality import has_letter

HIDDEN = 8
WINDOW = 128  # bytes read at once when labelling
TRAIN_WINDOW = 64
DOCS_PER_LABEL = 400  # bound on the training documents of a label
STEPS = 240
BATCH = 192
LANES = 4096  # windows that run side by side
PAD = 256
UNDETERMINED = "und"


class Network(NamedTuple):
    """Per direction: input table (257, 3H) with biases, recurrence (H, 3H). Then output (2H, K) and bias."""

    labels: list[str]
    table: np.ndarray  # (2, 257, 3H): update, reset, candidate
    recur: np.ndarray  # (2, H, 3H)
    out: np.ndarray
    bias: np.ndarray


def _gate(x: np.ndarray) -> np.ndarray:
    """Logistic function in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _run(table: np.ndarray, recur: np.ndarray, steps: np.ndarray, keep: bool = False):
    """States after each step for (time, lane) symbols; with ``keep`` also what the backward pass needs."""
    time, lanes = steps.shape
    h3 = table.shape[1]
    n = h3 // 3
    states = np.empty((time, lanes, n), np.float32)
    h = np.zeros((lanes, n), np.float32)
    kept = []
    for t in range(time):
        x = table[steps[t]]
        u = h @ recur
        gates = _gate(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
        if keep:
            kept.append((h, z, r, u[:, 2 * n :], new))
        h = new + z * (h - new)
        states[t] = h
    return states, kept


def _back(recur: np.ndarray, steps: np.ndarray, kept: list, d_states: np.ndarray, size: int):
    """Gradients of the input table and the recurrence, back through time."""
    n = recur.shape[0]
    d_table = np.zeros((size, 3 * n), np.float32)
    d_recur = np.zeros_like(recur)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, u, new = kept[t]
        d_h = d_h + d_states[t]
        d_new = d_h * (1 - z) * (1 - new * new)
        d_z = d_h * (h - new) * z * (1 - z)
        d_r = d_new * u * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_new], 1)
        d_u = np.concatenate([d_z, d_r, d_new * r], 1)
        np.add.at(d_table, steps[t], d_x)
        d_recur += h.T @ d_u
        d_h = d_h * z + d_u @ recur.T
    return d_table, d_recur


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, truth: np.ndarray):
    """Mean cross entropy over all positions that are no padding, and its gradients."""
    steps = windows.T
    live = (steps != PAD).astype(np.float32)
    n = net.recur.shape[1]
    fore, kept_f = _run(net.table[0], net.recur[0], steps, True)
    back, kept_b = _run(net.table[1], net.recur[1], steps[::-1], True)
    both = np.concatenate([fore, back[::-1]], 2)
    p = _softmax(both @ net.out + net.bias)
    total = max(1.0, float(live.sum()))
    chosen = np.take_along_axis(p, truth[None, :, None].repeat(len(steps), 0), 2)[..., 0]
    loss = -float((np.log(chosen + 1e-9) * live).sum()) / total
    d = p.copy()
    d[:, np.arange(len(truth)), truth] -= 1
    d *= (live / total)[..., None]
    d_out = both.reshape(-1, 2 * n).T @ d.reshape(-1, d.shape[2])
    d_both = d @ net.out.T
    tf, rf = _back(net.recur[0], steps, kept_f, d_both[..., :n], PAD + 1)
    tb, rb = _back(net.recur[1], steps[::-1], kept_b, d_both[::-1, :, n:], PAD + 1)
    return loss, [np.stack([tf, tb]), np.stack([rf, rb]), d_out, d.sum((0, 1))]


def train(windows: np.ndarray, truth: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 1) -> Network:
    """Adam over shuffled batches. Deterministic for given input."""
    rng = np.random.default_rng(seed)
    n, k = HIDDEN, len(labels)
    params = [
        rng.normal(0, 0.3, (2, PAD + 1, 3 * n)), rng.normal(0, 0.3, (2, n, 3 * n)),
        rng.normal(0, 0.3, (2 * n, k)), np.zeros(k),
    ]
    params = [p.astype(np.float32) for p in params]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(windows))])
        pick, order = order[:BATCH], order[BATCH:]
        _, grads = gradients(Network(labels, *params), windows[pick], truth[pick])
        rate = 0.03 * (1 - 0.9 * step / steps)
        for p, m, s, g in zip(params, mean, square, grads):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Network(labels, *params)


# -- learning from a table -------------------------------------------------------------

def symbols(text: str) -> np.ndarray:
    """Bytes of the text in lower case."""
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def training_windows(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> pd.DataFrame:
    """(lang, window) from at most ``docs_per_label`` documents of each label, picked by hash, a few windows each."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().withColumnRenamed("count", "_n")  # one row per label
    mark = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    bound = 1 << 40
    likely = known.join(small_or_not(counts), "lang").select("lang", "text", "doc_id", F.pmod(mark, F.lit(bound)).alias("_mark"), "_n")
    likely = likely.filter(F.col("_mark") < F.lit(float(bound)) * 2 * docs_per_label / F.col("_n")).drop("_n")
    # About twice the bound per label is left to be ranked.
    ranked = likely.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY _mark, doc_id) AS _rank").filter(
        F.col("_rank") <= docs_per_label
    )

    def windows(batches):
        for batch in slices(batches):
            langs, out = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text")):
                s = symbols(text)
                if has_letter(text):
                    for at in range(0, len(s), TRAIN_WINDOW):
                        langs.append(lang)
                        out.append(s[at : at + TRAIN_WINDOW].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    found = ranked.select("lang", "text").mapInArrow(windows, "lang string, window binary").toPandas()
    return found.sort_values(["lang", "window"], ignore_index=True)


def fit(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL, steps: int = STEPS) -> Network | None:
    """A network for the labels of ``docs`` (doc_id, text, lang); None without any labelled text."""
    found = training_windows(docs, docs_per_label)
    if not len(found):
        return None
    labels = sorted(found.lang.unique())
    windows = np.full((len(found), TRAIN_WINDOW), PAD, np.int16)
    for i, w in enumerate(found.window):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    truth = np.searchsorted(np.array(labels), found.lang.to_numpy(str))
    return train(windows, truth, labels, steps)


# -- labelling ----------------------------------------------------------------------------

def position_probabilities(net: Network, steps: np.ndarray) -> np.ndarray:
    """(time, lane, label) for (time, lane) symbols."""
    n = net.recur.shape[1]
    fore, _ = _run(net.table[0], net.recur[0], steps)
    back, _ = _run(net.table[1], net.recur[1], steps[::-1])
    return _softmax(fore @ net.out[:n] + back[::-1] @ net.out[n:] + net.bias)


class Pool:
    """Sums of position probabilities per document, over lanes of windows of many documents."""

    def __init__(self, net: Network, docs: int):
        self.net = net
        self.sums = np.zeros((docs, len(net.labels)))
        self.steps = np.full((LANES, WINDOW), PAD, np.int16)
        self.owner = np.zeros(LANES, np.int64)
        self.used = 0

    def add(self, doc: int, s: np.ndarray) -> None:
        for at in range(0, len(s), WINDOW):
            part = s[at : at + WINDOW]
            self.steps[self.used, : len(part)] = part
            self.owner[self.used] = doc
            self.used += 1
            if self.used == LANES:
                self.flush()

    def flush(self) -> None:
        if self.used:
            steps = self.steps[: self.used].T
            p = position_probabilities(self.net, steps)
            p *= (steps != PAD)[..., None]
            np.add.at(self.sums, self.owner[: self.used], p.sum(0))
            self.steps[:] = PAD
            self.used = 0


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score added.

    ``score`` is the mean probability of the label over all positions of the whole
    text. A text that is null or has no letter is ``und`` with score 0, and so is
    every text when nothing was learned. Columns of these names are replaced.
    Repeated rows get equal labels.
    """
    docs = docs.drop("lang_pred", "score")
    shown = docs.columns

    def run(batches):
        for batch in slices(batches, 1024):
            read = texts(batch, "text")
            label, score = [UNDETERMINED] * len(read), np.zeros(len(read))
            if net is not None:
                pool, size = Pool(net, len(read)), np.zeros(len(read))
                for i, text in enumerate(read):
                    if has_letter(text):
                        s = symbols(text)
                        size[i] = len(s)
                        pool.add(i, s)
                pool.flush()
                for i in np.flatnonzero(size):
                    best = int(pool.sums[i].argmax())
                    label[i], score[i] = net.labels[best], min(1.0, pool.sums[i, best] / size[i])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in shown), pa.array(label), pa.array(score)], [*shown, "lang_pred", "score"]
            )

    return docs.mapInArrow(run, extended(docs.schema, {"lang_pred": "string", "score": "double"}))


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the documents, by id; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
