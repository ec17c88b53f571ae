"""Quality classifier: a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole document are cut into chunks of 16 bytes that overlap by half.
Each byte is embedded, each chunk goes through learned filters, each filter keeps its
highest response over all chunks of the document, and a logistic unit combines these
maxima into one probability. Nothing is truncated: a longer document has more chunks.

Training draws a bounded sample of labelled rows (``SAMPLE_ROWS`` a class, by hash of the
id, among the rows the caller allows, without texts of more than ``SAMPLE_TEXT`` bytes, so the
driver holds at most their product) and runs on the driver; as only the winning chunk of
a filter has a gradient, a step costs little more than a forward pass. The classes are
sampled evenly; the intercept is moved ``PRIOR`` of the way (on the logit scale) from even
classes to their true proportion, which favours the frequent class. Scoring
is one pass over the documents without a shuffle; the weights, of fixed size, go with the
task. Chunks are evaluated in slabs, so a very long text needs no more memory than a slab.

Defined cases: a null or empty text is scored as a chunk of zero bytes; repeated rows get
equal scores; labels other than 0 and 1 are ignored; with labels of one class only, the
model answers that class's share; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.llm.slices import slices
from clinloom.session import ship

#: Labelled rows of each class that the model is fitted on, in expectation, and the longest text (in bytes) among them.
SAMPLE_ROWS, SAMPLE_TEXT = 900, 1 << 17
HALF, EMBED, FILTERS = 8, 8, 32
EPOCHS, BATCH, RATE = 10, 32, 0.004
PRIOR = 0.5
#: Blocks of HALF bytes evaluated at a time.
SLAB = 1 << 15


@dataclass
class Model:
    embed: np.ndarray  # (256, EMBED)
    left: np.ndarray  # (HALF * EMBED, 2 * FILTERS): filters' first halves, then their second halves
    bias: np.ndarray  # (FILTERS,)
    unit: np.ndarray  # (FILTERS,)
    intercept: float

    def pooled(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Highest response of each filter over each document's chunks.

        ``blocks`` (n, HALF) bytes of documents one after another, ``first`` their first
        blocks; every document has at least two blocks.
        """
        out = np.full((len(first), FILTERS), -np.inf, np.float32)
        for at in range(0, len(blocks) - 1, SLAB):
            part = blocks[at : at + SLAB + 1]
            both = self.embed[part].reshape(len(part), -1) @ self.left
            got = both[:-1, :FILTERS] + both[1:, FILTERS:]
            lo = np.searchsorted(first, at, "right") - 1
            hi = np.searchsorted(first, at + len(got), "left")
            inner = first[lo:hi] - at
            last = inner[1:] - 1  # a chunk over two documents
            got[last[last >= 0]] = -np.inf
            if hi < len(first) and first[hi] == at + len(got):
                got[-1] = -np.inf
            starts = np.maximum(inner, 0)
            out[lo:hi] = np.maximum(out[lo:hi], np.maximum.reduceat(got, starts))
        return out + self.bias

    def logits(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(blocks, first), 0) @ self.unit + self.intercept


def to_blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded blocks of HALF bytes of all texts, at least two each, and their first blocks."""
    sizes = np.array([max(2, -(-len(t) // HALF)) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    data = b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, sizes.tolist(), strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, HALF), first[:-1]


def _winners(model: Model, blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's best chunk in each document, and its response; a slab of blocks at a time."""
    at, best = np.zeros((len(first), FILTERS), np.int64), np.full((len(first), FILTERS), -np.inf, np.float32)
    end = np.append(first[1:], len(blocks)) - 1
    for low in range(0, len(blocks) - 1, SLAB):
        part = blocks[low : low + SLAB + 1]
        both = model.embed[part].reshape(len(part), -1) @ model.left
        got = both[:-1, :FILTERS] + both[1:, FILTERS:]
        for d in range(int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, low + len(got), "left"))):
            a, b = max(int(first[d]) - low, 0), min(int(end[d]) - low, len(got))
            if a >= b:
                continue
            top = a + got[a:b].argmax(0)
            value = np.take_along_axis(got, top[None], 0)[0]
            better = value > best[d]
            at[d, better], best[d, better] = top[better] + low, value[better]
    return at, best


def fit(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """A model of label 1; ``share`` is the label's true proportion."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, (HALF * EMBED) ** -0.5, (HALF * EMBED, 2 * FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        0.0,
    )
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 20.0 * (1 if share >= 1 else -1)
    drawn = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or drawn in (0.0, 1.0):
        model.unit[:] = 0
        model.intercept = prior
        return model
    params = [model.embed, model.left, model.bias, model.unit, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    cells, t = HALF * EMBED, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            blocks, first = to_blocks([texts[j] for j in pick])
            at, best = _winners(model, blocks, first)
            raw = best + model.bias
            act = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(act @ model.unit + params[4][0])))
            err = (p - labels[pick]).astype(np.float32) / len(pick)
            back = err[:, None] * model.unit * (raw > 0)
            one, two = blocks[at], blocks[at + 1]  # (docs, FILTERS, HALF)
            x1, x2 = (model.embed[b].reshape(len(pick), FILTERS, cells) for b in (one, two))
            g_left = np.concatenate([np.einsum("df,dfc->cf", back, x1), np.einsum("df,dfc->cf", back, x2)], 1)
            g_embed = np.zeros_like(model.embed)
            for b, w in ((one, model.left[:, :FILTERS]), (two, model.left[:, FILTERS:])):
                np.add.at(g_embed, b, (back[:, :, None] * w.T[None]).reshape(*b.shape, EMBED))
            grads = [g_embed, g_left, back.sum(0), err @ act, np.array([err.sum()])]
            t += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model.intercept = float(params[4][0]) + PRIOR * (prior - float(np.log(drawn / (1 - drawn))))
    return model


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on a sample of ``labels`` joined to ``docs``; ``allowed`` restricts the labelled rows."""
    marked = labels.select(key, F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    if allowed is not None:
        marked = marked.where(allowed)
    sizes = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    if not sizes:
        return fit([], np.zeros(0), 0.5)
    slots = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col(key)), F.lit(slots))
    rate = F.lit(0)
    for value, n in sizes.items():
        rate = F.when(F.col("_label") == value, F.lit(min(slots, int(slots * rows / n)))).otherwise(rate)
    sample = marked.where(draw < rate)
    texts = docs.select(key, text).where(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_TEXT).join(F.broadcast(sample), key).select(key, F.coalesce(F.col(text), F.lit("")).alias("t"), "_label").collect()
    texts.sort(key=lambda r: (r[0], r["t"], r["_label"]))
    return fit([r["t"].encode("utf-8", "surrogatepass") for r in texts], np.array([r["_label"] for r in texts], float), sizes.get(1, 0) / sum(sizes.values()))


def score_texts(model: Model, texts: list[str | None], limit: int = 2 << 20) -> np.ndarray:
    """Probabilities of label 1, evaluated for about ``limit`` bytes of text at a time."""
    out, i = np.empty(len(texts)), 0
    while i < len(texts):
        chunk, size, j = [], 0, i
        while j < len(texts) and (not chunk or size < limit):
            chunk.append((texts[j] or "").encode("utf-8", "surrogatepass"))
            size += len(chunk[-1])
            j += 1
        out[i:j] = 1 / (1 + np.exp(-np.clip(model.logits(*to_blocks(chunk)).astype(float), -40, 40)))
        i = j
    return out


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability as a column of doubles; all other columns are kept.

    A column that has the new column's name is replaced.
    """
    docs = docs.drop(name)
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            found = pa.array(score_texts(model, part.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)
