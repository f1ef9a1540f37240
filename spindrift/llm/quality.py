"""Quality classifier: averaged subword embeddings with a softmax output, trained by stochastic gradient descent.

A text's features are its words and their character n-grams, hashed into a fixed number of buckets,
and a mark for each word that repeats the one before; each bucket has a learned vector, a document is the mean of its features' vectors, and a softmax over
two classes is put on top.  Training is numpy SGD on a bounded labelled sample whose features are
counted by the executors.  For scoring, every vector is multiplied by the output weights once, so a
document costs one look-up a feature.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkit as tk
from spindrift.llm.cluster import columns_only, cut
from spindrift.llm.labelled import held_out, training_texts

#: Labelled texts learned from; buckets (a power of two), width of the vectors, lengths of n-grams; passes and learning rate.
SAMPLE, BITS, WIDTH, NGRAMS, EPOCHS, RATE = 6_000, 17, 8, (3, 4), 6, 0.5
#: Distinct features of all texts learned from; where texts are so long that this is too few, the sample has fewer texts.
FEATURES = 24_000_000
_U = np.uint64
#: The bucket of a word that repeats the one before it.
REPEAT = 0


def buckets(data: np.ndarray, hasher: tk.Hasher, ngrams: tuple[int, ...] = NGRAMS, bits: int = BITS):
    """Yields int64 arrays of bucket numbers of a text's features: words, repeats, n-grams inside words, a piece at a time."""
    starts, ends = hasher.spans(data)
    shift = _U(64 - bits)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + tk.CHUNK, side="right")))
        piece = data[base : ends[j - 1]]
        a, b = starts[i:j] - base, ends[i:j] - base
        s, q = hasher.prefix(piece)
        with np.errstate(over="ignore"):
            word = tk.mix((s[b] - s[a]) * q[a])
            yield (word >> shift).astype(np.int64)
            yield np.full(int((word[1:] == word[:-1]).sum()), REPEAT, np.int64)
            left = np.repeat(b, b - a) - np.flatnonzero(hasher.is_word[piece])
            at = np.flatnonzero(hasher.is_word[piece])
            for n in ngrams:
                p = at[left >= n]
                yield (tk.mix((s[p + n] - s[p]) * q[p] + _U(n)) >> shift).astype(np.int64)
        i = j


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, bits: int = BITS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(per-bucket score, bias) of the model fitted to [(label, buckets, counts)]: the vectors times the output difference."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    w, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    share = np.mean([y for y, _, _ in rows])
    if not 0 < share < 1:
        return np.zeros(1 << bits, np.float32), 10.0 if share == 1 else -10.0
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, n = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            part = (n / n.sum()).astype(np.float32)
            x = part @ e[at]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            g = w @ p
            w -= lr * np.outer(x, p)
            bias -= lr * 0.1 * p
            e[at] -= (lr * len(at) ** 0.5) * part[:, None] * g[None, :]
    return e @ (w[:, 1] - w[:, 0]), float(bias[1] - bias[0])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, modulus: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; score is the probability of label 1.

    Learned from at most ``sample`` labelled rows outside the held-out fold.  Null and empty texts have
    no features and get the model's bias; with no usable labels every score is one half.  Repeated rows
    are scored each, a null doc_id is not held out, extra columns are ignored, an empty table gives an
    empty result.  Long texts are read whole, in pieces of a megabyte.
    """
    spark = docs.sparkSession

    def count(batches):
        hasher = tk.Hasher(tk.class_space_delimited(), lower=False)
        for batch in tk.pieces(batches):
            ats, ns = [], []
            for t in tk.texts(batch.column("text")):
                parts = list(buckets(t, hasher))
                at, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
                ats.append(at.astype(np.int32))
                ns.append(n.astype(np.int32))
            off = np.concatenate([[0], np.cumsum([len(a) for a in ats])]).astype(np.int32)
            flat = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (ats, ns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *flat], ["doc_id", "y", "at", "n"])

    counted = cut(training_texts(docs, labels, "quality", sample, modulus, rest).select("doc_id", "y", "text").mapInArrow(count, "doc_id long, y int, at array<int>, n array<int>"))
    sizes = sorted(counted.groupBy("doc_id").agg(F.sum(F.size("at")).alias("n"), F.xxhash64(F.first("doc_id")).alias("u")).collect(), key=lambda r: (r.u, r.doc_id))
    room = np.cumsum([r.n for r in sizes]) <= FEATURES
    if not room.all():
        few = spark.createDataFrame([(r.doc_id,) for r, ok in zip(sizes, room, strict=True) if ok], "doc_id long")
        counted = counted.join(F.broadcast(few), "doc_id")
    table = counted.toArrow().sort_by("doc_id")
    rows = [(int(y > 0), np.asarray(a), np.asarray(n)) for y, a, n in zip(table.column("y").to_pylist(), (x.values for x in table.column("at")), (x.values for x in table.column("n")), strict=True) if len(a)]
    model = train(rows) if rows else (np.zeros(1 << BITS, np.float32), 0.0)
    bc = spark.sparkContext.broadcast(model)

    def score(batches):
        weight, bias = bc.value
        hasher = tk.Hasher(tk.class_space_delimited(), lower=False)
        for batch in tk.pieces(batches):
            out = []
            for t in tk.texts(batch.column("text")):
                total, n = 0.0, 0
                for at in buckets(t, hasher):
                    total += float(weight[at].sum(dtype=np.float64))
                    n += len(at)
                out.append(1 / (1 + np.exp(-np.clip(total / max(1, n) + bias, -30, 30))))
            p = np.array(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    docs = columns_only(docs, "doc_id", "text").select("doc_id", held_out(modulus, rest).alias("held_out"), "text")
    return docs.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
