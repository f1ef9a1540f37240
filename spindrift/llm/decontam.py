"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every trigram of an item is a seed, however frequent it is in the documents.  The seeds are looked up in
each document and the item is aligned with the stretch around the hits, word by word; the score of an
alignment is its share of the item's perfect score, which edited and paraphrased copies keep to a large
part.  Stretches with too few of the item's words to reach the threshold are not aligned.

The benchmark is worked in blocks of bounded size, each broadcast to the tasks, so it may be of any
length; nothing about the documents but their passages that match leaves the executors.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkit as tk
from spindrift.llm.cluster import columns_only

GRAM, MATCH, MISMATCH, GAP = 3, 2, -1, -1
#: Share of an item's perfect score from which a passage counts as a copy; seeds that must agree on a place; characters of benchmark per block.
THRESHOLD, SEEDS, BLOCK_CHARS = 0.5, 2, 16_000_000
#: One seed is enough for items below so many words; words of a text that are searched at once, at least.
SHORT, STRIDE = 16, 8192
_U = np.uint64
_BITS = 20


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = words[: max(0, len(words) - n + 1)].copy()
        for i in range(1, n):
            h = tk.mix(h * _U(tk.MULT) + words[i : i + len(h)] + _U(i))
    return h


def words_of(hasher: tk.Hasher, data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a UTF-8 text; each character of a script written without spaces is a word."""
    return hasher.words(data, tk.unspaced(data))[2]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of word arrays ``item`` and ``text``; the range is in text."""
    n = len(text)
    ramp = np.arange(n + 1) * -GAP
    prev, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for w in item:
        diag = np.where(text == w, MATCH, MISMATCH) + prev[:-1]
        up = prev[1:] + GAP
        cell = np.zeros(n + 1, np.int64)
        cell[1:] = np.maximum(np.maximum(diag, up), 0)
        first = np.arange(n + 1)
        first[1:] = np.where(cell[1:] == 0, first[1:], np.where(diag >= up, start[:-1], start[1:]))
        reach = cell + ramp
        run = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == run, np.arange(n + 1), 0))
        cell = np.maximum(run - ramp, 0)
        first = np.where(cell > 0, first[source], np.arange(n + 1))
        prev, start = cell, first
        at = int(cell.argmax())
        if cell[at] > best:
            best, span = int(cell[at]), (int(first[at]), at)
    return best, *span


class _Index:
    """Seeds of one benchmark block: hash to places (item, offset), behind a bitmap."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, offsets: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.h, self.item, self.offset = hashes[order], items[order], offsets[order]
        self.map = np.zeros(1 << _BITS, dtype=bool)
        self.map[(self.h >> _U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset) of each seed found in the grams ``g`` of a text."""
        at = np.flatnonzero(self.map[(g >> _U(64 - _BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.h, g[at], "left"), np.searchsorted(self.h, g[at], "right")
        n = hi - lo
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        return np.repeat(at, n), self.item[place], self.offset[place]


def passages(words: np.ndarray, index: _Index, items: list[np.ndarray], seeds: int, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end) of the best passage of each item that reaches the threshold."""
    g = grams(words) if len(words) >= GRAM else tk.mix(words)[:0]
    pos, item, offset = index.hits(g)
    out = []
    order = np.lexsort((pos, item))
    pos, item, offset = pos[order], item[order], offset[order]
    if len(item):
        # items hit at fewer places than they need, most of them by chance, are left out at once
        first = np.ones(len(item), bool)
        first[1:] = (item[1:] != item[:-1]) | (pos[1:] != pos[:-1])
        hit, at = np.unique(item, return_inverse=True)
        use = (np.bincount(at, weights=first) >= [1 if len(items[i]) < SHORT else seeds for i in hit])[at]
        pos, item, offset = pos[use], item[use], offset[use]
    for chunk in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1) if len(item) else []:
        it = int(item[chunk[0]])
        size = len(items[it])
        slack = size // 4 + 3
        start = np.maximum(pos[chunk] - offset[chunk] - slack, 0)
        end = np.minimum(pos[chunk] - offset[chunk] + size + slack, len(words))
        best = (0.0, 0, 0)
        order = np.argsort(start, kind="stable")
        start, end, where = start[order], end[order], pos[chunk][order]
        cut = np.flatnonzero(start[1:] > np.maximum.accumulate(end)[:-1]) + 1
        for part in np.split(np.arange(len(start)), cut):
            if len(np.unique(where[part])) < (1 if size < SHORT else seeds):
                continue
            a, b = int(start[part[0]]), int(end[part].max())
            if MATCH * np.isin(items[it], words[a:b]).sum() < threshold * MATCH * size:
                continue
            score, x, y = smith_waterman(items[it], words[a:b])
            if score > best[0]:
                best = (score, a + x, a + y)
        share = best[0] / (MATCH * size)
        if share >= threshold:
            out.append((it, share, best[1], best[2]))
    return out


def all_passages(words: np.ndarray, index: _Index, items: list[np.ndarray], seeds: int, threshold: float, stride: int = STRIDE) -> list[tuple[int, float, int, int]]:
    """``passages`` of a text of any length, in overlapping windows, which bounds the places of seeds that are held at once.

    A passage that reaches a threshold of a half is at most twice as long as its item, so it lies whole in a window.
    """
    longest = max(map(len, items), default=0)
    width, overlap = max(stride, 8 * longest), 3 * longest + 6
    if len(words) <= width:
        return passages(words, index, items, seeds, threshold)
    best: dict[int, tuple[float, int, int]] = {}
    for at in range(0, max(1, len(words) - overlap), width - overlap):
        for item, score, a, b in passages(words[at : at + width], index, items, seeds, threshold):
            if score > best.get(item, (0.0,))[0]:
                best[item] = (score, at + a, at + b)
    return [(item, *found) for item, found in sorted(best.items())]


def whole(words: np.ndarray, short: dict[int, _Index]) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end) of the first place of each item of fewer than GRAM words, by number of words in ``short``."""
    out = []
    for n, index in short.items():
        pos, item, _ = index.hits(grams(words, n))
        found, first = np.unique(item, return_index=True)
        out += [(int(it), 1.0, int(a), int(a) + n) for it, a in zip(found, pos[first], strict=True)]
    return out


def _block(rows: list) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    hasher = tk.Hasher(tk.class_alnum())
    ids, items = [], []
    for row in rows:
        w = words_of(hasher, np.frombuffer((row.text or "").encode(), np.uint8))
        if len(w):
            ids.append(row.item_id)
            items.append(w)
    g = [grams(w) for w in items]
    n = [len(x) for x in g]
    flat = np.concatenate(g) if g else np.zeros(0, _U)
    return ids, items, flat, np.repeat(np.arange(len(g)), n), np.concatenate([np.arange(x) for x in n]) if n else np.zeros(0, np.int64)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seeds: int = SEEDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) for each document and item it holds a copy of.

    Words are runs of ASCII letters and digits and of other characters, lower-cased A-Z, and single
    characters of scripts written without spaces.  The score is
    the best alignment's share of the item's perfect one; the words' range is where it lies in the text
    (the first such place on a tie).  Items with fewer than three words match where their
    words stand in a text, unedited, with score 1; null or empty texts match nothing; equal items and repeated rows are reported each; a null doc_id is reported as null; empty
    tables give an empty result; extra columns are ignored.  Texts of any length are searched whole, in windows;
    an alignment takes time in proportion to the product of the lengths of item and passage.
    """
    docs = columns_only(docs, "doc_id", "text")
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    size = F.length(F.coalesce("text", F.lit("")))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = bench.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    out = None
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        ids, items, flat, owner, offset = _block(rows)
        if not ids:
            continue
        bc = spark.sparkContext.broadcast((ids, items, flat, owner, offset))

        def scan(batches, bc=bc):
            ids, items, h, owner, offset = bc.value
            hasher, index, short = tk.Hasher(tk.class_alnum()), _Index(h, owner, offset), {}
            for n in range(1, GRAM):
                mine = [i for i, w in enumerate(items) if len(w) == n]
                if mine:
                    short[n] = _Index(np.concatenate([grams(items[i], n) for i in mine]), np.array(mine), np.zeros(len(mine), np.int64))
            for batch in tk.pieces(batches):
                got = [(doc, ids[i], score, a, z) for doc, t in zip(batch.column("doc_id").to_pylist(), tk.texts(batch.column("text")), strict=True) for w in (words_of(hasher, t),) for i, score, a, z in all_passages(w, index, items, seeds, threshold) + whole(w, short)]
                cols = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        part = docs.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
