"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences is hashed; runs are joined globally on the hash, and each sentence
covered by an occurrence that is not the first is removed.

A passage rarely begins and ends where a sentence does, so long sentences are cut further, at clauses or,
where no mark stands for some words, behind a word that the words around it single out (the least hash of
a window).  Runs begin at such cuts of a wide window and end at those of a narrow one, of which there are
more.  All cuts depend on the few words around them alone; two copies of a passage are cut alike but for
its first and last words, whatever stands around them.

Only hashes and doc_ids are shuffled for the counts, with map-side combine, so a passage that a third of
all documents share is a few partial rows; the join back to the documents that hold a repeated run is an
ordinary equi-join whose hot keys adaptive execution splits.
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

#: A run is the shortest one from a beginning on with WORDS words; a beginning stands among every WINDOW words, a cut among every FINE.
WORDS, WINDOW, FINE = 40, 8, 3
_SENTENCE, _CLAUSE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SENTENCE[[ord(c) for c in ".!?"]] = _CLAUSE[[ord(c) for c in ",;:"]] = True
_U = np.uint64


def parts(hasher: tk.Hasher, data: np.ndarray, window: int = WINDOW, fine: int = FINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word in bytes, hashes of the words, word at which each run begins, word behind each part of a sentence)."""
    starts, ends, words = hasher.words(data, tk.unspaced(data))
    if not len(words):
        return starts, words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = data[ends - 1]
    with np.errstate(over="ignore"):
        rank = tk.mix(words + np.append(words[1:], _U(0)) * _U(tk.MULT)) | _U(1 << 63)
    rank[_CLAUSE[mark]] >>= _U(1)
    rank[_SENTENCE[mark]] = 0

    def cuts(width: int) -> np.ndarray:
        cut = _SENTENCE[mark]
        if len(words) >= width:
            least = np.lib.stride_tricks.sliding_window_view(rank, width).argmin(axis=1)
            cut[least + np.arange(len(least))] = True
        return cut

    narrow = cuts(fine)
    narrow[-1] = True
    return starts, words, np.append(0, np.flatnonzero(cuts(window)[:-1]) + 1), np.flatnonzero(narrow) + 1


def runs(hasher: tk.Hasher, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word behind the last, hash of 64 bits, 32 bits more) of each run, in the order of the text."""
    last = np.searchsorted(ends, begins + least)
    whole = last < len(ends)
    a, b = begins[whole], ends[last[whole]]
    p, q = tk.powers(len(words) + 1, hasher.cache)
    hashes = []
    with np.errstate(over="ignore"):
        for x in (words, tk.mix(words ^ _U(0x5851F42D4C957F2D))):
            total = np.zeros(len(words) + 1, dtype=_U)
            np.cumsum(x * p[: len(words)], dtype=_U, out=total[1:])
            hashes.append(tk.mix((total[b] - total[a]) * q[a] + (b - a).astype(_U)).view(np.int64))
    return a, b, hashes[0], hashes[1].astype(np.int32)


def strip(hasher: tk.Hasher, data: np.ndarray, remove: np.ndarray, least: int, window: int, fine: int) -> tuple[bytes | None, int, int, int]:
    """(text left or None if nothing goes, parts, parts removed, words removed): runs in ``remove`` go, and those met before in the text."""
    starts, words, begins, ends = parts(hasher, data, window, fine)
    a, b, h, _ = runs(hasher, words, begins, ends, least)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    gone = np.flatnonzero(np.isin(h, remove) | (b[first][which] <= a)) if len(h) else first
    if not len(gone):
        return None, len(ends), 0, 0
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, a[gone], 1)
    np.add.at(step, b[gone], -1)
    drop = np.cumsum(step)[:-1] > 0
    edge = np.flatnonzero(np.diff(drop, prepend=False, append=False))
    offset = np.append(starts, len(data))
    kept, at = [], 0
    for x, y in offset[edge].reshape(-1, 2).tolist():
        kept.append(data[at:x].tobytes())
        at = y
    kept.append(data[at:].tobytes())
    return b"".join(kept).strip(), len(ends), int(drop[ends - 1].sum()), int(drop.sum())


def dedup_spans(docs: DataFrame, words: int = WORDS, window: int = WINDOW, fine: int = FINE) -> DataFrame:
    """``docs`` with repeated sentence runs removed: (doc_id, text, lang, source, n_chars, n_parts, n_removed, words_removed, first_docs).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, in scripts without spaces characters.  Every
    passage of words + window + fine words (51) or more that recurs is found wherever it begins, and loses
    all but at most ``window`` words at its beginning and ``window + fine`` at its end; nothing goes but runs
    of ``words`` words or more.
    A run's first occurrence is in the smallest doc_id that holds it, at its smallest position; it stays,
    every sentence part of every other occurrence goes, and first_docs lists the documents that keep them.
    Inside a text an occurrence counts as another where it does not overlap the first.
    n_chars follows a text that was changed.  A text that loses nothing stays as it is, to the byte;
    one that loses all becomes empty.  Texts of any length are worked whole; null and empty texts stay; a
    row with a null doc_id is only searched for repeats inside itself; rows that share a doc_id are one
    document and do not strip each other; an empty table gives an empty result; extra columns are not carried.
    """

    def emit(batches):
        hasher = tk.Hasher(tk.class_space_delimited())
        for batch in tk.pieces(batches):
            found = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64)]
            for doc, data in zip(batch.column("doc_id").to_pylist(), tk.texts(batch.column("text")), strict=True):
                h, g = runs(hasher, *parts(hasher, data, window, fine)[1:], words)[2:]
                h, at = np.unique(h, return_index=True)
                for out, column in zip(found, (h, g[at], np.full(len(h), doc)), strict=True):
                    out.append(column)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["h", "g", "doc_id"])

    def apply(batches):
        hasher = tk.Hasher(tk.class_space_delimited())
        for batch in tk.pieces(batches):
            old = batch.column("text").to_pylist()
            got = [[], [], [], [], []]
            for text, data, remove, size in zip(old, tk.texts(batch.column("text")), batch.column("remove").to_pylist(), batch.column("n_chars").to_pylist(), strict=True):
                left, *counts = strip(hasher, data, np.array(remove or [], np.int64), words, window, fine)
                left = text if left is None else left.decode()
                for out, value in zip(got, (left, *counts, len(left) if counts[1] else size), strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(got[0], pa.string()), batch.column("lang"), batch.column("source"), pa.array(got[4], pa.int64()), *[pa.array(g, pa.int64()) for g in got[1:4]], batch.column("first_docs")],
                ["doc_id", "text", "lang", "source", "n_chars", "n_parts", "n_removed", "words_removed", "first_docs"],
            )

    docs = columns_only(docs, "doc_id", "text", "lang", "source", "n_chars")
    found = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(emit, "h long, g int, doc_id long")
    repeated = found.groupBy("h", "g").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    hits = found.join(repeated, ["h", "g"]).where("doc_id > first_doc")
    remove = hits.groupBy("doc_id").agg(F.collect_set("h").alias("remove"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_parts long, n_removed long, words_removed long, first_docs array<long>"
    return docs.join(remove, "doc_id", "left").mapInArrow(apply, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
