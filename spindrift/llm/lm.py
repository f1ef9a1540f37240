"""Brown class-based bigram language model, trained and applied over the whole corpus.

Every word seen often enough is clustered, in a number of classes that grows with the root of their
number; rare and unseen words belong to the class of their ending.  Exchange clustering moves the most
frequent words between the first classes while the likelihood of the class bigrams grows, the next
ones found the other classes, and in distributed rounds each word is exchanged into the class whose
neighbours are most like its own.  A token's probability is that of its class after the class before it,
times that of the word in its class, both smoothed.

Counts come from every training document: word counts (a shuffle with map-side combine), then, on the
texts written as numbers of clustered words, symbol and class bigrams and the neighbour classes of each
clustered word (a shuffle), and, for scoring, the counts of the rare words, which are joined by a shuffle.
Broadcast are the clustered words with their counts and classes, which grow with the vocabulary: 16 bytes a word.
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
from spindrift.llm.labelled import held_out

#: Words clustered one by one, classes they form, classes of endings; passes; smoothing of transitions.
CLUSTERED, CLASSES, ENDINGS, PASSES, ALPHA = 1_024, 64, 32, 3, 0.1
#: Occurrences from which every word is clustered; distributed rounds; counts by which a class pair is drawn to independence.
COMMON, ROUNDS, SHRINK = 10, 2, 5.0
_U = np.uint64


def _tokens(data: np.ndarray, hasher: tk.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ending classes) of the words of a text."""
    starts, ends, h = hasher.words(data)
    if not len(h):
        return h, np.zeros(0, np.int64)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    fold = hasher.fold
    return h, (fold[last] * 131 + fold[before].astype(np.int64) * 7).astype(np.int64) % ENDINGS


def _lookup(keys: np.ndarray, h: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in h whose hash is in the sorted keys, their index there); the sieve is a bitmap over 24 bits."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(sieve[(h >> _U(40)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    ok = keys[k] == h[at]
    return at[ok], k[ok]


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 24, dtype=bool)
    out[(keys >> _U(40)).astype(np.int64)] = True
    return out


def vocabulary(train: DataFrame) -> DataFrame:
    """(h, ending, c) of each distinct training word."""

    def count(batches):
        hasher = tk.Hasher(tk.class_space_delimited())
        for batch in tk.pieces(batches, 4096):
            got = [_tokens(t, hasher) for t in tk.texts(batch.column("text"))]
            h, e = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(_U).view(np.int64)), pa.array(e[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "ending", "c"])

    return train.select("text").mapInArrow(count, "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c"))


def encode(docs: DataFrame, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(rid, doc_id, held_out, n_tokens, known, logs, codes, h, n) of docs(rid, doc_id, held_out, text), the only pass that sees the texts after the vocabulary.

    ``codes`` are 32-bit numbers: a text's start, its words and its end; words of the sorted ``keys`` by their
    index, others len(keys) + ending, start and end behind those.  known and logs count the former and sum
    their log10(c + 0.5); h and n are the hashes of the others, each with its number.
    """
    bc = docs.sparkSession.sparkContext.broadcast((keys, counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)))

    def run(batches):
        keys, counts = bc.value
        hasher, sieve = tk.Hasher(tk.class_space_delimited()), _sieve(keys)
        for batch in tk.pieces(batches):
            stats, codes, hs, ns = [], [], [], []
            for t in tk.texts(batch.column("text")):
                h, e = _tokens(t, hasher)
                at, k = _lookup(keys, h, sieve)
                s = np.empty(len(h) + 2, np.uint32)
                s[0], s[-1] = len(keys) + ENDINGS, len(keys) + ENDINGS + 1
                s[1:-1] = len(keys) + e
                s[1 + at] = k
                rare = np.ones(len(h), bool)
                rare[at] = False
                u, n = np.unique(h[rare], return_counts=True)
                hs.append(u.view(np.int64))
                ns.append(n.astype(np.int32))
                codes.append(s.tobytes())
                stats.append((len(h) + 1, len(at), float(np.log10(counts[k] + 0.5).sum())))
            cols = list(zip(*stats, strict=True)) or [()] * 3
            off = np.concatenate([[0], np.cumsum([len(x) for x in hs])]).astype(np.int32)
            rare_cols = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x) if x else np.zeros(0, d), t)) for x, d, t in ((hs, np.int64, pa.int64()), (ns, np.int32, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], pa.array(codes, pa.binary()), *rare_cols], ["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "codes", "h", "n"])

    return docs.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, codes binary, h array<long>, n array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all codes of a batch, one text behind the other; where each text begins, and the end)."""
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data.view(np.uint32), (off - off[0]).astype(np.int64) // 4


def _symbol_table(rank: np.ndarray, ending: np.ndarray, words: int) -> np.ndarray:
    """Symbol of each code: rank of a key, or where that is negative the symbol of its ending; endings, start and end behind the first ``words`` symbols."""
    return np.concatenate([np.where(rank < 0, words + ending, rank), np.arange(words, words + ENDINGS + 2)]).astype(np.int32)


def bigrams(train: DataFrame, symbol: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring symbols of train(codes), ``symbol`` of each code; the last two of ``size`` symbols are a text's start and end."""
    bc = train.sparkSession.sparkContext.broadcast(symbol)

    def count(batches):
        symbol, total = bc.value, np.zeros(size * size, np.int64)
        for batch in batches:
            s = symbol[_flat(batch.column("codes"))[0]].astype(np.int64)
            total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        # an end before a start is where one text follows another
        total[(size - 1) * size + size - 2] = 0
        at = np.flatnonzero(total)
        for i in range(0, max(1, len(at)), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(total[at[i : i + (1 << 16)]])], ["code", "n"])

    rows = train.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[np.asarray(rows.column("code"))] = np.asarray(rows.column("n"))
    return out.reshape(size, size)


def affinity(m: np.ndarray, classes: int) -> np.ndarray:
    """[2 * symbols, classes]: what a neighbour behind, then one before, says for each class, as pointwise mutual information."""
    m = m.astype(np.float64)
    usual = m.sum(1)[:, None] * m.sum(0)[None, :] / max(1.0, m.sum())
    pmi = np.log((m + SHRINK) / (usual + SHRINK))
    return np.concatenate([pmi[:classes].T, pmi[:, :classes]])


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, but for what is the same for all clusterings."""
    xlx = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    m = m.astype(np.float64)
    return xlx(m) - xlx(m.sum(1)) - xlx(m.sum(0))


def exchange_round(train: DataFrame, ending: np.ndarray, cls: np.ndarray, classes: int, m: np.ndarray) -> np.ndarray:
    """The class that the neighbours of each key speak for most, its own on a tie; ``m`` counts the bigrams of classes ``cls`` in train(codes).

    A task counts its neighbours in a row a word, of 16-bit pairs; a count beyond that is several pairs.
    """
    size, n_keys = classes + ENDINGS + 2, len(cls)
    kind = np.uint16 if 2 * size <= 1 << 16 else np.uint32
    bc = train.sparkSession.sparkContext.broadcast((_symbol_table(cls, ending, classes), affinity(m, classes)))

    def neighbours(batches):
        symbol = bc.value[0]

        def flush(parts):
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            more = -(-n // 65535)
            if (more > 1).any():
                code, last = np.repeat(code, more), np.cumsum(more) - 1
                rest = n - 65535 * (more - 1)
                n = np.full(len(code), 65535)
                n[last] = rest
            w = code // (2 * size)
            word, first = np.unique(w, return_index=True)
            pairs = np.empty((len(code), 2), kind)
            pairs[:, 0], pairs[:, 1] = code % (2 * size), n
            flat, off = pairs.reshape(-1).view(np.uint8), np.append(first, len(code)) * 2 * pairs.itemsize
            for i in range(0, len(word), 1 << 14):
                o = off[i : i + (1 << 14) + 1]
                data = pa.Array.from_buffers(pa.binary(), len(o) - 1, [None, pa.py_buffer((o - o[0]).astype(np.int32)), pa.py_buffer(flat[o[0] : o[-1]])])
                yield pa.RecordBatch.from_arrays([pa.array(word[i : i + (1 << 14)].astype(np.int32)), data], ["w", "pairs"])

        parts, held = [], 0
        for batch in batches:
            codes = _flat(batch.column("codes"))[0]
            s, at = symbol[codes].astype(np.int64), np.flatnonzero(codes < n_keys)
            k = codes[at].astype(np.int64) * (2 * size)
            parts += [k + s[at + 1], k + size + s[at - 1]]
            held += 2 * len(k)
            if held > 1 << 22:
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)

    def move(batches):
        symbol, says = bc.value
        got = [(np.asarray(b.column("w")), *_flat_pairs(b.column("pairs"), kind)) for b in batches]
        if not got:
            return
        w = np.concatenate([np.repeat(word, count) for word, count, _ in got])
        pairs = np.concatenate([p for *_, p in got])
        order = np.argsort(w, kind="stable")
        w, pairs = w[order], pairs[order]
        word, first = np.unique(w, return_index=True)
        first = np.append(first, len(w))
        for i in range(0, len(word), 1024):
            a, b = first[i], first[min(i + 1024, len(word))]
            mine = word[i : i + 1024]
            local = np.searchsorted(mine, w[a:b])
            table = np.bincount(local * (2 * size) + pairs[a:b, 0], weights=pairs[a:b, 1], minlength=len(mine) * 2 * size).reshape(len(mine), 2 * size)
            score = table @ says
            best, old = score.argmax(1), symbol[mine].astype(np.int64)
            row = np.arange(len(mine))
            stay = (old < classes) & (score[row, np.minimum(old, classes - 1)] >= score[row, best] - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(np.where(stay, old, best).astype(np.int32))], ["w", "c"])

    rows = train.select("codes").mapInArrow(neighbours, "w int, pairs binary").repartition("w").mapInArrow(move, "w int, c int").toArrow()
    out = cls.copy()
    out[np.asarray(rows.column("w"))] = np.asarray(rows.column("c"))
    return out


def _flat_pairs(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of each row, all pairs) of a binary column."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(-1, 2)
    return np.diff(off) // (2 * np.dtype(kind).itemsize), data


def cluster(train: DataFrame, ending: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, int, np.ndarray]:
    """(class of each key, negative for the class of its ending; number of classes; counts of neighbouring symbols) from train(codes); ``n`` are the keys' counts."""
    order = np.lexsort((np.arange(len(n)), -n))
    top = np.sort(order[:CLUSTERED])
    cls = np.full(len(n), -1, np.int64)
    found = 0
    if len(top):
        rank = cls.copy()
        rank[top] = np.arange(len(top))
        cls[top] = exchange(bigrams(train, _symbol_table(rank, ending, len(top)), len(top) + ENDINGS + 2), len(top), CLASSES)[: len(top)]
        found = int(cls[top].max()) + 1
    rest = order[CLUSTERED:]
    # the other words begin among the rare ones, by their endings
    founders = rest[: max(found, int(len(n) ** 0.5) // 2) - found]
    classes = found + len(founders)
    cls[founders] = found + np.arange(len(founders))
    count = lambda: bigrams(train, _symbol_table(cls, ending, classes), classes + ENDINGS + 2)
    m, best = count(), None
    for _ in range(rounds if len(rest) else 0):
        cls = exchange_round(train, ending, cls, classes, m)
        m = count()
        if best is None or likelihood(m) > likelihood(best[1]):
            best = (cls, m)
    cls, m = best or (cls, m)
    return cls, classes, m


def exchange(counts: np.ndarray, words: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each symbol: the first ``words`` of them clustered by the exchange algorithm, the others in classes of their own."""
    n = counts.shape[0]
    classes = max(1, min(classes, words))
    cls = np.concatenate([np.arange(words) % classes, classes + np.arange(n - words)])
    size = classes + n - words
    counts = counts.astype(np.float64)
    rows = np.zeros((size, n))
    np.add.at(rows, cls, counts)
    m = np.zeros((size, size))
    np.add.at(m.T, cls, rows.T)
    xlx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(passes):
        moved = 0
        for w in range(words):
            old = cls[w]
            self_n = counts[w, w]
            right = np.bincount(cls, weights=counts[w], minlength=size)
            left = np.bincount(cls, weights=counts[:, w], minlength=size)
            right[old] -= self_n
            left[old] -= self_n
            m[old, :] -= right
            m[:, old] -= left
            m[old, old] -= self_n
            a = m[:classes]
            b = m[:, :classes].T
            gain = (xlx(a + right) - xlx(a)).sum(1) + (xlx(b + left) - xlx(b)).sum(1)
            d = np.arange(classes)
            diag = m[d, d]
            gain += xlx(diag + right[d] + left[d] + self_n) - xlx(diag + right[d]) - xlx(diag + left[d]) + xlx(diag)
            out_, in_ = a.sum(1), b.sum(1)
            tr, tl = right.sum() + self_n, left.sum() + self_n
            gain -= xlx(out_ + tr) - xlx(out_) + xlx(in_ + tl) - xlx(in_)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            m[new, :] += right
            m[:, new] += left
            m[new, new] += self_n
            cls[w] = new
            moved += new != old
        if not moved:
            break
    return cls


def score_texts(docs: DataFrame, modulus: int = 5, rest: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``, log10.

    Learned from all texts outside the held-out fold.  Words are ``[^\\x20\\x09-\\x0D]+`` after
    lower-casing A-Z, told apart by 64-bit hashes; every text ends with one end token; null texts are
    empty.  A null doc_id is in the training fold; repeated rows are counted and scored each; with no
    training text the counts are 0; an empty table gives an empty result; extra columns are ignored.  Texts
    of any length are counted and scored whole.
    """
    spark = docs.sparkSession
    docs = columns_only(docs, "doc_id", "text").select("doc_id", held_out(modulus, rest).alias("held_out"), "text")
    train = docs.where("not held_out")
    vocab = cut(vocabulary(train))
    n_docs = train.select("held_out").count()
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = total + n_docs, distinct + (n_docs > 0)

    common = vocab.where(F.col("c") >= COMMON)
    if common.count() < CLUSTERED:
        common = vocab.orderBy(F.desc("c"), "h").limit(CLUSTERED)
    common = common.select("h", "ending", "c").toArrow()
    keys = np.asarray(common.column("h")).view(_U)
    order = np.argsort(keys)
    keys, key_e, key_c = keys[order], np.asarray(common.column("ending")).astype(np.int64)[order], np.asarray(common.column("c"))[order]
    rows = cut(encode(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text"), keys, key_c))
    cls, classes, m = cluster(rows.where("not held_out"), key_e, key_c)
    size = len(m)
    move = np.log10(m + ALPHA) - np.log10(m.sum(1, keepdims=True) + ALPHA * size)
    symbol = _symbol_table(cls, key_e, classes)
    n_class = np.bincount(symbol[: len(keys)], weights=key_c, minlength=size)
    v_class = np.bincount(symbol[: len(keys)], minlength=size).astype(np.float64)
    for r in vocab.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mine = key_e == r.ending
        n_class[classes + r.ending] += r.c - key_c[mine].sum()
        v_class[classes + r.ending] += r.v - mine.sum()
    room = np.log10(n_class + 0.5 * (v_class + 1))
    room[-2:] = 0.0
    bc = spark.sparkContext.broadcast((symbol, move - room[None, :]))

    def model(batches):
        symbol, gain = bc.value
        for batch in batches:
            codes, begin = _flat(batch.column("codes"))
            s = symbol[codes]
            # from each symbol to the next; what leads from a text's end to the next text is no part of it
            step = np.append(gain[s[:-1], s[1:]], 0.0)
            step[begin[1:] - 1] = 0.0
            total = np.add.reduceat(step, begin[:-1]) if len(codes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(6)] + [pa.array(total)], ["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "model"])

    scored = rows.drop("h", "n").select("rid", "doc_id", "held_out", "n_tokens", "known", "logs", "codes").mapInArrow(model, "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double")
    rare = rows.select("rid", F.explode(F.arrays_zip("h", "n")).alias("x")).select("rid", "x.h", "x.n")
    # words seen before but not clustered
    tail = vocab.where(F.col("c") < F.lit(int(key_c.min()) if len(key_c) else 1) + 1).select("h", "c")
    found = rare.join(tail, "h", "left")
    sums = found.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("r_logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("r_known"))
    logs = F.col("logs") + F.coalesce("r_logs", F.lit(0.0))
    ended = float(np.log10(n_docs + 0.5))
    base = float(np.log10(n_all + 0.5 * (v_all + 1)))
    return scored.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("r_known", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (logs + F.lit(ended) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
