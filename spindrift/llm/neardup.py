"""MinHash near-duplicate grouping with SuperMinHash signatures.

SuperMinHash (Ertl 2017): each element visits the m signature slots in its own random order, the
j-th visit carrying the value j + r; a slot keeps its minimum.  The values of one element are
correlated permutation ranks, which lowers the variance of the Jaccard estimate, and an element may
stop as soon as its next rank exceeds the largest slot of its document.

Plan: one pass over the texts makes set digest, band keys and a byte signature; documents with equal
sets collapse to their smallest id; every LSH bucket compares its smallest member with the others
(linear in the bucket); pairs are confirmed on the full sets; components follow.  Whatever a bucket
still holds in several components is then compared across those components in fixed-size blocks, a
signature estimate first and the full sets after; a block gives at most one row for a document and a
component, so no group is expanded into its pairs, and no link between components is left out.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkit as tk
from spindrift.llm.cluster import columns_only, components, cut, small

#: Slots of a signature, and rows of a band: 40 bands of 5; at similarity 0.8 a pair shares no band once in 7 million times.
SLOTS, ROWS = 200, 5
#: Members of a bucket compared in one block by signatures, documents compared in one block by full sets, and the estimate under
#: which a pair is not looked at (0.8 less about 4 deviations).
BLOCK, GRID, FLOOR = 512, 128, 0.68
_U = np.uint64


def superminhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, m: int = SLOTS, chunk: int = 1 << 16) -> np.ndarray:
    """uint64 signatures [n_docs, m] of hashed set ``elements`` owned by documents ``owner``; rank in the high half."""
    h = np.full((n_docs, m), _U(1) << _U(62), dtype=_U)
    flat = h.reshape(-1)
    for at in range(0, len(elements), chunk):
        e, o = elements[at : at + chunk], owner[at : at + chunk].astype(np.int64)
        perm = None
        for j in range(m):
            with np.errstate(over="ignore"):
                z = tk.mix(e + _U(j + 1) * _U(0x9E3779B97F4A7C15))
            k = (j + (((z & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)).astype(np.int64)
            v = (_U(j) << _U(32)) | (z >> _U(32))
            if perm is None:
                slot = k
            else:
                row = np.arange(len(e))
                slot = perm[row, k].astype(np.int64)
                perm[row, k] = perm[row, j]
            np.minimum.at(flat, o * m + slot, v)
            docs, inverse = np.unique(o, return_inverse=True)
            most = (h[docs].max(axis=1) >> _U(32)).astype(np.int64)
            go = most[inverse] > j
            if j + 1 == m or not go.any():
                break
            if perm is None:
                e, o, k = e[go], o[go], k[go]
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
                perm[np.arange(len(e)), k] = 0
            elif not go.all():
                e, o, perm = e[go], o[go], perm[go]
    return h


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """int64 bucket keys [n, bands]; the band's number is part of the key."""
    n, m = sig.shape
    x = np.zeros((n, m // rows), dtype=_U)
    with np.errstate(over="ignore"):
        x += np.arange(1, m // rows + 1, dtype=_U)[None, :] * _U(0xD1342543DE82EF95)
        for r in range(rows):
            x = tk.mix(x * _U(tk.MULT) + sig[:, r::rows][:, : m // rows])
    return x.view(np.int64)


def _sets(batch: pa.RecordBatch, hasher: tk.Hasher, k: int) -> list[np.ndarray]:
    return [tk.shingle_set(hasher.words(t)[2], k) for t in tk.texts(batch.column("text"))]


PRINT_SCHEMA = "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary"


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands, sig) of each document; n set size, d1 and d2 a 128-bit digest of the set."""

    def run(batches):
        hasher = tk.Hasher(tk.class_space_delimited())
        for batch in tk.pieces(batches, 256):
            sets = _sets(batch, hasher, k)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            sig = superminhash(np.concatenate(sets) if n.sum() else np.zeros(0, _U), np.repeat(np.arange(len(sets)), n), len(sets))
            with np.errstate(over="ignore"):
                d = [[int((tk.mix(s ^ _U(c)) if len(s) else s).sum(dtype=_U).view(np.int64)) for s in sets] for c in (0x1234567, 0x89ABCDEF0)]
            bands = band_keys(sig)
            low = (tk.mix(sig) & _U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(d[0], pa.int64()), pa.array(d[1], pa.int64()),
                 pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.reshape(-1))),
                 pa.array([r.tobytes() for r in low], pa.binary())],
                ["doc_id", "n", "d1", "d2", "bands", "sig"],
            )

    return columns_only(docs, "doc_id", "text").mapInArrow(run, PRINT_SCHEMA)


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        hasher = tk.Hasher(tk.class_space_delimited())
        for batch in tk.pieces(batches, 256):
            sets = _sets(batch, hasher, k)
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if off[-1] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(off, pa.array(flat))], ["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct ``pairs(a, b)`` those whose full shingle sets have 100 * intersection >= percent * union."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = _full_sets(columns_only(docs, "doc_id", "text").join(small(ids), "doc_id", "left_semi"), k)
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _stray_rows(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (x, comp): member x may have a link to a member of component comp, by rows(bucket, i, j, part, rep, n, comp, main, sig).

    Part 0 are the members outside of the bucket's main component, part 1 all.  Looks at every pair of members
    of a block whose components differ, and keeps one row for a member and a component, however many pairs of
    them pass the signature estimate.
    """

    def run(key, table):
        del key
        rep, n, comp, part, main = (np.asarray(table.column(c)) for c in ("rep", "n", "comp", "part", "main"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
        left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        xs, cs = [], []
        for x in left:
            # of two members outside the main component the one of the later component asks
            y = right[(comp[right] == main[right]) | (comp[right] < comp[x])]
            y = y[np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y])]
            if len(y):
                c = np.unique(comp[y[(sig[y] == sig[x]).mean(axis=1) >= FLOOR]])
                xs.append(np.full(len(c), rep[x]))
                cs.append(c)
        empty = np.zeros(0, np.int64)
        return pa.table({"x": np.concatenate(xs) if xs else empty, "comp": np.concatenate(cs) if cs else empty})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "x long, comp long").distinct()


def _first_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): for each x of a block the first member of the component it is linked with, on full sets.

    rows(comp, i, j, part, id, s): part 0 are the strays x, part 1 the component's members.
    """

    def run(key, table):
        del key
        ids, part = (np.asarray(table.column(c)) for c in ("id", "part"))
        sets = table.column("s").combine_chunks()
        off, flat = np.asarray(sets.offsets), np.asarray(sets.values)
        left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        size = np.diff(off)
        values = np.concatenate([flat[off[y] : off[y + 1]] for y in right]) if len(right) else flat[:0]
        owner = np.repeat(np.arange(len(right)), size[right])
        a, b = [], []
        for x in left:
            mine = np.sort(flat[off[x] : off[x + 1]])
            at = np.minimum(np.searchsorted(mine, values), max(0, len(mine) - 1))
            common = np.bincount(owner[mine[at] == values], minlength=len(right)) if len(mine) else np.zeros(len(right), np.int64)
            hit = np.flatnonzero(100 * common >= percent * (size[x] + size[right] - common))
            if len(hit):
                a.append(min(ids[right[hit[0]]], ids[x]))
                b.append(max(ids[right[hit[0]]], ids[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("comp", "i", "j").applyInArrow(run, "a long, b long")


def _grid(df: DataFrame, part: int, rows: str, columns: str, own: str) -> DataFrame:
    """Deals one side over a grid of rows x columns blocks: part 0 to one row and every column, part 1 the other way."""
    block, every = F.pmod(F.xxhash64(own), F.col(rows if part == 0 else columns)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(columns if part == 0 else rows) - 1))
    return df.withColumn("i", block if part == 0 else every).withColumn("j", every if part == 0 else block).withColumn("part", F.lit(part)).drop(rows, columns)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct k-word
    shingles, or its whole word sequence when it has fewer than k words.  Texts that are null, empty or
    without words have an empty set and are linked with nothing; a null doc_id has a null component and
    is kept; rows that share a doc_id are one document; ties go to the smallest id; extra columns are
    ignored; an empty table gives an empty result.  Texts of any length are taken whole.
    """
    prints = cut(fingerprints(docs, k))
    ids = prints.where("doc_id is not null and n > 0")
    classes = cut(ids.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sig", "doc_id").alias("sig")))
    member = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    stats = member.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = cut(member.join(stats, "bucket").select("bucket", "pivot", "rep", "n"))
    sizes = classes.select(F.col("rep").alias("pivot"), F.col("n").alias("pn"))
    star = shared.where("pivot <> rep").groupBy("pivot", "rep").agg(F.first("n").alias("n")).join(sizes, "pivot")
    star = cut(star.where(F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent).select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    links = cut(confirm(docs, star, k, percent))
    first = components(links)

    blocks = lambda n, size=BLOCK: F.ceil(F.col(n) / size).cast("int")
    labelled = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    # what is dealt over the grid are the members outside of the bucket's largest component, against all
    mixed = (
        labelled.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket")
        .agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("size")).where("most < size")
        .withColumn("others", F.col("size") - F.col("most")).select("bucket", "main", blocks("others").alias("rows"), blocks("size").alias("columns"))
    )
    rest = labelled.join(mixed, "bucket").join(classes.select("rep", "sig"), "rep")
    left, right = _grid(rest.where("comp <> main"), 0, "rows", "columns", "rep"), _grid(rest, 1, "rows", "columns", "rep")
    stray = cut(_stray_rows(left.unionByName(right), percent))
    members = classes.select("rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("rep").alias("id"), F.coalesce("component", "rep").alias("comp"))
    members = cut(members.join(stray.select("comp").distinct(), "comp"))
    shape = stray.groupBy("comp").agg(F.count("*").alias("x")).join(members.groupBy("comp").agg(F.count("*").alias("y")), "comp").select("comp", blocks("x", GRID).alias("rows"), blocks("y", GRID).alias("columns"))
    left = _grid(stray.withColumnRenamed("x", "id").join(shape, "comp"), 0, "rows", "columns", "id")
    right = _grid(members.join(shape, "comp"), 1, "rows", "columns", "id")
    ids = cut(stray.select(F.col("x").alias("doc_id")).unionByName(members.select(F.col("id").alias("doc_id"))).distinct())
    sets = _full_sets(columns_only(docs, "doc_id", "text").join(small(ids), "doc_id", "left_semi"), k)
    more = cut(_first_links(left.unionByName(right).join(sets, "id"), percent))

    final = components(links.unionByName(more))
    owner = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    return prints.select("doc_id", "n", "d1", "d2").join(owner, ["d1", "d2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull() | F.col("component").isNull(), F.lit(True)).otherwise(F.col("doc_id") == F.col("component")).alias("kept"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
