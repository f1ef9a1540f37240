"""Mixing sources to target weights by entropy balancing.

Document rates w solve: least relative entropy to one copy each, subject to a token constraint for each
source, sum of w * size = target, and w <= 3.  The dual is convex with one multiplier a source, and its
solution is an exponentially tilted rate, w = min(3, exp(lambda * size / scale)).  Rates depend on the
source and the size alone, so the Newton iterations run distributed over the (source, size) histogram;
targets and multipliers are rows of a table of sources, of which there may be any number.
Rates are rounded into whole copies with the error carried on inside groups of about a thousand
documents of one source, dealt by a hash; large documents first, so that small ones take up the error.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.cluster import columns_only, cut, small

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, CAP, GROUP = (5, 2, 1), 3, 1024


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0, in code-point order of source with null last: rows are sorted by range, ranks are places in a range and what lies before it."""
    order = F.col("source").asc_nulls_last()
    rows = cut(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, total = [], 0
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r.part, total))
        total += r.n
    offset = sources.sparkSession.createDataFrame(before, "part long, before long")
    return rows.withColumn("part", part).join(F.broadcast(offset), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "at")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to totals(source, size, ...): a share of all sizes by weight (dealt in code-point order, null last), at most cap times the size; the excess is dealt again until none is above."""
    weighed = cut(ranked(totals).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank"))
    most = F.col("size") * float(cap)
    per = 0.0
    while True:
        # the share of a unit of weight only grows, so what was above stays above
        above = F.col("weight") * per > most
        full, left, open_ = weighed.agg(F.sum(F.col("size").cast("double")), F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        new = (full - left) / open_ if open_ else per
        if new <= per * (1 + 1e-12):
            return weighed.withColumn("target", F.least(F.col("weight") * per, most)).drop("weight")
        per = new


def _solve(hist: DataFrame, facts: DataFrame, cap: float, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """(source, lam) by safeguarded Newton steps, of facts(source, size, target, scale) and hist(source, size, n); sources at their cap have no row."""
    c, top = F.col, math.log(cap)
    state = facts.where((c("size") > 0) & (c("target") < c("size") * (cap * (1 - 1e-9)))).select(
        "source", "target", "scale", F.log(F.greatest("target", F.lit(1e-9)) / c("size")).alias("lam"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(False).alias("done"))
    state = cut(state)
    for _ in range(rounds):
        if not state.where("not done").limit(1).count():
            break
        now = small(state).alias("s")
        g = c("h.size") / c("s.scale")
        w = F.exp(F.least(c("s.lam") * g, F.lit(top)))
        sums = hist.alias("h").join(now, c("h.source").eqNullSafe(c("s.source"))).where("not s.done").groupBy(c("h.source").alias("key")).agg(
            F.sum(c("n") * c("h.size") * w).alias("f"),
            F.sum(F.when(c("s.lam") * g < top, c("n") * c("h.size") * g * w).otherwise(0.0)).alias("slope"),
        )
        gap = c("target") - c("f")
        near = F.abs(gap) <= tolerance * F.greatest(F.lit(1.0), c("target"))
        low, high = F.when(gap > 0, c("lam")).otherwise(c("low")), F.when(gap > 0, c("high")).otherwise(c("lam"))
        step = F.when(c("slope") > 0, gap / c("slope")).otherwise(F.signum(gap))
        new = c("lam") + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), step))
        # a step out of the bracket is replaced by its middle, or while it is open by a step of two
        inner = F.when((new > low) & (new < high), new).when((low > -math.inf) & (high < math.inf), (low + high) / 2).otherwise(c("lam") + 2 * F.signum(gap))
        moved = state.join(sums, state["source"].eqNullSafe(sums["key"]), "left").select(
            "source", "target", "scale", F.when(c("done") | near | c("f").isNull(), c("lam")).otherwise(inner).alias("lam"), F.when(c("done") | c("f").isNull(), c("low")).otherwise(low).alias("low"),
            F.when(c("done") | c("f").isNull(), c("high")).otherwise(high).alias("high"), (c("done") | c("f").isNull() | near).alias("done"))
        state = cut(moved)
    # sums of doubles differ in their last digits from run to run
    return state.select("source", F.round("lam", 9).alias("lam"))


def _round(table: pa.Table, cap: int) -> pa.Table:
    size, rate, u, row = (np.asarray(table.column(c)) for c in ("size", "rate", "u", "row"))
    order = np.lexsort((row, u, -size))
    copies, carry = np.zeros(len(size), np.int64), 0.0
    for i in order.tolist():
        n = int(size[i])
        if n:
            wish = rate[i] * n + carry
            c = min(cap, max(0, math.floor(wish / n + 0.5)))
            copies[i], carry = c, wish - c * n
    return table.append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row: copies of the document in the mix, taken = copies * size.

    Sizes count words ``[^\\x20\\x09-\\x0D]+`` of whole texts of any length; null and empty texts have size
    0 and no copies.  A null source is a source of its own.  Ties between equal sizes are ordered by a hash of
    doc_id, of repeated rows by their place; repeated rows are documents of their own, and ids with more rows
    than GROUP (a null id too) are dealt over the groups by place; an empty table gives an empty result; extra
    columns are ignored, but ``row`` may name a column of longs that is returned.
    """
    place = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`").cast("long")
    known = columns_only(docs, "doc_id", "text", "source") if row is None else columns_only(docs, row, "doc_id", "text", "source")
    rows = cut(known.select(place.alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    hist = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("sq"))
    scale = F.when(F.col("size") > 0, F.col("sq") / F.col("size")).otherwise(1.0)
    facts = cut(targets(totals, weights, cap).withColumn("scale", scale))
    lam = _solve(hist, facts, cap)
    dim = facts.alias("f").join(lam.alias("l"), F.col("f.source").eqNullSafe(F.col("l.source")), "left").select(
        F.col("f.source").alias("src"), F.col("f.size").alias("source_size"), "target", "scale", "lam", F.ceil(F.col("n") / GROUP).alias("groups"))
    dim = small(cut(dim))
    many = small(cut(rows.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP)))
    g = F.col("size") / F.col("scale")
    dealt = F.when(F.col("rows").isNotNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))
    rated = rows.join(dim, rows["source"].eqNullSafe(F.col("src"))).join(many, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "row", "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("lam") * g, F.lit(math.log(cap))))).alias("rate"),
        F.xxhash64("doc_id").alias("u"), F.pmod(F.xxhash64(dealt), F.col("groups")).alias("salt"),
    )

    def spread(key, table):
        del key
        return _round(table, cap).select(["row", "doc_id", "source", "size", "source_size", "target", "copies", "taken"])

    got = rated.groupBy("source", "salt").applyInArrow(spread, "row long, doc_id long, source string, size long, source_size long, target double, copies long, taken long")
    return got.drop("row") if row is None else got.withColumnRenamed("row", row)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
