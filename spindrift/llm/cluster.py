"""Session helpers: reliable checkpoints, size-checked broadcasts, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most three longs that a broadcast may hold (about 50 MB in an executor).
BROADCAST_ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder named by spark.checkpoint.dir; where it is unset, a temporary folder on a local master and an error on a cluster."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-"))
    return df.checkpoint(eager=True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already cut), marked for broadcast when a count proves it small; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``df``, absent ones as null, nothing else; so clashing extra columns cannot matter."""
    types = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: (node, component), component the smallest node reachable.

    Min-label propagation with pointer jumping; each round is a few joins with map-side minimums, so a
    hub of any degree is no hot task, and the rounds grow with the logarithm of the diameter.  Null
    ends are ignored; an empty input gives an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("c")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        step = labels.join(near, "node").select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("c").alias("j"))
        new = cut(step.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("j", "c")).alias("c")))
        changed = new.where("old <> c").limit(1).count()
        labels = new.select("node", "c")
        if not changed:
            return labels.select("node", F.col("c").alias("component"))
