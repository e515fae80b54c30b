"""What the corpus operators share: written intermediate tables, batching, components.

Intermediate results are Parquet tables in the folder that ``spark.checkpoint.dir`` names, which all
executors share, so a lost executor costs a re-read and never a recomputation of the lineage.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of its own only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Whether Spark deletes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table in the shared folder: the plan ends here, its shuffle files go, and later jobs read the table's files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as keep it from clashing with a column of df."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Bits of the filter that a table of keys is thinned by, at least and at most; its words of 32 bits are broadcast.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24


def thinned(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key may be among ``keys`` (one column of that name): all that are and a few others.

    A bit table of fixed size (16 bits a key, MOST_BITS at most: 524,288 rows to broadcast) spares a later join the shuffle of
    most other rows. With very many keys it fills up, lets all rows pass and the join alone decides: no row is ever lost.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(bits))
    word, bit = spare_name(df, "_word"), spare_name(df, "_bit")
    table = keys.select(F.shiftright(place, 5).cast("int").alias(word), F.call_function("shiftleft", F.lit(1), (place % 32).cast("int")).alias("_b")).groupBy(word)
    table = table.agg(F.bit_or("_b").alias("_b"))
    marked = df.withColumns({word: F.shiftright(place, 5).cast("int"), bit: F.call_function("shiftleft", F.lit(1), (place % 32).cast("int"))})
    held = spare_name(marked, "_held")
    marked = marked.join(F.broadcast(table.withColumnRenamed("_b", held)), word)
    return marked.where(F.col(bit).bitwiseAND(F.col(held)) != 0).drop(word, bit, held)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """df written, and metrics over its rows from the same job."""
    seen = Observation()
    out = written(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), name)
    return out, seen.get


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``most`` bytes of the text column each; a longer text comes alone."""
    for batch in batches:
        col = batch.column(column)
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        first = total = 0
        for i, n in enumerate(size):
            if i > first and total + n > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < len(size):
            yield batch.slice(first)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component), component the smallest node reachable.

    Distributed union-find by alternating large-star and small-star rounds. Every round is an
    aggregate to the smallest neighbour and a join with it, so a hub's edges are counted in the
    map side and its join partition can be split; no group of edges is ever held in one place.
    Nodes without an edge do not appear. Edges with a null end and loops are ignored.
    """
    star = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        roots = star.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        # a forest of stars: one parent for each node, and no parent that has one itself
        open_nodes = roots.where("n > 1").select("u").limit(1).union(
            star.join(roots.select(F.col("u").alias("v")), "v", "left_semi").select("u").limit(1)
        )
        if open_nodes.isEmpty():
            break
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large")
        discard(star)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        star, seen = observed(small, "star", n=F.count("*"), h=F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
        discard(large)
        if seen == before:
            break
        before = seen
    return star.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows with equal keys, from batches of a partition sorted by them. Groups must be bounded."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        change = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            col = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        at = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(at, at[1:]):
            yield batch.slice(s, e - s)
        rest = batch.slice(at[-1])
    if rest is not None:
        yield rest


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, where they do not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_tablewright", None) is None:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="tablewright-")) / "tablewright_package.zip"
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        context.addPyFile(str(path))
        context._tablewright = str(path)
    return spark
