"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the concatenated signs of random
projections, and compares all vectors whose strings begin with the same ``bits`` signs, in blocks of
bounded size, so that nothing hangs on the ranges that tasks get; what a block links is handed on as
stars, one edge for each vector at most. The union of all passes gives components.
Links are then counted exactly among all members of a component, in blocks, so a group larger than
any block loses none. Equal vectors of a label are one class throughout and are never paired.

Two vectors at the threshold agree in a sign with probability 1 - arccos(threshold) / pi, and meet in a
pass when they agree in the first ``bits``, however their label's vectors lie: the passes that a number
of bits asks for follow from it. The bits of a label are those that make the least work by its counted cells, so
a label whose vectors share a direction gets larger cells or, with no bits at all, one pass over all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import components, partitions, runs, written

#: Chance that one pair at the threshold is met in no pass.
MISSED = 0.003
SIGNS = 48
BLOCK = 512
#: Vectors of one block where a cell is compared.
CELL = 1024


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit vectors of a binary column that holds doubles."""
    x = np.frombuffer(b"".join(col.to_pylist()), dtype=np.float64).reshape(len(col), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _row():
    return F.xxhash64("label", "embedding").alias("row")


def _read(rows: DataFrame) -> DataFrame:
    """vec_id, row (a hash of label and vector), label, dim, k1, k2, raw for every vector that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec, row, label, values in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "label", "embedding"))):
                if vec is None or label is None or not values or None in values:
                    continue
                x = np.array(values, dtype=np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()  # so that squares stay finite
                key = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64)
                out.append((vec, row, label, len(x), int(key[0]), int(key[1]), x.tobytes()))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                ["vec_id", "row", "label", "dim", "k1", "k2", "raw"],
            )

    picked = rows.select("vec_id", _row(), F.col("label").cast("string").alias("label"), "embedding")
    return picked.mapInArrow(run, "vec_id long, row long, label string, dim int, k1 long, k2 long, raw binary")


def passes_for(bits: int, threshold: float, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold has agreed in the first ``bits`` signs of none with the given chance."""
    met = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if met >= 1 else max(1, math.ceil(math.log(missed) / math.log1p(-met)))


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pass, label, dim, signs, id for every pass of the row's own number of passes."""
    for batch in batches:
        for s in range(0, batch.num_rows, 1024):
            part = batch.slice(s, 1024)
            dims, own_passes = part.column("dim").to_numpy(), part.column("passes").to_numpy()
            for dim, most in np.unique(np.stack([dims, own_passes]), axis=1).T:
                own = part.filter(pa.array((dims == dim) & (own_passes == most)))
                unit = _matrix(own.column("raw"))
                for p in range(most):
                    planes = np.random.default_rng((p, int(dim))).standard_normal((int(dim), SIGNS))
                    signs = (unit @ planes > 0).astype(np.int64) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(signs), p, dtype=np.int32)), own.column("label"), own.column("dim"), own.column("bits"), pa.array(signs), own.column("id")],
                        ["pass", "label", "dim", "bits", "signs", "id"],
                    )


_SIGNED = "pass int, label string, dim int, bits int, signs long, id long"


def planned(classes: DataFrame, threshold: float, cell: int) -> DataFrame:
    """label, dim, bits, passes: the bits that make the fewest copies of rows, by the cells of the first pass."""
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    depths = range(min(SIGNS, math.ceil(math.log2(max(1, largest / cell))) + 9) if largest > cell else 1)
    first = classes.select("id", "label", "dim", "raw", F.lit(0).alias("bits"), F.lit(1).alias("passes")).mapInArrow(_signs, _SIGNED)
    prefix = F.expr(f"shiftright(signs, {SIGNS} - bits)")
    tried = first.select("label", "dim", "signs", F.explode(F.array(*map(F.lit, depths))).alias("bits"))
    cells = tried.groupBy("label", "dim", "bits", prefix.alias("prefix")).agg(F.count("*").alias("n"))
    passes = F.get(F.array(*[F.lit(passes_for(b, threshold)) for b in depths]), F.col("bits"))
    work = cells.groupBy("label", "dim", "bits").agg(F.sum(F.expr(f"n * ceil(n / {cell})")).alias("copies")).withColumn("passes", passes)
    best = work.groupBy("label", "dim").agg(F.min(F.struct((F.col("copies") * F.col("passes")).alias("work"), "bits", "passes")).alias("best"))
    return best.select("label", "dim", "best.bits", "best.passes")


def _stars(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the links x-y reach."""
    low = np.arange(n)
    while len(x):
        before = low.copy()
        np.minimum.at(low, y, low[x])
        np.minimum.at(low, x, low[y])
        low = low[low]
        if (low == before).all():
            break
    return low


def _neighbours(classes: DataFrame, threshold: float, cell: int) -> DataFrame:
    """Edges (a, b) from every pass; a and b are joined by verified links."""
    order = ["pass", "label", "dim", "prefix", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, order):
            unit, ids = _matrix(group.column("raw")), group.column("id").to_numpy()
            i, j, own = (group.column(c).to_numpy() for c in ("i", "j", "own"))
            near = np.triu(unit @ unit.T >= threshold, 1)
            if i[0] != j[0]:  # within a block they are compared elsewhere
                near &= own[:, None] != own[None, :]
            low = _stars(len(ids), *np.nonzero(near))
            far = np.flatnonzero(low != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[low[far]]), pa.array(ids[far])], ["a", "b"])

    plan = written(planned(classes, threshold, cell), "plan")
    signed = classes.join(plan, ["label", "dim"]).select("id", "label", "dim", "raw", "bits", "passes").mapInArrow(_signs, _SIGNED)
    signed = written(signed.select("pass", "label", "dim", F.expr(f"shiftright(signs, {SIGNS} - bits)").alias("prefix"), "id"), "signed")
    sizes = signed.groupBy(*order[:4]).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(*order[:4], F.expr(f"cast(ceil(n / {cell}) as int)").alias("parts"))
    dealt = signed.join(sizes, order[:4]).withColumn("own", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.select(*order, "own", "id").join(classes.select("id", "raw"), "id").select(*order, "own", "id", "raw")
    dealt = dealt.repartition(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(compare, "a long, b long").where("a != b").distinct()


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): for each class the vectors of other classes of its component that it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["component", "i", "j"]):
            unit, ids, size = _matrix(group.column("raw")), group.column("id").to_numpy(), group.column("n").to_numpy()
            i, j, own = (group.column(c).to_numpy() for c in ("i", "j", "own"))
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            if i[0] != j[0]:  # within a block they are counted elsewhere
                near &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near * size[None, :]).sum(axis=1).astype(np.int64))], ["id", "linked"])

    sizes = members.groupBy("component").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("parts"))
    dealt = members.join(sizes, "component").withColumn("own", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns(
        {"i": F.least("own", "other"), "j": F.greatest("own", "other")}
    )
    dealt = dealt.select("component", "i", "j", "own", "id", "n", "raw")
    dealt = dealt.repartition(partitions(members.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(run, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def near_vectors(rows: DataFrame, threshold: float = 0.93, cell: int = CELL) -> DataFrame:
    """Links by cosine >= threshold among vectors of one label (vec_id, label, embedding; others are ignored).

    Returns a row per input row: vec_id, n_links, component_id, kept, class_id (smallest vec_id with an
    equal vector and label). Vectors that are null, empty, zero or hold null or non-finite components,
    and those without label or vec_id, link with nothing; so do vectors of unequal length. Rows that
    repeat vec_id, label and vector count once; rows that repeat a vec_id with another vector or label are judged one by one.
    An empty table gives an empty result.
    """
    found = written(_read(rows), "vectors")
    key = ["label", "dim", "k1", "k2"]
    classes = found.select(*key, "vec_id").distinct().groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = classes.withColumn("id", F.xxhash64(*key))  # a vec_id may stand in several classes
    named = written(found.select("vec_id", "row", *key).distinct().join(classes, key).select("vec_id", "row", "id", "first", "n"), "named")
    unique = found.join(classes, key).where("vec_id = first").dropDuplicates(key)
    unique = written(unique.select("id", "first", "n", "label", "dim", "raw"), "classes")
    edges = _neighbours(unique, threshold, cell)
    parts = written(components(edges), "parts").withColumnsRenamed({"node": "id"})
    counted = _counted(unique.join(parts, "id").select("component", "id", "n", "raw"), threshold)
    least = unique.select("id", "first").join(parts, "id").groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = parts.join(least, "component").join(counted, "id", "left").select("id", "component_id", "linked")
    per_vector = named.join(per_class, "id", "left").select(
        "vec_id",
        "row",
        (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "first").alias("component_id"),
        F.col("first").alias("class_id"),
    )
    keyed = rows.select("vec_id", _row()).join(per_vector, ["vec_id", "row"], "left")
    return keyed.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
        F.coalesce("class_id", "vec_id").alias("class_id"),
    )
