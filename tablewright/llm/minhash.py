"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set gets a signature of ``coords`` minima. A set is posted under its
coordinate-value pairs; two sets with at least ``matches`` equal coordinates must share one of
their ``coords - matches + 1`` rarest pairs, so only those (the prefix) are posted, and the pairs
that thousands of sets share are skipped wherever a set has rarer ones. Rareness comes from a
count sketch of fixed size; any order that all sets agree on keeps the result whole.

No posting list is expanded into all its pairs. Round one meets each member with the list's smallest set, its hub;
confirmed links make components. Round two meets only members of one hub that still lie in different components, in
blocks of bounded size. The collisions of a pair that meets in a posting are counted over all WIDE coordinates, by a merge of
both sets' lists of coordinate-value pairs (a byte of each value: a count never falls short); pairs above the match
threshold are confirmed on the full shingle sets, and components of confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import blocks, components, discard, partitions, runs, thinned, written
from tablewright.llm.text import mix, shingle_rows, word_hashes

COORDS = 64
#: Equal coordinates that a candidate needs. A pair at similarity 0.8 has 51 on average; fewer than 40 in 1 of 3,000.
MATCHES = 40
#: Coordinates that candidates are compared on before their texts are, and how many must be equal: a pair at
#: similarity 0.8 has 205 on average and fewer than 184 in 1 of 2,000; at 0.68 one pair in ten has as many.
WIDE, AGREE = 256, 184
#: Counters of the rareness sketch: its size is fixed, whatever the input.
SKETCH = 1 << 18
#: Members of one block in round two.
BLOCK = 1024
#: Pairs of a block compared at a time.
CHUNK = 1 << 15

_rng = np.random.default_rng(10)
_MULTIPLY = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64)


def signatures(found: np.ndarray, bounds: np.ndarray, coords: int = WIDE) -> np.ndarray:
    """The minimum of each hash function over every non-empty set, as rows of 32-bit values."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    best = np.empty((len(starts), coords), dtype=np.uint32)
    if len(starts):
        for i in range(coords):
            best[:, i] = mix(np.minimum.reduceat(found * _MULTIPLY[i] + _ADD[i], starts)) >> np.uint64(32)
    return best


def set_keys(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that stand for each non-empty set."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = mix(found), mix(found ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.add.reduceat(one, starts).view(np.int64), np.add.reduceat(two, starts).view(np.int64)


def tokens(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit token for every coordinate-value pair of the signatures (rows)."""
    return mix((np.arange(sigs.shape[1], dtype=np.uint64) << np.uint64(32)) | sigs)


def shingle_sets(docs: DataFrame, n: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_words, n_shingles, the set's key (f1, f2), its first COORDS coordinates and the low bytes of all WIDE.

    Equal coordinates have equal low bytes, so agreement counted in bytes never falls short.
    """

    def spread(values: np.ndarray, full: np.ndarray) -> np.ndarray:
        out = np.zeros(len(full), dtype=values.dtype)
        out[full] = values
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            hashes, rows = word_hashes(block.column("text"))
            found, bounds = shingle_rows(hashes, rows, n)
            full = np.diff(bounds) > 0
            one, two = set_keys(found, bounds)
            sigs = signatures(found, bounds)
            some = iter([x[:COORDS].tobytes() for x in sigs])
            low = iter([x.tobytes() for x in sigs.astype(np.uint8)])
            yield pa.RecordBatch.from_arrays(
                [*(block.column(k) for k in keys), pa.array(np.diff(rows)), pa.array(np.diff(bounds)), pa.array(spread(one, full)), pa.array(spread(two, full)), pa.array([next(some) if x else None for x in full], pa.binary()), pa.array([next(low) if x else None for x in full], pa.binary())],
                [*keys, "n_words", "n_shingles", "f1", "f2", "sig", "brief"],
            )

    kept = docs.select(*keys, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, n_words long, n_shingles long, f1 long, f2 long, sig binary, brief binary")


def _signatures(block: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(block.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDS)


def rareness(classes: DataFrame) -> np.ndarray:
    """Counts of all coordinate-value pairs in SKETCH counters, summed on the executors in fixed pieces."""
    piece = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((tokens(_signatures(batch)) % np.uint64(SKETCH)).astype(np.int64).ravel(), minlength=SKETCH)
        parts = [total[i : i + piece] for i in range(0, SKETCH, piece)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"]
        )

    def add(group):
        part = group["part"].iloc[0]
        total = np.zeros(piece, dtype=np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, dtype=np.int64)
        return group.iloc[:1].assign(part=part, counts=[total.tobytes()])

    summed = classes.select("sig").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros(SKETCH, dtype=np.int64)
    for row in summed.collect():  # SKETCH counters in all
        out[row.part * piece : (row.part + 1) * piece] = np.frombuffer(row.counts, dtype=np.int64)
    return out


def postings(classes: DataFrame) -> DataFrame:
    """(token, id) of each signature's COORDS - MATCHES + 1 rarest coordinate-value pairs."""
    counts = classes.sparkSession.sparkContext.broadcast(rareness(classes))
    prefix = COORDS - MATCHES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = tokens(_signatures(batch))
            often = counts.value[(own % np.uint64(SKETCH)).astype(np.int64)]
            order = np.lexsort((own, often), axis=1)[:, :prefix]
            ids = np.repeat(batch.column("id").to_numpy(), prefix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.take_along_axis(own, order, 1).ravel().view(np.int64)), pa.array(ids)], ["token", "id"]
            )

    return classes.select("id", "sig").mapInArrow(run, "token long, id long")


def _brief(block: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(block.column(column).to_pylist()), dtype=np.uint8).reshape(-1, WIDE)


def enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of fitting sizes whose signatures agree in AGREE of WIDE coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array((_brief(batch, "sa") == _brief(batch, "sb")).sum(axis=1) >= AGREE))

    one = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("brief").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("brief").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def set_table(texts: DataFrame, n: int) -> DataFrame:
    """(id, n, brief, found): the key, the size, the low bytes of the signature and the sorted shingle hashes of every text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            hashes, rows = word_hashes(block.column("text"))
            every, bounds = shingle_rows(hashes, rows, n)
            size = np.diff(bounds)
            full = np.flatnonzero(size > 0)
            low = signatures(every, bounds).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(set_keys(every, bounds)[0]), pa.array(size[full]), pa.array([x.tobytes() for x in low], pa.binary()),
                    pa.array([every[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                ["id", "n", "brief", "found"],
            )

    return texts.select("text").mapInArrow(run, "id long, n long, brief binary, found binary")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    small, large = sorted((x, y), key=len)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full shingle sets of the whole texts.

    sets gives one row (id, found) for each of a table of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("xa"), batch.column("xb"))
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "pairs")
    found = sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    links = written(
        pairs.join(found.select(F.col("id").alias("a"), F.col("found").alias("xa")), "a")
        .join(found.select(F.col("id").alias("b"), F.col("found").alias("xb")), "b")
        .select("a", "b", "xa", "xb")
        .mapInArrow(run, "a long, b long"),
        "links",
    )
    discard(pairs)
    return links


def _candidates(group: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x, y of a pair of blocks that lie in different components, fit in size and agree in AGREE of WIDE coordinates."""
    ids, size, part, i, j, own, token = (group.column(c).to_numpy() for c in ("id", "n", "component", "i", "j", "own", "token"))
    sig = _brief(group, "brief")
    x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
    fit = (part[x, None] != part[None, y]) & (100 * np.minimum(size[x, None], size[None, y]) >= percent * np.maximum(size[x, None], size[None, y]))
    fit &= (ids[x] != token[x])[:, None] & (ids[y] != token[y])[None, :]  # the hub has met all
    if i[0] == j[0]:
        fit &= x[:, None] < y[None, :]
    p, q = np.nonzero(fit)
    hit = [(sig[x[p[s : s + CHUNK]]] == sig[y[q[s : s + CHUNK]]]).sum(axis=1) >= AGREE for s in range(0, len(p), CHUNK)]
    hit = np.concatenate(hit) if hit else np.zeros(0, bool)
    return x[p[hit]], y[q[hit]]


def crossing(listed: DataFrame, classes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Confirmed links (a, b) among members of one hub that lie in different components.

    listed: token (the hub), id, component. Hubs within one component are dropped; the others' members are
    dealt into blocks of about BLOCK, and each pair of blocks is one bounded group. A first pass compares
    signatures and names the members that have a candidate; a second brings their shingle sets to the
    group and confirms there. Only links that join components of the group anew make a row: fewer than it has members.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["token", "i", "j"]):
            x, y = _candidates(group, percent)
            if len(x):
                yield group.take(pa.array(np.unique(np.concatenate([x, y]))))  # those that have a candidate

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["token", "i", "j"]):
            x, y = _candidates(group, percent)
            ids, part, sets = group.column("id").to_numpy(), group.column("component").to_numpy(), [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("found")]
            up, keep = {}, []

            def root(c):
                while c in up:
                    c = up[c]
                return c

            for p, q in zip(x.tolist(), y.tolist()):  # a link inside what links already join would change nothing
                c, d = sorted((root(int(part[p])), root(int(part[q]))))
                if c != d and _alike(sets[p], sets[q], percent):
                    up[d] = c
                    keep.append((p, q))
            one, two = (ids[[k[side] for k in keep]] if keep else ids[:0] for side in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    spans = (
        listed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2")
    )
    lists = listed.join(spans.select("token", F.expr(f"cast(ceil(m / {BLOCK}) as int)").alias("parts")), "token")
    lists = lists.join(classes.select("id", "n", "brief"), "id")
    dealt = lists.withColumn("own", F.expr("cast(pmod(xxhash64(id), parts) as int)")).withColumn(
        "other", F.explode(F.expr("sequence(0, parts - 1)"))
    )
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "component", "brief")
    order, count = ["token", "i", "j"], partitions(listed.sparkSession)
    schema = "token long, i int, j int, own int, id long, n long, component long, brief binary"
    asked = written(dealt.repartition(count, *order).sortWithinPartitions(*order).mapInArrow(some, schema), "asked")
    full = asked.join(sets(asked.select("id").distinct()), "id").select(*asked.columns, "found")
    links = full.repartition(count, *order).sortWithinPartitions(*order).mapInArrow(confirm, "a long, b long").distinct()
    links = written(links, "links")
    discard(asked)
    return links


def shared(posted: DataFrame) -> DataFrame:
    """(token, id) of the lists with two members or more; the others are taken out before anything is joined."""
    lists = written(posted.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "lists")
    out = written(thinned(posted, "token", lists).join(lists, "token", "left_semi").select("token", "id"), "posted")
    discard(lists)
    return out


def clusters(classes: DataFrame, posted: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, component) of the classes (id, n, brief) that confirmed links join; posted (token, id) says which may meet."""
    lists = posted.groupBy("token").agg(F.min("id").alias("a"))
    hubs = written(posted.join(lists, "token").where("id > a").select("a", F.col("id").alias("b")).distinct(), "hubs")
    links = confirmed(enough(hubs, classes, percent), sets, percent)
    parts = written(components(links), "parts")
    # lists with one hub hold much the same members: together they are one list, without the repeats
    members = hubs.select(F.col("a").alias("token"), F.col("b").alias("id")).union(hubs.select("a", "a").distinct())
    listed = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("token", "id", F.coalesce("component", "id").alias("component"))
    listed = written(listed, "listed")
    more = crossing(listed, classes, sets, percent)
    discard(hubs, links, listed)
    if more.isEmpty():
        return parts
    return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components of documents (doc_id, text; other columns are ignored).

    Returns one row per document: doc_id, n_shingles, class_id (smallest document with the same shingle set), component_id
    (smallest document reachable by links), kept. Null, empty and blank texts link with nothing. Rows with a null doc_id link with
    nothing, have no component and are not kept. Rows that repeat a doc_id are judged one by one, each by its own text.
    Texts are taken whole, however long; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    found = written(shingle_sets(docs, n), "shingled")
    full = found.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("brief").alias("brief"))
    classes = written(classes.select(F.col("f1").alias("id"), "first", "n", "sig", "brief"), "classes")

    def sets(ids: DataFrame) -> DataFrame:
        wanted = written(classes.join(ids, "id", "left_semi").select("id", F.col("first").alias("doc_id")), "wanted")
        texts = thinned(docs, "doc_id", wanted.select("doc_id")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        # by the set's key: a repeated doc_id may have other texts too
        return written(set_table(texts, n).join(wanted, "id", "left_semi").select("id", "found").dropDuplicates(["id"]), "sets")

    parts = clusters(classes, shared(postings(classes)), sets, percent)
    parts = written(parts, "parts")
    own = classes.select("id", "first").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    judged = own.join(least, "component").select(F.col("id").alias("f1"), F.col("first").alias("class_id"), "component_id")
    words = found.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("f1")).alias("f1"))
    out = words.join(judged, "f1", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
