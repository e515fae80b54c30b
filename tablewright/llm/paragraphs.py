"""Paragraph dedup by MinHash banding.

A paragraph is a line of at least ``least_words`` words. Equal shingle sets are one class. A class is posted under band keys of
ROWS signature coordinates each; their number is tuned for high recall (bands_for): a pair at similarity 0.8 shares one of ten with
probability 1 - (1 - 0.8 ** 3) ** 10 = 0.9992. Only the band keys are kept of all paragraphs; whole shingle sets and wider
signatures are made of those that collide. Colliding classes are verified by exact Jaccard similarity of their word shingles,
links make components, and all paragraphs of a component but the first (by document and number) are removed.

A passage that repeats inside a longer paragraph is found the same way, if ``passages`` are asked for: windows of WINDOW words of
the paragraphs that stay, banded, verified and joined like paragraphs. A window begins where a shingle's hash is the least of
PASSAGE - WINDOW + 1 in a row, whatever stands around, so any PASSAGE words in a row that two paragraphs share hold a window that both have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import blocks, discard, spare_name, thinned, written
from tablewright.llm.minhash import clusters, set_keys, set_table, shared, signatures
from tablewright.llm.text import mix, shingle_rows, shingle_starts, word_hashes

#: Coordinates of a band: few, so that bands collide often.
ROWS = 3
#: Share of the pairs at the threshold that bands must bring together.
RECALL = 0.999
SHINGLE = 5
PERCENT = 80
LEAST_WORDS = 1
#: Text that is hashed at a time, which bounds what a worker holds.
BYTES = 1 << 18
#: Words of a passage that is surely found, where it repeats word by word, and of the windows that it is found by: more than
#: half, so that windows of one passage leave no gap. Up to 24 words at either end of a passage may lie in no window.
PASSAGE, WINDOW = 50, 26
#: Bands of a window: equal ones meet in all, those at similarity 0.8 in one or more with probability 0.88.
WINDOW_BANDS = 3


def bands_for(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands that pairs at the threshold share one of with probability ``recall``: 10 at 80 percent."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - (percent / 100) ** rows)) - 1e-9))


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_no, text of every paragraph; null texts and null doc_ids have none."""
    return docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_no", "text"))


def place():
    """A number that orders paragraphs by document and place."""
    wide = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("para_no").cast("decimal(10,0)")
    return wide.cast("decimal(38,0)")


def band_keys(found: np.ndarray, bounds: np.ndarray, bands: int, rows: int = ROWS) -> list[pa.Array]:
    """The keys of each band of every non-empty set."""
    sigs = signatures(found, bounds, bands * rows).astype(np.uint64).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), sigs.shape[:2])
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, r])
    return [pa.array(np.ascontiguousarray(key[:, i]).view(np.int64)) for i in range(bands)]


def banded(docs: DataFrame, n: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, para_no, n_words, f1, f2 (the shingle set's key) and band keys k0, k1, ... of every paragraph with a word."""
    names = [f"k{i}" for i in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BYTES):
            hashes, at = word_hashes(block.column("text"))
            found, bounds = shingle_rows(hashes, at, n)
            full = np.diff(bounds) > 0
            own = block.filter(pa.array(full))
            keys = band_keys(found, bounds, bands, rows)
            one, two = set_keys(found, bounds)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("para_no"), pa.array(np.diff(at)[full]), pa.array(one), pa.array(two), *keys], ["doc_id", "para_no", "n_words", "f1", "f2", *names])

    own = split_paragraphs(docs)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, para_no int, n_words long, f1 long, f2 long, {', '.join(f'{k} long' for k in names)}")


def removed_paragraphs(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, para_no, first_doc_id, first_para_no: the removed paragraphs and the one kept in their stead.

    docs: doc_id, text; other columns are ignored. A paragraph with fewer than n words is one shingle, so it is like equal
    ones only. Null texts, null doc_ids and blank lines have no paragraph. Paragraphs are taken whole, however long. Rows that repeat a
    doc_id stand for one document: paragraphs with equal number and words stand or fall together.
    """
    docs = docs.select("doc_id", "text")
    bands = bands_for(percent)
    names = [f"k{i}" for i in range(bands)]
    found = banded(docs, n, bands).where(F.col("n_words") >= least_words).withColumn("place", place())
    classes = found.groupBy("f1", "f2").agg(F.min("place").alias("place"), F.count("*").alias("size"), *[F.min(k).alias(k) for k in names])
    classes = written(classes.withColumnRenamed("f1", "id").drop("f2"), "classes")
    posted = shared(classes.select("id", F.explode(F.array(*names)).alias("token")))
    # sets and signatures of those only that share a band with another
    wanted = written(classes.join(posted.select("id").distinct(), "id", "left_semi").select("id", "place"), "wanted")
    own = split_paragraphs(docs).withColumn("place", place())
    texts = thinned(own, "place", wanted.select("place")).join(wanted.select("place").distinct(), "place", "left_semi")
    table = written(set_table(texts, n).join(wanted, "id", "left_semi").dropDuplicates(["id"]), "sets")
    parts = written(clusters(table, posted, lambda ids: table.join(ids, "id", "left_semi").select("id", "found"), percent), "parts")
    discard(posted, wanted, table)
    joined = classes.select("id", "place", "size").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = joined.groupBy("component").agg(F.min("place").alias("first"), F.sum("size").alias("all")).where("all > 1")
    judged = written(joined.join(first, "component").select(F.col("id").alias("f1"), "first"), "judged")
    discard(classes, parts)
    gone = keyed(docs, n).join(judged, "f1").withColumn("place", place()).where("place != first")
    base = F.lit(1 << 31).cast("decimal(11,0)")
    return gone.select("doc_id", "para_no", F.floor(F.col("first") / base).cast("long").alias("first_doc_id"), F.pmod("first", base).cast("int").alias("first_para_no")).distinct()


def keyed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, para_no, f1 of every paragraph with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BYTES):
            hashes, at = word_hashes(block.column("text"))
            found, bounds = shingle_rows(hashes, at, n)
            own = block.filter(pa.array(np.diff(bounds) > 0))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("para_no"), pa.array(set_keys(found, bounds)[0])], ["doc_id", "para_no", "f1"])

    own = split_paragraphs(docs)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, para_no int, f1 long")


def _slid(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over every ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        x, span = f(x[:-span], x[span:]), 2 * span
    return f(x[: -(width - span)], x[width - span :]) if span < width else x


def windows(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and first word of each window, then the shingle sets of all windows end to end, each sorted, and their bounds.

    Rows of fewer than PASSAGE words have none. Shingles have n words, a window's words at most.
    """
    n, width, runs = min(n, WINDOW), PASSAGE - WINDOW + 1, len(hashes) - PASSAGE + 1
    none = np.zeros(0, dtype=np.int64)
    if runs <= 0 or np.diff(at).max() < PASSAGE:
        return none, none, hashes[:0], np.zeros(1, dtype=np.int64)
    each = shingle_starts(hashes, n) | np.uint64(1)  # none is 0
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least = _slid(np.minimum, each[: runs + width - 1], width)
    least[row[:runs] != row[PASSAGE - 1 :]] = 0  # these words are no passage of one row
    edge = np.zeros(width - 1, dtype=np.uint64)
    starts = np.flatnonzero(_slid(np.maximum, np.concatenate([edge, least, edge]), width) == each[: runs + width - 1])
    sets = np.sort(np.lib.stride_tricks.sliding_window_view(each, WINDOW - n + 1)[starts], axis=1)
    new = np.ones(sets.shape, dtype=bool)
    new[:, 1:] = sets[:, 1:] != sets[:, :-1]
    return row[starts], starts - at[row[starts]], sets[new], np.concatenate([[0], np.cumsum(new.sum(axis=1))])


def windowed(paragraphs: DataFrame, n: int) -> DataFrame:
    """doc_id, para_no, start, id (the shingle set's key) and band keys k0, k1, ... of every window of paragraphs (doc_id, para_no, text)."""
    names = [f"k{i}" for i in range(WINDOW_BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BYTES):
            row, start, found, bounds = windows(*word_hashes(block.column("text")), n)
            own = block.select(["doc_id", "para_no"]).take(pa.array(row))  # not the text, which would stand there for each of its windows
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("para_no"), pa.array(start, pa.int32()), pa.array(set_keys(found, bounds)[0]), *band_keys(found, bounds, WINDOW_BANDS)], ["doc_id", "para_no", "start", "id", *names])

    own = paragraphs.select("doc_id", "para_no", "text")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, para_no int, start int, id long, {', '.join(f'{k} long' for k in names)}")


def window_sets(paragraphs: DataFrame, n: int) -> DataFrame:
    """(id, n, brief, found) of every window of paragraphs, as minhash.set_table has of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BYTES):
            _, _, found, bounds = windows(*word_hashes(block.column("text")), n)
            key, first = np.unique(set_keys(found, bounds)[0], return_index=True)
            brief = [x.tobytes() for x in signatures(found, bounds).astype(np.uint8)[first]]
            sets = [found[bounds[i] : bounds[i + 1]].tobytes() for i in first]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.diff(bounds)[first]), pa.array(brief, pa.binary()), pa.array(sets, pa.binary())], ["id", "n", "brief", "found"])

    return paragraphs.select("text").mapInArrow(run, "id long, n long, brief binary, found binary")


def removed_windows(docs: DataFrame, gone: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, para_no, start of every window of WINDOW words, from word start on, that is like one in an earlier paragraph.

    gone: doc_id, para_no of paragraphs that are removed; their windows are neither removed nor kept in another's stead.
    """
    # so many words have so many bytes at least
    own = split_paragraphs(docs.select("doc_id", "text")).where(F.octet_length("text") >= 2 * PASSAGE - 1)
    found = written(windowed(own, n), "windows")
    tokens = F.explode(F.array(*[f"k{i}" for i in range(WINDOW_BANDS)])).alias("token")
    posted = written(shared(found.select("id", tokens)).distinct(), "posted")  # equal windows too
    ids = written(posted.select("id").distinct(), "ids")
    some = written(thinned(found.select("doc_id", "para_no", "start", "id"), "id", ids).join(ids, "id", "left_semi").withColumn("place", place()), "some")
    discard(found, ids)
    # the sets of those only that share a band with another set
    near = shared(posted)
    wanted = written(some.join(near.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("place").alias("place")), "wanted")
    texts = thinned(own.withColumn("place", place()), "place", wanted.select("place").distinct()).join(wanted.select("place").distinct(), "place", "left_semi")
    table = written(window_sets(texts, n).join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "sets")
    parts = written(clusters(table, near, lambda ids: table.join(ids, "id", "left_semi").select("id", "found"), percent), "parts")
    discard(posted, near, wanted, table)
    stay = some.join(gone.select("doc_id", "para_no").distinct(), ["doc_id", "para_no"], "left_anti")
    stay = stay.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    stay = written(stay.select("doc_id", "para_no", "start", "place", "component"), "stay")
    first = stay.groupBy("component").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    out = written(stay.join(first, "component").where("place != first").select("doc_id", "para_no", "start").distinct(), "gone")
    discard(some, parts, stay)
    return out


def removed_passages(docs: DataFrame, gone: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, para_no, start, n_words of every removed passage: the removed windows of a paragraph that overlap or touch, together."""
    starts = removed_windows(docs, gone, n, percent).groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_set("start")).alias("s"))
    heads = F.expr(f"filter(s, (x, i) -> i = 0 or s[i - 1] + {WINDOW} < x)")
    tails = F.expr(f"filter(s, (x, i) -> i = size(s) - 1 or x + {WINDOW} < s[i + 1])")
    return starts.select("doc_id", "para_no", F.explode(F.arrays_zip(heads.alias("h"), tails.alias("t"))).alias("x")).select(
        "doc_id", "para_no", F.col("x.h").alias("start"), (F.col("x.t") + WINDOW - F.col("x.h")).alias("n_words")
    )


def report(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, least_words: int = LEAST_WORDS, passages: bool = False) -> DataFrame:
    """doc_id, n_paragraphs, n_removed, removed_paragraphs (numbers in order), first_doc_ids (where their first copies are).

    With passages: n_removed counts removed passages too, and removed_passages has para_no, start and n_words of each, in order.
    """
    pairs = removed_paragraphs(docs, n, percent, least_words)
    pairs = written(pairs, "removed") if passages else pairs
    gone = pairs.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("para_no")).alias("removed_paragraphs"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids")
    )
    counted = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n_paragraphs"))
    joined = counted.join(gone, "doc_id", "left")
    numbers, ids = F.coalesce("removed_paragraphs", F.array().cast("array<int>")), F.coalesce("first_doc_ids", F.array().cast("array<bigint>"))
    if not passages:
        return joined.select("doc_id", "n_paragraphs", F.size(numbers).alias("n_removed"), numbers.alias("removed_paragraphs"), ids.alias("first_doc_ids"))
    found = removed_passages(docs, pairs, n, percent).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_no", "start", "n_words"))).alias("removed_passages"))
    parts = F.coalesce("removed_passages", F.array().cast("array<struct<para_no: int, start: int, n_words: int>>"))
    return joined.join(found, "doc_id", "left").select(
        "doc_id", "n_paragraphs", (F.size(numbers) + F.size(parts)).alias("n_removed"), numbers.alias("removed_paragraphs"), ids.alias("first_doc_ids"), parts.alias("removed_passages")
    )


def dedup(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, least_words: int = LEAST_WORDS, passages: bool = False) -> DataFrame:
    """docs with the removed paragraphs taken out of text; null texts stay null, other columns stay as they are.

    With passages, the words of removed passages go too; what is left of their paragraphs has single spaces.
    """
    gone, spans = spare_name(docs, "_gone"), spare_name(docs, "_spans")
    pairs = written(removed_paragraphs(docs, n, percent, least_words), "removed")
    numbers = pairs.groupBy("doc_id").agg(F.collect_set("para_no").alias(gone))
    split = F.split("text", "\n", -1)
    out = docs.join(written(numbers, "gone"), "doc_id", "left")
    whole, own = F.col("text").isNull() | F.col(gone).isNull(), split
    if passages:
        found = removed_passages(docs, pairs, n, percent).groupBy("doc_id").agg(F.collect_list(F.struct("para_no", "start", "n_words")).alias(spans))
        out = out.join(written(found, "spans"), "doc_id", "left")
        whole = F.col("text").isNull() | (F.col(gone).isNull() & F.col(spans).isNull())

        def left(line, i):
            here = F.filter(F.coalesce(F.col(spans), F.array().cast("array<struct<para_no: int, start: int, n_words: int>>")), lambda x: x["para_no"] == i)
            words = F.regexp_extract_all(line, F.lit("([^ \\t-\\r]+)"), F.lit(1))
            rest = F.filter(words, lambda w, k: ~F.exists(here, lambda x: (x["start"] <= k) & (k < x["start"] + x["n_words"])))
            return F.when(F.size(here) == 0, line).otherwise(F.array_join(rest, " "))

        own = F.transform(split, left)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce(F.col(gone), F.array().cast("array<int>"))), lambda i: F.get(own, i))
    return out.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n"))).drop(gone, spans)
