"""Quality by importance resampling: two hashed n-gram models, Gumbel top-k.

Words and word pairs of whole texts fall into ``buckets`` counters, over all texts (raw) and over
those labelled good (target). A document's weight is the sum over its n-grams of the logarithm of
target to raw probability; the k documents with the largest weight plus Gumbel noise are a sample
without replacement in proportion to exp(weight). Noise comes from a hash of doc_id, the text and the seed.

The raw model counts every text. The target model is fitted on a bounded sample of the good labels, about ``fit_rows`` ids
picked by a hash of doc_id: they are broadcast, so that no text is shuffled to meet its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import blocks, written
from tablewright.llm.text import mix, word_hashes

BUCKETS = 10_000
#: Pseudo-counts of every bucket.
SMOOTHING = 1.0
#: Share of the documents that have a word which the sample has.
SHARE = 0.85
SEED = 6
#: Good labels that the target model is fitted on, about; all of them where there are fewer.
FIT_ROWS = 100_000
#: Keys left when the search for the k-th largest ends in one sorted list.
LAST = 4096


def grams(col: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a text column, and the row of each."""
    hashes, rows = word_hashes(col)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pair = row[:-1] == row[1:] if len(row) else np.zeros(0, dtype=bool)
    both = mix(mix(hashes[:-1]) + hashes[1:])[pair] if len(row) else hashes
    at = np.concatenate([hashes, both]) % np.uint64(buckets)
    return at.astype(np.int64), np.concatenate([row, row[:-1][pair] if len(row) else row])


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all texts and over those whose column ``good`` is true; ``buckets`` counters each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), dtype=np.int64)
        for block in blocks(batches, "text"):
            at, row = grams(block.column("text"), buckets)
            total[0] += np.bincount(at, minlength=buckets)
            good = block.column("good").to_numpy(zero_copy_only=False).astype(bool)
            total[1] += np.bincount(at[good[row]], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], ["bucket", "raw", "good"])

    counted = docs.select("text", "good").mapInArrow(run, "bucket long, raw long, good long")
    out = np.zeros((2, buckets), dtype=np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # buckets rows at most
        out[:, r.bucket] = r.raw, r.good
    return out[0], out[1]


def log_ratio(raw: np.ndarray, good: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Logarithm of target to raw probability for every bucket; zero where nothing is labelled."""
    p = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * len(c)))
    return p(good) - p(raw) if good.sum() else np.zeros(len(raw))


def scored(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight and sampling_key; both are null for a text without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            at, row = grams(block.column("text"), len(shared.value))
            n = np.bincount(row, minlength=block.num_rows)
            weight = np.bincount(row, weights=shared.value[at], minlength=block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("noise"), pa.array(n), pa.array(weight, mask=n == 0)], ["doc_id", "noise", "n_grams", "log_weight"])

    # a null doc_id is told from others by its text, and so are rows that repeat a doc_id with another text
    uniform = (F.pmod(F.xxhash64("doc_id", F.col("noise"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = docs.select("doc_id", "text", F.xxhash64("text").alias("noise"))
    weighed = noisy.mapInArrow(run, "doc_id long, noise long, n_grams long, log_weight double")
    return weighed.withColumn("sampling_key", F.col("log_weight") - F.log(-F.log(uniform))).drop("noise")


def kth_largest(df: DataFrame, column: str, k: int, last: int = LAST) -> float | None:
    """The k-th largest value by counting in 1,024 bins that narrow; no sort of all rows."""
    seen = df.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if k <= 0 or not seen.n:
        return None
    k, lo, hi, n = min(k, seen.n), seen.lo, seen.hi, seen.n
    value = F.col(column)
    while n > last and lo < hi:
        width = (hi - lo) / 1024
        inside = df.where(value.between(lo, hi)).select(value, F.least(F.floor((value - lo) / width), F.lit(1023)).alias("bin"))
        bins = {r.bin: r for r in inside.groupBy("bin").agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b].n:
                break
            k -= bins[b].n
        lo, hi, n = bins[b].lo, bins[b].hi, bins[b].n
    if lo == hi:
        return lo
    return sorted((r[0] for r in df.where(value.between(lo, hi)).select(value).collect()), reverse=True)[k - 1]


def good_ids(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id of the documents with a label of quality 1: all, or about ``fit_rows`` of them, picked by a hash of doc_id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    if n <= fit_rows:
        return good
    span = 1 << 30
    return good.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(span)) < int(span * fit_rows / n))


def resampled(docs: DataFrame, labels: DataFrame, share: float = SHARE, buckets: int = BUCKETS, seed: int = SEED, fit_rows: int = FIT_ROWS) -> DataFrame:
    """A sample of documents (doc_id, text) that resembles those labelled quality 1 (doc_id, quality).

    Returns doc_id, n_grams, log_weight, sampling_key, kept for every document. The sample has
    round(share * documents with a word); rows with the k-th key itself all stay. A document is good
    if any of its labels is 1. Texts without a word (null, empty, blank) have null weight and are not kept. Texts are read whole, however
    long. Without a good label every weight is 0. Rows that repeat a doc_id are judged one by one: equal texts share weight and noise,
    unlike ones do not; a null doc_id is never labelled. An empty table gives an empty result. Other columns are ignored.
    """
    good = F.broadcast(good_ids(labels, fit_rows).withColumn("good", F.lit(True)))  # fit_rows ids of 8 bytes, about
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratio = log_ratio(*gram_counts(marked, buckets))
    found = written(scored(docs, ratio, seed), "scored")
    k = round(share * found.where("n_grams > 0").count())
    least = kth_largest(found, "sampling_key", k)
    kept = F.coalesce(F.col("sampling_key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return found.withColumn("kept", kept)
