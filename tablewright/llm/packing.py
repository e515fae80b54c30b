"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Each document goes where the squared counts of open bins per residual gap become smallest, longest
documents first; a new bin opens only when the document fits in none. The sizes alone decide, so
the instance is a histogram of at most ``capacity`` counters whatever the corpus: it is summed on
the executors and packed on the driver in patterns. With more than ``base`` documents every
pattern document stands for q documents of its length and the pattern is repeated q times; the
remainder of each length (fewer than q) is packed in bins of its own. Documents learn their place
by a join on (length, rank among that length); ranks are counted in salted groups.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import blocks, written

CAPACITY = 4096
END = 1
#: Documents that the packed pattern has at most, besides remainders.
BASE = 100_000
#: Words that a worker remembers in each of two generations.
REMEMBERED = 150_000
#: Rows of one salted group when ranks are counted.
GROUP = 20_000

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts that are not taken word by word: literal special tokens, and separators that only Python has.
_WHOLE = re.compile(r"<\||[\x1c-\x1f]")
#: Words of these characters need no more than lower case: they are composed, and each lowers alone.
_PLAIN = re.compile(r"[\x00-ɏ]+")
#: Marks that are a part of their own behind letters.
_STOPS = frozenset(".,;:!?")


class _Recent:
    """Two generations of a bounded cache: what is asked for again survives."""

    def __init__(self, most: int):
        self.new, self.old, self.most = {}, {}, most

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, the same as encoding each text at once.

    The file's pre-tokeniser never joins across white space, so ids of a text are those of its
    words one after another; words and their parts are remembered.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        self.model = self.all.model
        self.find = regex.compile(_SPLIT).findall
        self.bytes = dict(enumerate(_byte_letters()))
        self.words, self.parts = _Recent(remembered), _Recent(remembered)

    def whole(self, text: str) -> bytes:
        return array("I", self.all.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            letters = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.bytes)
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            self.parts.put(part, found)
        return found

    def word(self, word: str) -> bytes:
        found = self.words.old.get(word)
        if found is None:
            if word.isascii() or _PLAIN.fullmatch(word):
                low = word.lower()
                if low.isalpha():
                    found = self.part(low)
                elif low[-1] in _STOPS and low[:-1].isalpha():
                    found = self.part(low[:-1]) + self.part(low[-1])
                else:
                    found = b"".join(map(self.part, self.find(low)))
            else:
                found = self.whole(word)
        self.words.put(word, found)
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _WHOLE.search(text):
            return self.whole(text)
        words, known = text.split(), self.words.new.get
        found = list(map(known, words))
        if None in found:
            found = [(known(w) or self.word(w)) if x is None else x for w, x in zip(words, found)]  # a word may come twice
        return b"".join(found)


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies have for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by ``end``; only longer ones are cut."""
    last = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for block in blocks(batches, "text", 4 << 20):
            out = []
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                ids = own.ids(text) + last
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[i : i + 4 * capacity]
                    out.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pack counts[length] documents of each length: [(length, slot, bin, offset)] and the number of bins."""
    gaps = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, bins = [], 0
    for length in sorted(counts, reverse=True):
        for slot in range(counts[length]):
            here = gaps[length:]
            change = 2 * (gaps[: capacity + 1 - length] - here) + 2
            change[0] = 1 - 2 * here[0]  # a bin that it closes
            left = int(np.where(here > 0, change, np.iinfo(np.int64).max).argmin())
            gap = length + left
            if here[left]:
                at = open_bins[gap].pop()
                gaps[gap] -= 1
            else:
                gap, at, left = capacity, bins, capacity - length
                bins += 1
            if left:
                gaps[left] += 1
                open_bins[left].append(at)
            placed.append((length, slot, at, capacity - gap))
    return placed, bins


def pack(items: DataFrame, capacity: int = CAPACITY, base: int = BASE) -> DataFrame:
    """items (doc_id, piece, length, ...) with sequence_id and offset. Offsets in a sequence are gapless from 0.

    Every length must be from 1 to capacity. An empty table gives an empty table; rows that are
    equal in every column are documents of their own.
    """
    spark = items.sparkSession
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(counts.values())
    q = max(1, -(-total // base))
    pattern, bins = sum_of_squares({k: n // q for k, n in counts.items() if n >= q}, capacity)
    rest, more = sum_of_squares({k: n % q for k, n in counts.items() if n % q}, capacity)
    slots = np.array([(*x, 0) for x in pattern] + [(*x, 1) for x in rest], dtype=np.int64).reshape(-1, 5)
    places = spark.createDataFrame(pa.table({k: slots[:, i] for i, k in enumerate(("length", "slot", "bin", "offset", "rest"))}))
    # rank among the documents of a length: salted groups of bounded size, and the rows in the groups before
    salts = max(1, -(-max(counts.values(), default=0) // GROUP)) * 16
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    of_length = Window.partitionBy("length")
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length",
        "salt",
        F.coalesce(F.sum("n").over(of_length.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.floor(F.sum("n").over(of_length) / q).alias("whole"),
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(order) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("own") + F.col("before"))
    )
    ranked = ranked.withColumn("rest", (F.col("rank") >= F.col("whole") * q).cast("long"))
    ranked = ranked.withColumn(
        "slot", F.when(F.col("rest") == 1, F.col("rank") - F.col("whole") * q).otherwise(F.expr(f"rank div {q}"))
    ).withColumn("copy", F.col("rank") % q)
    joined = ranked.join(places, ["length", "slot", "rest"])
    at = F.when(F.col("rest") == 1, F.col("bin") + bins * q).otherwise(F.col("bin") * q + F.col("copy"))
    return joined.select(*items.columns, at.alias("sequence_id"), "offset")


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, base: int = BASE) -> DataFrame:
    """All documents (doc_id, text; other columns are ignored) in sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the end id alone. tokenizer: path of the vocabulary file, as every executor sees it.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end), "pieces"), capacity, base)
