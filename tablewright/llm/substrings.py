"""Exact substring dedup by a hash-compared suffix sort.

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Sorting every suffix of a corpus is out of reach, so three steps narrow the sort down without
losing a string:

1. Windows of LENGTH bytes are grouped in the document by the smallest hash among their GRAM-byte
   grams (the anchor): equal strings have equal anchors, and consecutive windows share one, some 16
   on average. Such a run is a record of two 48-bit hashes: of the anchor, and of all bytes that its windows cover.
2. Records meet by anchor. Anchors of one document end here. Records with equal covered bytes are
   settled: all windows of all but the smallest document's go. Task by task the same is done before the
   shuffle, so what thousands of copies share is sent once. Only where an anchor stands in unlike
   surroundings the covered bytes of one record of each kind are fetched.
3. Their suffixes are sorted, in buckets of equal anchor and first BUCKET bytes, by mergesort. A
   comparison finds the common extension of two suffixes by binary search on prefix polynomial hashes; neighbours
   that agree in LENGTH bytes by hash are verified byte by byte and form one string.

A request for bytes of an anchor with more than HOT surroundings is dealt out by whole strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import blocks, partitions, written
from tablewright.llm.text import flat, mix, powers, prefix_hash, span_hash, INVERSE

LENGTH = 50
GRAM = 20
BUCKET = 16
#: Records that a task gathers before it sends them.
FLUSH = 1 << 20
#: Windows of a run; periodic text has one anchor for thousands, in several runs then.
LONGEST = 128
#: Suffixes sorted at a time (or one anchor's).
SORTED = 1 << 18
HOT = 2048
_ROUTES = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def window_anchors(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash of every window start of a block of texts, and which starts have a whole window in their text."""
    n = len(h) - 1
    wide = LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n - GRAM + 1)
    low = mix(span_hash(h, at, at + GRAM))
    have = 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < wide:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    starts = np.arange(n - LENGTH + 1)
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(starts)]
    return low, starts + LENGTH <= end


def runs_of(raw: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> dict[str, np.ndarray]:
    """anchor, cover, doc, start, size of every run of windows with one anchor; start counts in its text."""
    h = prefix_hash(raw)
    low, whole = window_anchors(h, bounds)
    at = np.flatnonzero(whole)
    if not len(at):
        return {"anchor": np.zeros(0, np.uint64), "cover": np.zeros(0, np.uint64), "doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "size": np.zeros(0, np.int64)}
    row = np.searchsorted(bounds, at, side="right") - 1
    first = np.ones(len(at), dtype=bool)
    first[1:] = (low[at[1:]] != low[at[:-1]]) | (row[1:] != row[:-1])
    place = np.arange(len(at))
    begin = np.flatnonzero(first | ((place - np.maximum.accumulate(np.where(first, place, 0))) % LONGEST == 0))
    size = np.diff(np.append(begin, len(at)))
    start, row = at[begin], row[begin]
    cover = mix(span_hash(h, start, start + size - 1 + LENGTH) + size.astype(np.uint64))
    return {"anchor": low[start], "cover": cover, "doc": docs[row], "start": start - bounds[row], "size": size}


def _settle(anchor: np.ndarray, cover: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor, cover and doc, and which rows in it have an equal record in a smaller document."""
    order = np.lexsort((doc, cover, anchor))
    a, c, d = anchor[order], cover[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order, d > least


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _spans(doc, start, size, anchor=None, hot=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
            pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)), pa.array(np.zeros(n, bool) if hot is None else hot),
        ],
        ["route", "packed", "doc", "start", "size", "anchor", "hot"],
    )


_RECORDS = "route int, packed binary, doc long, start long, size long, anchor long, hot boolean"


def _records(docs: DataFrame) -> DataFrame:
    """Step 1: packed records by route, and the spans that are settled within a task."""

    def flush(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        r = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order, gone = _settle(r["anchor"], r["cover"], r["doc"])
        yield _spans(*(r[k][order[gone]] for k in ("doc", "start", "size")))
        left = order[~gone]
        route = (r["anchor"][left] & np.uint64(routes - 1)).astype(np.int64)
        left = left[np.lexsort((r["start"][left], r["doc"][left], route))]
        route = (r["anchor"][left] & np.uint64(routes - 1)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(route[1:] != route[:-1]) + 1).tolist(), len(left)] if len(left) else []
        packed, names = [], []
        for s, e in zip(cuts, cuts[1:]):
            own = left[s:e]
            start = r["start"][own].astype("<u4").view("<u2").reshape(-1, 2)
            packed.append(b"".join((np.array([len(own)], "<i8").tobytes(), _six(r["anchor"][own]), _six(r["cover"][own]), r["doc"][own].astype("<i8").tobytes(), start[:, 0].tobytes(), start[:, 1].tobytes(), r["size"][own].astype(np.uint8).tobytes())))
            names.append(int(route[s]))
        for s in range(0, len(names), 64):
            n = len(names[s : s + 64])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[s : s + 64], pa.int32()), pa.array(packed[s : s + 64], pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.array([False] * n)],
                ["route", "packed", "doc", "start", "size", "anchor", "hot"],
            )

    routes = _ROUTES
    while routes > 2 * partitions(docs.sparkSession):
        routes //= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for block in blocks(batches, "text"):
            raw, bounds = flat(block.column("text"))
            parts.append(runs_of(raw, bounds, block.column("doc_id").to_numpy()))
            n += len(parts[-1]["doc"])
            if n >= FLUSH:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return docs.mapInArrow(run, _RECORDS)


def _meet(records: DataFrame) -> DataFrame:
    """Step 2: spans (anchor null) and requests for bytes (anchor not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            spans = batch.filter(pc.is_null(batch.column("packed")))
            if spans.num_rows:
                yield spans
            for data in batch.column("packed").drop_null():
                data = data.as_buffer().to_pybytes()
                n = int(np.frombuffer(data[:8], "<i8")[0])
                cut = np.cumsum([8, 6 * n, 6 * n, 8 * n, 2 * n, 2 * n, n])
                a, c, d, lo, hi, z = (data[s:e] for s, e in zip(cut, cut[1:]))
                start = np.frombuffer(lo, "<u2").astype(np.int64) + (np.frombuffer(hi, "<u2").astype(np.int64) << 16)
                for k, x in enumerate((_from_six(a), _from_six(c), np.frombuffer(d, "<i8"), start, np.frombuffer(z, np.uint8).astype(np.int64))):
                    got[k].append(x)
        if not got[0]:
            return
        anchor, cover, doc, start, size = (np.concatenate(x) for x in got)
        del got
        order, gone = _settle(anchor, cover, doc)
        settled = order[gone]
        for s in range(0, len(settled), 100_000):
            yield _spans(*(x[settled[s : s + 100_000]] for x in (doc, start, size)))
        left = order[~gone]
        a, d = anchor[left], doc[left]
        if not len(left):
            return
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        count = np.diff(np.append(first, len(a)))
        keep = np.repeat(many, count)
        hot = np.repeat(count > HOT, count)[keep]
        left = left[keep]
        for s in range(0, len(left), 100_000):
            own = left[s : s + 100_000]
            yield _spans(doc[own], start[own], size[own], anchor[own], hot[s : s + 100_000])

    dealt = records.withColumn("deal", F.coalesce("route", F.pmod(F.hash("doc", "start"), F.lit(_ROUTES))))
    return dealt.repartition(partitions(records.sparkSession), "deal").drop("deal").mapInArrow(run, _RECORDS).select("doc", "start", "size", "anchor", "hot")


def _extension(h: np.ndarray, inverse: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes, up to LENGTH, in which the suffixes at x and y agree, by binary search on prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
    hx, hy, ix, iy = h[x], h[y], inverse[x], inverse[y]
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (h[x + mid] - hx) * ix == (h[y + mid] - hy) * iy
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(raw: np.ndarray, h: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """An order of the suffixes ``at`` by their first LENGTH bytes within each run of equal ``group``, by mergesort."""
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    inverse = powers(INVERSE, len(h))
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    count = np.diff(np.append(edge, n))
    start, stop = np.repeat(edge, count), np.repeat(edge + count, count)
    width = 1
    while width < count.max():
        i = np.flatnonzero(stop - start > width)
        local = i - start[i]
        run = local // width
        other = np.minimum(start[i] + (run ^ 1) * width, stop[i])
        lo, hi, right = other.copy(), np.minimum(other + width, stop[i]), run % 2 == 1
        mine = at[order[i]]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            x, y = mine[todo], at[order[mid]]
            same = _extension(h, inverse, x, y)
            equal = same == LENGTH
            step = np.where(equal, 0, same)
            before = np.where(equal, right[todo], raw[y + step] < raw[x + step])
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        place = start[i] + (run // 2) * 2 * width + (local - run * width) + (lo - other)
        merged = order.copy()
        merged[place] = order[i]
        order, width = merged, width * 2
    return order


def repeated(raw: np.ndarray, at: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the strings of LENGTH bytes at ``at`` also start, under the same anchor, in a smaller doc."""
    h = prefix_hash(raw)
    head = mix(span_hash(h, at, at + BUCKET) ^ mix(anchor))
    by = np.lexsort((doc, head))
    at, head, doc = at[by], head[by], doc[by]
    order = suffix_sort(raw, h, at, head)
    x, g = at[order], head[order]
    same = np.zeros(len(x), dtype=bool)
    close = np.flatnonzero(g[1:] == g[:-1])
    close = close[_extension(h, powers(INVERSE, len(h)), x[close], x[close + 1]) == LENGTH]
    for s in range(0, len(close), 1 << 16):  # verified byte by byte
        own = close[s : s + (1 << 16)]
        steps = np.arange(LENGTH)
        same[own + 1] = (raw[x[own][:, None] + steps] == raw[x[own + 1][:, None] + steps]).all(axis=1)
    string = np.cumsum(~same) - 1
    least = np.full(string[-1] + 1 if len(string) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, string, doc[order])
    out = np.zeros(len(at), dtype=bool)
    out[by[order]] = doc[order] > least[string]
    return out


def _resolved(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Step 3: spans (doc, start, size) of the requested runs' windows that repeat a smaller document's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            out = []
            for doc, text, asked in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "asked"))):
                raw = text if isinstance(text, bytes) else text.encode()
                for r in asked:
                    s, n = r["start"], r["size"]
                    if not r["hot"]:
                        out.append((r["anchor"], doc, s, raw[s : s + n - 1 + LENGTH]))
                        continue
                    for i in range(s, s + n):  # each string by itself, wherever its anchor stands
                        own = raw[i : i + LENGTH]
                        out.append((int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True), doc, i, own))
                if len(out) > 50_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "doc", "start", "covered"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            raw_size = pc.sum(pc.binary_length(rest.column("covered"))).as_py() or 0
            if raw_size < SORTED:
                continue
            anchor = rest.column("anchor").to_numpy()
            edge = np.flatnonzero(anchor[1:] != anchor[:-1])
            if len(edge):
                yield from ordered(rest.slice(0, edge[-1] + 1))
                rest = rest.slice(edge[-1] + 1)
        if rest is not None and rest.num_rows:
            yield from ordered(rest)

    def ordered(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole anchors in slices of about SORTED bytes."""
        sizes = np.cumsum(pc.binary_length(whole.column("covered")).to_numpy())
        anchor = whole.column("anchor").to_numpy()
        last = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]), len(anchor) - 1)
        s = 0
        while s < len(anchor):
            e = last[min(np.searchsorted(sizes[last], (sizes[s - 1] if s else 0) + SORTED), len(last) - 1)] + 1
            part = whole.slice(s, e - s)
            raw, bounds = flat(part.column("covered"))
            n = np.diff(bounds) - LENGTH + 1
            row = np.repeat(np.arange(part.num_rows), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            doc = part.column("doc").to_numpy()[row]
            hit = np.flatnonzero(repeated(raw, bounds[:-1][row] + step, part.column("anchor").to_numpy()[row].view(np.uint64), doc))
            if len(hit):
                start = part.column("start").to_numpy()[row[hit]] + step[hit]
                new = np.flatnonzero(np.append(True, (row[hit][1:] != row[hit][:-1]) | (start[1:] != start[:-1] + 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[hit][new]), pa.array(start[new]), pa.array(np.diff(np.append(new, len(hit))))], ["doc", "start", "size"]
                )
            s = e

    asked = requests.groupBy("doc").agg(F.collect_list(F.struct("start", "size", "anchor", "hot")).alias("asked"))
    texts = docs.join(asked.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "asked")
    covered = texts.mapInArrow(cut, "anchor long, doc long, start long, covered binary")
    dealt = covered.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(sort, "doc long, start long, size long")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, size): starts of repeated strings, in runs, for every document that has any."""
    texts = docs.where("doc_id is not null and octet_length(text) >= %d" % LENGTH).select("doc_id", "text")
    met = written(_meet(_records(texts)), "met")
    found = met.where("anchor is null").select("doc", "start", "size").union(_resolved(met.where("anchor is not null"), texts))
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary, what is left) of every document.

    docs: doc_id, text; other columns are ignored. A null text is empty; texts under LENGTH bytes lose
    nothing. A null doc_id loses nothing and is nobody's smaller document. Rows that repeat a doc_id, with equal texts or
    others, are judged one by one, and none is the other's smaller document. What is left may not be valid UTF-8: cuts fall between any two bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            raw, bounds = flat(block.column("text"))
            out = []
            for i, spans in enumerate(block.column("spans")):
                own = raw[bounds[i] : bounds[i + 1]]
                if not spans.is_valid:
                    out.append((len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest(), own.tobytes()))
                    continue
                start, size = (spans.values.field(k).to_numpy() for k in (0, 1))
                change = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + size - 1 + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                left = own[~gone].tobytes()
                out.append((len(own), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    rows = docs.select("doc_id", "text")
    unlike = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("lo != hi").select("doc_id"), "unlike")
    joined = rows.join(removals(docs), "doc_id", "left").select("doc_id", "text", "spans") if unlike.isEmpty() else _of_repeated_ids(rows, unlike)
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _of_repeated_ids(rows: DataFrame, unlike: DataFrame) -> DataFrame:
    """doc_id, text, spans of rows of which some repeat a doc_id with another text (those of ``unlike``).

    The texts of one id are put end to end with a byte between them that no UTF-8 text has, so that none is the other's smaller document;
    windows over that byte are taken out of the spans again.
    """
    pieces = rows.join(unlike, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.coalesce("text", F.lit("")))).alias("_pieces"))
    pieces = written(pieces, "pieces")
    ends = pieces.select("doc_id", F.expr("aggregate(_pieces, X'', (a, x) -> concat(a, cast(x as binary), X'FF'))").alias("text"))
    plain = rows.join(unlike, "doc_id", "left_anti")
    spans = written(removals(plain.select("doc_id", F.col("text").cast("binary").alias("text")).union(ends)), "spans")
    first = F.expr("aggregate(slice(_pieces, 1, cast(array_position(_pieces, coalesce(text, '')) as int) - 1), 0L, (a, x) -> a + octet_length(x) + 1)")
    parted = rows.join(pieces, "doc_id").withColumn("_first", first).join(spans, "doc_id", "left")
    last = f"_first + octet_length(coalesce(text, '')) - {LENGTH}"
    inside = F.expr(f"filter(transform(spans, x -> struct(greatest(x.start, _first) as start, least(x.start + x.size - 1, {last}) as size)), x -> x.start <= x.size)")
    moved = parted.withColumn("spans", inside).withColumn("spans", F.expr("transform(spans, x -> struct(x.start - _first as start, x.size - x.start + 1 as size))"))
    own = moved.select("doc_id", "text", F.when(F.size("spans") > 0, F.col("spans")).alias("spans"))
    return plain.join(spans, "doc_id", "left").select("doc_id", "text", "spans").union(own)
