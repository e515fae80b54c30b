"""Hierarchical language identification by linear support vector machines.

A first classifier tells the language family (one machine against the rest for each family), then
one-versus-one machines tell the languages within it. Features are hashed counts of 1 to 4-byte
grams of the whole lower-cased text, with everything but letters as spaces.
The machines are fitted on a bounded sample of the labelled rows: about ``per_language`` documents of each
language, picked by a hash of doc_id among those whose crc32(doc_id as text) mod 4 is not 2. Only the features of the
sample come to the driver, FIT_ROWS rows of DIM at most about, and lie there once, in single precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import blocks
from tablewright.llm.text import flat

DIM = 1 << 12
PER_LANGUAGE = 500
#: Rows of the sample in all, about: with many languages each has fewer than PER_LANGUAGE.
FIT_ROWS = 4000
#: Rows whose counts are held at a time.
ROWS = 256
UNKNOWN = "und"

#: ISO 639-1 codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indo-aryan": "hi ur bn pa gu mr ne sa",
    "iranian": "fa ku ps tg",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x61:0x7B] = _LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def features(col: pa.Array) -> np.ndarray:
    """A unit row of square-rooted gram counts for each text; texts without a gram are zero."""
    raw, bounds = flat(col)
    out = np.zeros((len(col), DIM))
    if not len(raw):
        return out
    raw = _LETTERS[raw]
    latin = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
    raw[1:][latin] += 0x20  # capital letters of Latin-1
    row = np.repeat(np.arange(len(col), dtype=np.int64), np.diff(bounds)) * DIM
    code = np.zeros(len(raw), dtype=np.uint32)
    counts = np.zeros(len(col) * DIM, dtype=np.int64)
    for n in range(1, 5):
        code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] if n > 1 else raw.astype(np.uint32)
        if not len(code):
            break
        own = row[: len(code)] == row[n - 1 :]
        at = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)).astype(np.int64) + row[: len(code)]
        counts += np.bincount(at[own], minlength=len(counts))
    out = np.sqrt(counts.reshape(len(col), DIM))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 120) -> np.ndarray:
    """A linear support vector machine (squared hinge, y in -1, 1) by accelerated gradient steps; the bias is last."""
    weight = np.where(y > 0, cost / (2 * max(1, (y > 0).sum())), cost / (2 * max(1, (y < 0).sum())))
    step = 1 / (1 + 4 * weight.sum())
    w = ahead = np.zeros(x.shape[1] + 1)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1].astype(np.float32) + ahead[-1]))
        pull = 2 * weight * slack * y
        new = ahead - step * (ahead - np.append(pull.astype(np.float32) @ x, pull.sum()))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class Model:
    """Families with their languages, a machine for each family and for each pair of its languages."""

    families: tuple[tuple[str, tuple[str, ...]], ...]
    weights: np.ndarray
    pairs: tuple[tuple[int, int, int], ...]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1, the smaller of both decisions' confidences."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1) if n > 1 else np.zeros(len(x), dtype=np.int64)
        score = sure(margins[np.arange(len(x)), family]) if n > 1 else np.ones(len(x))
        lang = np.empty(len(x), dtype=object)
        for f, (_, codes) in enumerate(self.families):
            at = np.flatnonzero(family == f)
            votes, total, least = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes))), np.full((len(at), len(codes)), np.inf)
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = margins[at, n + k]
                    votes[:, a] += m > 0
                    votes[:, b] += m <= 0
                    for c, own in ((a, m), (b, -m)):
                        total[:, c] += own
                        least[:, c] = np.minimum(least[:, c], own)
            best = (votes + 1e-6 * np.tanh(total)).argmax(axis=1)
            lang[at] = np.array(codes, dtype=object)[best]
            if len(codes) > 1:
                score[at] = np.minimum(score[at], sure(least[np.arange(len(at)), best]))
        return lang.tolist(), score


def held_out():
    """Rows that are never learnt from: crc32 of doc_id as text leaves 2 modulo 4. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, fit_rows: int = FIT_ROWS) -> Model:
    """The hierarchy from text and lang of labelled rows that are not held out."""
    known = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.trim("lang") != "")).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model((), np.zeros((0, DIM + 1)), ())
    span, most = 1 << 30, min(per_language, max(1, fit_rows // len(counts)))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(span))
    share = F.coalesce(*[F.when(F.col("lang") == k, int(span * min(1.0, most / n))) for k, n in sorted(counts.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            for s in range(0, block.num_rows, ROWS):
                part = block.slice(s, ROWS)
                x = features(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    found = known.where(place < share).select("lang", "text").mapInArrow(run, "lang string, x binary")
    rows = sorted((r.lang, bytes(r.x)) for r in found.toLocalIterator())
    langs = np.array([r[0] for r in rows], dtype=str)
    x = np.empty((len(rows), DIM), dtype=np.float32)
    for i in range(len(rows) - 1, -1, -1):
        x[i] = np.frombuffer(rows.pop()[1], dtype=np.float16)
    grouped: dict[str, list[str]] = {}
    for code in sorted(set(langs.tolist())):
        grouped.setdefault(FAMILY_OF.get(code, code), []).append(code)
    families = tuple((f, tuple(c)) for f, c in sorted(grouped.items()))
    first = {c: (np.searchsorted(langs, c), np.searchsorted(langs, c, "right")) for _, codes in families for c in codes}  # rows are in order of their language
    weights, pairs = [], []
    for _, codes in families:
        y = np.where(np.isin(langs, codes), 1.0, -1.0)
        weights.append(fit_machine(x, y) if len(families) > 1 else np.zeros(DIM + 1))
    for f, (_, codes) in enumerate(families):
        for a, b in itertools.combinations(range(len(codes)), 2):
            (s, e), (u, v) = first[codes[a]], first[codes[b]]
            both = x[s:v] if e == u else np.concatenate([x[s:e], x[u:v]])
            weights.append(fit_machine(both, np.repeat([1.0, -1.0], [e - s, v - u])))
            pairs.append((f, a, b))
    return Model(families, np.stack(weights) if weights else np.zeros((0, DIM + 1)), tuple(pairs))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score. A null text, or one without a letter (str.isalpha), is ``und`` with score 0.

    Columns of docs with these two names are replaced; all others stay. Texts are read whole, in blocks of rows of about 1 MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            for s in range(0, block.num_rows, ROWS):
                part = block.slice(s, ROWS)
                lang, score = shared.value.predict(features(part.column("text")))
                for i, text in enumerate(part.column("text").to_pylist()):
                    if text is None or not any(map(str.isalpha, text)):
                        lang[i], score[i] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*plain).schema.fields)
    return docs.select(*plain).mapInArrow(run, f"{schema}, lang_pred string, score double")


def predicted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document (doc_id, text, lang; other columns are ignored).

    lang serves for learning only. Without any labelled row every document is ``und``; an empty table gives an empty result.
    Rows that repeat a doc_id are predicted one by one. A null doc_id is not held out.
    """
    model = fit(docs, per_language)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
