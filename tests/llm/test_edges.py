"""Edge cases of each operator: repeated rows and ids, very long texts, clashing columns, empty tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from tablewright.llm import langid, minhash, paragraphs, resampling, substrings, vectors

from .test_small import LOW, WORD, Groups, corpus, shingle_set


def test_language_of_no_letters_and_long_texts(frame):
    r = random.Random(8)
    letters = {"en": "thewando", "de": "schueing"}
    docs = [(i, " ".join("".join(r.choices(letters[k], k=5)) for _ in range(30)), k) for i in range(200) for k in [list(letters)[i % 2]]]
    docs += [(900, "² ½ Ⅷ 12", "en"), (901, "scheng " * 200_000, None), (902, "_", None), (1, docs[1][1], "de"), (1, docs[0][1], "en"), (None, docs[3][1], None)]
    df = frame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score", "true as held_out")
    rows = langid.predicted(df).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r.lang_pred for r in rows if r.doc_id != 1}
    assert (got[900], got[901], got[902], got[None]) == ("und", "de", "und", "de")
    assert sorted(r.lang_pred for r in rows if r.doc_id == 1) == ["de", "de", "en"]
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    model = langid.fit(df)
    out = langid.identified(df, model)
    assert sorted(out.columns) == sorted(df.columns) and out.where("score > 1 or score < 0").count() == 0


def gram_weights(docs, good, buckets):
    """log_weight of each text, computed gram by gram in plain Python."""

    def own(text):
        w = WORD.findall((text or "").translate(LOW))
        return [(x,) for x in w] + list(zip(w, w[1:]))

    bucket = {}

    def count(texts):
        total = Counter()
        for t in texts:
            total.update(own(t))
        return total

    raw, target = count(t for _, t in docs), count(t for d, t in docs if d in good)
    p = lambda c, k: (c[k] + 1) / (sum(c.values()) + buckets)
    for k in raw:
        bucket[k] = math.log(p(target, k)) - math.log(p(raw, k))
    return [sum(bucket[k] for k in own(t)) for _, t in docs]


def test_resampling_weights(spark, frame):
    """With so many buckets that none is shared, weights are those of the plain n-gram models."""
    r = random.Random(3)
    docs = [(i, " ".join(r.choices(["Ab", "cd", "ef", "gh", "ij!"], k=r.randint(1, 12)))) for i in range(60)] + [(70, "word " * 30_000), (71, None), (72, ""), (5, "cd cd")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)] + [(5, 1), (999, 1)], "doc_id long, quality int")
    good = {i for i in range(0, 60, 3) if i % 2} | {5}
    buckets = 1 << 20
    rows = resampling.resampled(frame(docs), labels, share=0.5, buckets=buckets).collect()
    want = gram_weights(docs, good, buckets)
    assert len(rows) == len(docs)
    by = {}
    for (d, t), w in zip(docs, want):
        by.setdefault(d, []).append(None if not WORD.search(t or "") else w)
    for d in by:
        got = sorted((x.log_weight for x in rows if x.doc_id == d), key=lambda v: (v is None, v))
        for g, w in zip(got, sorted(by[d], key=lambda v: (v is None, v))):
            assert (g is None) == (w is None) and (g is None or abs(g - w) < 1e-6 * max(1, abs(w)))
    kept = [x.sampling_key for x in rows if x.kept]
    assert len(kept) == round(0.5 * 62) and min(kept) > max(x.sampling_key for x in rows if not x.kept and x.sampling_key is not None)
    noise = {x.doc_id: x.sampling_key - x.log_weight for x in rows if x.log_weight is not None and x.doc_id != 5}
    assert len({round(v, 9) for v in noise.values()}) == len(noise) and -1 < np.mean(list(noise.values())) < 2
    nulls = resampling.resampled(frame([(None, f"w{i}") for i in range(9)]), labels).collect()
    assert len({x.sampling_key for x in nulls}) == 9


def test_resampling_bounded_labels(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(5000)] + [(3, 1)], "doc_id long, quality int")
    assert resampling.good_ids(labels).count() == 5000
    some = resampling.good_ids(labels, 1000).count()
    assert 800 < some < 1200 and some == resampling.good_ids(labels, 1000).count()


def test_near_duplicates_of_repeated_ids(frame):
    """Rows that repeat a doc_id with other texts are judged one by one, the same way each time."""
    same, other = "a b c d e f g h", "q r s t u v w x"
    docs = [(1, same), (1, other), (2, same), (3, other), (3, other), (4, "l " * 30_000), (5, None), (None, same)]
    for _ in range(2):
        rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(docs), 2).collect()), key=str)
        assert rows == sorted([(1, 7, 1, True), (1, 7, 1, True), (2, 7, 1, False), (3, 7, 1, False), (3, 7, 1, False), (4, 1, 4, True), (5, 0, 5, True), (None, 7, None, False)], key=str)


def test_paragraphs_of_any_length(frame):
    docs = corpus(11, n=40) + [(900, "w " * 40_000 + "\nend of it"), (901, "End of it\n\n"), (902, "end of\nit")]
    own = [(d, i, shingle_set(x, 5)) for d, t in docs for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    g = Groups(range(len(own)))
    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            x, y = own[a][2], own[b][2]
            if 100 * len(x & y) >= 80 * len(x | y):
                g.join(a, b)
    gone = sorted((own[k][0], own[k][1], own[g.root(k)][0]) for k in range(len(own)) if g.root(k) != k)
    df = frame(docs).selectExpr("*", "'x' as _gone", "'y' as place")
    assert sorted((r.doc_id, r.para_no, r.first_doc_id) for r in paragraphs.removed_paragraphs(df).collect()) == gone
    out = paragraphs.dedup(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    drop = {(d, i) for d, i, _ in gone}
    assert texts == {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in drop) for d, t in docs}
    assert [paragraphs.bands_for(p) for p in (80, 90)] == [10, 6]


def removed_bytes(docs):
    """(doc_id, removed, digest) of every row, by brute force over all 50-byte strings."""
    first, raw = {}, [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - 49 if d is not None else 0):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out.append((d, sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_substrings_of_repeated_ids(frame):
    r = random.Random(4)
    word = lambda n: "".join(r.choices("abcdé ", k=n))
    one, two, three = word(80), word(90), word(49)
    docs = [(1, one), (1, word(30) + two), (1, three), (2, one + two), (2, two), (3, two + word(60)), (3, two + word(60)), (3, None), (4, three + word(10)), (4, three + one), (5, one), (5, one), (None, one), (6, "x" * 3000), (7, "x" * 70)]
    got = sorted(((x.doc_id, x.n_removed, x.kept_sha256) for x in substrings.dedup(frame(docs)).collect()), key=str)
    assert got == removed_bytes(docs)


def test_vectors_of_repeated_ids(spark):
    x, y, z = [1.0, 0.0], [0.0, 1.0], [0.99, 0.01]
    rows = [(1, x, 5), (1, y, 5), (1, x, 6), (2, z, 5), (2, z, 5), (3, y, 5), (4, x, 6), (5, None, 5), (None, x, 5), (6, [0.0, 0.0], 5), (7, x, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as row", "2 as first", "'k' as k1")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()), key=str)
    want = [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False)]
    want += [(5, 0, 5, True), (None, 0, None, False), (6, 0, 6, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)
