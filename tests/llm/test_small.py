"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from array import array

import numpy as np
import pytest

from tablewright.llm import common, decontaminate, langid, lines, minhash, packing, paragraphs, resampling, substrings, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n=60, words=40):
    """Texts with near copies, exact copies, shared passages, nulls and blanks."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgü", k=r.randint(2, 7))) for _ in range(200)]
    out, passage = [], " ".join(r.choices(vocabulary, k=30))
    for i in range(n):
        kind = r.random()
        if out and kind < 0.25:
            own = (out[r.randrange(len(out))] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append(" ".join(own))
        elif kind < 0.45:
            out.append(" ".join(r.choices(vocabulary, k=words // 2)) + "\n" + passage + "\n" + " ".join(r.choices(vocabulary, k=words // 2)))
        else:
            out.append("\n".join(" ".join(r.choices(vocabulary, k=r.randint(1, words))).capitalize() for _ in range(r.randint(1, 4))))
    out += [None, "", "   \n\t ", "One", "one", "x " * 5000, "the " * 400, "a", passage, passage]
    return list(enumerate(out))


class Groups:
    """Plain union-find with the smallest member as root."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    g = Groups({x for e in edges for x in e})
    for a, b in edges:
        g.join(a, b)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: g.root(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(frame, n):
    docs = corpus(n)
    sets = {d: shingle_set(t, n) for d, t in docs}
    g = Groups(sets)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            g.join(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(docs), n).collect()}
    assert got == {d: (len(s), g.root(d), g.root(d) == d) for d, s in sets.items()}
    null = minhash.near_duplicates(frame([(None, "a b c"), (1, "a b c"), (1, "a b c")])).collect()
    assert sorted(str(r.doc_id) for r in null) == ["1", "1", "None"] and not [r for r in null if r.doc_id is None and r.kept]
    assert minhash.near_duplicates(frame([])).count() == 0


def test_lines(frame):
    docs = corpus(3)
    first, own, sets = {}, [], {}
    for d, t in docs:
        for i, x in enumerate((t or "").split("\n")):
            x = x.strip(" ").lower()
            if x:
                own.append((d, i, x))
                first.setdefault(x, (d, i))
                sets[x] = frozenset([x]) if len(x) <= 5 else frozenset(x[k : k + 5] for k in range(len(x) - 4))
    g = Groups(range(len(first)))
    names = sorted(first, key=first.get)
    for a, b in itertools.combinations(range(len(names)), 2):
        x, y = sets[names[a]], sets[names[b]]
        if len(x & y) >= 0.8 * len(x | y):
            g.join(a, b)
    gone = sorted((d, i) for d, i, x in own if first[names[g.root(names.index(x))]] != (d, i))
    df = frame(docs)
    assert sorted((r.doc_id, r.line_no) for r in lines.removed_lines(df).collect()) == gone
    texts = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(df).collect()}
    for d, t in docs:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        assert texts[d] == (left, sum(x[0] == d for x in gone))
    assert lines.report(frame([])).count() == 0
    assert lines.report(frame([(None, "a\na"), (1, None)])).agg({"n_removed": "sum"}).first()[0] == 0


def test_paragraphs(frame):
    docs = corpus(4)
    own = [(d, i, shingle_set(x, 5)) for d, t in docs for i, x in enumerate((t or "").split("\n")) if len(WORD.findall(x)) >= 20]
    g = Groups(range(len(own)))
    for a, b in itertools.combinations(range(len(own)), 2):
        x, y = own[a][2], own[b][2]
        if 100 * len(x & y) >= 80 * len(x | y):
            g.join(a, b)
    gone = sorted((own[k][0], own[k][1], own[g.root(k)][0]) for k in range(len(own)) if g.root(k) != k)
    got = paragraphs.removed_paragraphs(frame(docs), least_words=20).collect()
    assert sorted((r.doc_id, r.para_no, r.first_doc_id) for r in got) == gone
    assert paragraphs.report(frame([])).count() == 0
    assert paragraphs.dedup(frame(docs)).count() == len(docs)


def test_substrings(frame):
    docs = corpus(5) + [(100, "ab" * 3000), (101, "b" + "ab" * 40), (102, "é" * 60), (103, "xé" + "é" * 30)]
    seen, want = {}, {}
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = [True] * 50
        left = bytes(x for x, z in zip(b, gone) if not z)
        want[d] = (len(b), sum(gone), sum(z and not (i and gone[i - 1]) for i, z in enumerate(gone)), hashlib.sha256(left).hexdigest(), left)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.dedup(frame(docs)).collect()}
    assert got == want
    assert substrings.dedup(frame([])).count() == 0
    null = substrings.dedup(frame([(None, "z" * 80), (1, "z" * 80), (1, "z" * 80), (2, "z" * 80)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in null) == [("1", 0), ("1", 0), ("2", 80), ("None", 0)]


def test_suffix_sort():
    r = np.random.default_rng(1)
    raw = r.integers(97, 99, 4000).astype(np.uint8)
    at = r.permutation(3900)[:1500]
    group = np.sort(r.integers(0, 7, 1500))
    h = substrings.prefix_hash(raw)
    order = substrings.suffix_sort(raw, h, at, group)
    for g in range(7):
        own = [raw[at[i] : at[i] + 50].tobytes() for i in order if group[i] == g]
        assert own == sorted(own) and len(own) == (group == g).sum()


def test_packing(spark, frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = corpus(6) + [(200, "It's <|endoftext|> a\x1cb ΑΣ İ １２3 日本語 😀a"), (201, "long words " * 9000)]
    want = {}
    for d, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, i in enumerate(range(0, len(ids), 4096)):
            want[d, k] = (i, len(ids[i : i + 4096]), zlib.crc32(array("I", ids[i : i + 4096]).tobytes()))
    for base in (100_000, 7):  # 7: every pattern document stands for several
        rows = packing.packed_sequences(frame(docs), path, base=base).collect()
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096
        if base > 7:
            assert len(places) <= -(-sum(x[1] for x in want.values()) // 4096) + 1
    assert packing.packed_sequences(frame([]), path).count() == 0
    same = packing.packed_sequences(frame([(1, "a"), (1, "a"), (None, "a")]), path).collect()
    assert sorted(r.offset for r in same) == [0, 2, 4]


def test_packing_small_cache():
    import public_tokenizers

    small, large = (packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), n) for n in (3, 1000))
    text = " ".join(random.Random(2).choices(["alpha", "beta,", "Gamma", "d3lta", "éps", "z"], k=200))
    assert small.ids(text) == large.ids(text) == large.whole(text)


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + 0.12 * r.standard_normal(16) * (i % 3)], int(i % 2)) for i in range(150)]
    rows += [(1000 + i, [1.0] * 16, 0) for i in range(40)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0] * 16, None), (2004, [1.0, None], 1), (2005, [1e300] * 16, 0), (2006, [], 1), (2007, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as n")
    links = {v: 0 for v, _, _ in rows}
    g = Groups(links)
    for (a, x, m), (b, y, n) in itertools.combinations(rows, 2):
        if m is None or m != n or not x or not y or len(x) != len(y) or None in x or None in y or not np.isfinite(x).all() or not np.isfinite(y).all():
            continue
        x, y = np.array(x) / (np.abs(x).max() or 1), np.array(y) / (np.abs(y).max() or 1)
        if x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links[a] += 1
            links[b] += 1
            g.join(a, b)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got == {v: (n, g.root(v), g.root(v) == v) for v, n in links.items()}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_language_id(frame):
    r = random.Random(5)
    letters = {"en": "thewando", "de": "schueing", "fr": "élauxèqu", "es": "ñóciarll"}
    docs = [(i, " ".join("".join(r.choices(letters[k], k=5)).upper() if i % 9 == 0 else "".join(r.choices(letters[k], k=5)) for _ in range(30)), k) for i in range(240) for k in [list(letters)[i % 4]]]
    docs += [(900, None, "en"), (901, "12 !!", "en"), (902, "", None), (903, "thewando", None)]
    df = frame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predicted(df).collect()}
    for d, _, k in docs:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    own = [got[d].lang_pred == k for d, t, k in docs[:240] if got[d].held_out]
    assert len(own) > 30 and np.mean(own) > 0.97
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predicted(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predicted(frame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_resampling(spark, frame):
    r = random.Random(6)
    good, bad = [["alpha", "beta", "gamma", "delta"], ["zzz!!", "qq!!", "xx!!"]]
    docs = [(i, " ".join(r.choices(bad if i % 5 == 0 else good, k=30))) for i in range(200)] + [(500, None), (501, " ")]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(0, 200, 3)] + [(None, 1), (1, 0)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in resampling.resampled(frame(docs), labels, share=0.5).collect()}
    kept = [d for d in rows if rows[d].kept]
    assert len(kept) == 100 and not [d for d in kept if d % 5 == 0] and not rows[500].kept and rows[501].log_weight is None
    keys = sorted((x.sampling_key for x in rows.values() if x.sampling_key is not None), reverse=True)
    df = spark.createDataFrame([(k,) for k in keys], "k double")
    for k in (1, 57, 200):
        assert resampling.kth_largest(df, "k", k, last=3) == keys[k - 1]
    raw, target = resampling.gram_counts(frame(docs).selectExpr("text", "doc_id % 5 != 0 as good"))
    assert raw.sum() == 200 * 59 and target.sum() == 160 * 59
    assert resampling.resampled(frame([]), labels).count() == 0


def test_decontamination(spark, frame):
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(500)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    story = "the train leaves with Anna at 10 km and after {} km it meets Anna with {} kg of " + say(6)
    items = [(1, say(30)), (2, story.format(20, 5)), (3, say(6)), (4, "a b"), (5, None), (6, say(30))]
    a, c = items[0][1], items[2][1]
    half = " ".join(items[5][1].split()[:12])
    docs = [
        (1, say(50) + " " + a + ". " + say(20)), (2, say(10) + ". " + story.format(77, 6) + " " + say(9)), (3, say(90)), (4, c + " " + say(30)), (5, None), (6, ""), (7, "a b"),
        (8, a.upper()), (9, say(30) + " " + half + " " + say(30)), (10, (say(8) + " ") * 2000), (11, story.replace("Anna at", "Eve at").format(1, 2)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as size")
    got = sorted((x.doc_id, x.item_id) for x in decontaminate.contaminations(frame(docs + docs[:1]), bench).collect())
    assert got == [(1, 1), (2, 2), (4, 3), (8, 1)]  # 11 names two people where the item names one
    assert decontaminate.contaminations(frame([]), bench).count() == 0
    assert decontaminate.contaminations(frame(docs), bench.limit(0)).count() == 0


def test_warc(spark):
    page = "<html><head><title>A &amp; B</title></head><body><p>One<br>two</p><script>x</script><!-- c --><a href='/l?a=1&amp;b'>t &lt;</a></body></html>"
    rows = [(1, "http://a/b c", page), (2, None, None), (3, "http://x", ""), (3, "http://x", ""), (4, "http://y", "<p>é" + "x" * 200_000)]
    made = warc.build(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as block")).collect()
    assert len(made) == 10
    meta, text = ([r for r in made if r.page_id == 1 and r.warc_type == k][0] for k in ("metadata", "conversion"))
    assert bytes(text.block).decode() == "One\ntwo\nt <" and meta.refers_to == text.refers_to and meta.record_id != text.record_id
    fields = bytes(meta.block).decode()
    assert "title: A & B\r\n" in fields and "outlink: /l?a=1&b\r\n" in fields and "source-header-content-type: text/html; charset=UTF-8" in fields and f"source-payload-digest: {warc.digest(page.encode())}" in fields
    records = [{"headers": list(r.headers.items()), "block": bytes(r.block)} for r in made]
    back = warc.parse(b"".join(warc.serialised(r) for r in records))
    assert [(x["headers"], x["block"]) for x in back] == [(r["headers"], r["block"]) for r in records]
    for r in back:
        head = dict(r["headers"])
        assert head["WARC-Block-Digest"] == warc.digest(r["block"]) and head["WARC-Refers-To"].startswith("<urn:uuid:")
    status, headers, payload = warc.split_http(warc.response("u", b"x", headers=(("X-A", "1"),))["block"])
    assert (status, headers, payload) == ("HTTP/1.1 200 OK", [("X-A", "1")], b"x")
    assert warc.split_http(b"no http") == ("", [], b"no http")
