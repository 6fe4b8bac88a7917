"""Operators on small tables with nulls, repeats, empty and long texts, and clashing columns, against
brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quern.llm.components import components
from quern.llm.decontaminate import decontaminate, find_items
from quern.llm.embedding_dedup import near_duplicate_embeddings
from quern.llm.html_text import extract_text
from quern.llm.line_dedup import dedup_lines, repeated_lines, repeated_runs
from quern.llm.ngram_join import ngram_groups
from quern.llm.substring_dedup import remove_repeats
from quern.llm.toxicity import drop_toxic, score_toxicity

CLASH = "token long, held long, component long, n long, n_lines long, lines string"


def roots(links, nodes):
    low = {x: x for x in nodes}
    while True:
        new = dict(low)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, texts, extra=()):
    rows = [(i, t, 1, 2, 3, 4, 5, "x") for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(6)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000), 5000) for _ in range(200)] + [(7, 7), (None, 3)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    sound = [(a, b) for a, b in links if a is not None and a != b]
    want = roots(sound, {x for link in sound for x in link})
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def copy(rng, text, share):
    return " ".join(f"new{rng.randrange(99)}" if rng.random() < share else w for w in text.split(" "))


def test_ngram_groups(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "One", "a b c d", "A B\tc d", "x" * 200_000, "ß ẞ É é a", "SS ss É É A"]
    bases = [prose(rng, rng.randrange(5, 200)) for _ in range(40)]
    texts += bases + [copy(rng, b, share) for b in bases for share in (0.005, 0.02, 0.04, 0.08)]
    passage = prose(rng, 30)
    texts += [f"{passage} {prose(rng, rng.randrange(1, 40))}" for _ in range(150)]
    family = prose(rng, 120)
    texts += [copy(rng, family, 0.01) for _ in range(150)] + [family] * 30 + [prose(rng, 9000)]
    rows = list(enumerate(texts)) + [(3, "one"), (None, bases[0])]
    got = sorted(map(tuple, ngram_groups(documents(spark, rows)).collect()), key=repr)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in sets for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(links) > 3000
    low = roots(links, sets)
    want = [(i, len(shingles(t)), low.get(i)) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert ngram_groups(empty(spark)).collect() == []


def test_ngram_trees(spark):
    """Links that only a tree finds: the documents of a band share a passage whose first document is linked with
    none of them. Tiles of four rows, so that tiles of one and of several sizes meet."""
    rng = random.Random(11)
    passage = prose(rng, 40, 10**6)
    alone = f"{passage} {prose(rng, 12, 10**6)}"
    rows = [(0, alone)]
    for _ in range(12):
        base = f"{passage} {prose(rng, rng.randrange(8, 40), 10**6)}"
        rows += [(len(rows) + k, f"{base} {prose(rng, k, 10**6)}".strip()) for k in range(5)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    low = roots(links, sets)
    assert len(set(low.values())) > 2
    for tile in (4, 1024):
        assert {r.doc_id: r.component_id for r in ngram_groups(documents(spark, rows), tile=tile).collect()} == low


def removed(rows, depth=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - depth + 1):
                s = b[k : k + depth]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - depth + 1):
                if first[b[k : k + depth]] < i:
                    gone[k : k + depth] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int(((gone[1:] > gone[:-1]).sum()) + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_remove_repeats(spark):
    rng = random.Random(2)
    shared = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([49, 50, 51, 80, 300]))) for _ in range(25)]
    texts = ["".join(rng.choice([rng.choice(shared), "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(8))) for _ in range(150)]
    texts += [None, "", "z" * 49, "z" * 50, "z" * 51, "z" * 700, "ab" * 200, "ba" * 90, texts[0], "日本" * 60, "x" + "日本" * 60, "q" * 300_000]
    rows = list(enumerate(texts)) + [(3, texts[4]), (None, texts[5])]
    found = remove_repeats(documents(spark, rows), with_text=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == removed(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert remove_repeats(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(empty(spark), depth=20)


def lines_left(rows, least, chars):
    own = {(i, t): [x for x in t.split("\n") if x.strip()] for i, t in rows if i is not None and t is not None}
    order = {k: n for n, k in enumerate(sorted(own, key=lambda k: (k[0], k[1])))}
    places = sorted((order[k], s, k) for k in own for s in range(len(own[k])))
    blocks, gone = {}, set()
    for n, s, k in places:
        for size in {1, least}:
            b = tuple(own[k][s : s + size])
            if len(b) == size and (size == least or len(b[0]) >= chars):
                if blocks.setdefault((size, b), (n, s)) < (n, s):
                    gone |= {(k, s + j) for j in range(size)}
    return own, gone


@pytest.mark.parametrize(("least", "chars"), [(2, 12), (1, 40), (3, 10_000), (5, 9)])
def test_dedup_lines(spark, least, chars):
    rng = random.Random(least)
    pool = [f"line {i}" + " tail" * rng.randrange(4) for i in range(30)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += [None, "", "\n\n", "same\n" * 40, texts[1], "one line alone", "x\r\ny\r\n", "ü" * 50_000]
    rows = list(enumerate(texts))
    own, gone = lines_left(rows, least, chars)
    docs = documents(spark, [*rows, rows[5], (None, texts[1])])
    found = dedup_lines(docs, least, chars).collect()
    assert len(found) == len(rows) + 2 and "_n_lines" in found[0].asDict()
    for r in found:
        t = None if r.doc_id is None else texts[r.doc_id]
        if t is None:
            assert r.text == (None if r.doc_id is not None else texts[1])
            continue
        seq, kept = -1, []
        for x in t.split("\n"):
            seq += bool(x.strip())
            if not x.strip() or ((r.doc_id, t), seq) not in gone:
                kept.append(x)
        assert r.text == "\n".join(kept)
        assert (r._n_lines, r.n_removed) == (len(own[r.doc_id, t]), sum(k == (r.doc_id, t) for k, _ in gone))
    assert dedup_lines(empty(spark)).collect() == []


@pytest.mark.parametrize("least", [1, 2, 3])
def test_repeated_runs(spark, least):
    rng = random.Random(least + 10)
    pool = [f"l{i}" for i in range(6)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(30)]
    long = [f"p{i}" for i in range(40)]
    texts += ["\n".join(long), "x\n" + "\n".join(long[3:30]), "\n".join(long) + "\nend", "same\n" * 20, None, ""]
    docs = documents(spark, list(enumerate(texts)))
    lines = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t in enumerate(texts)}
    runs = repeated_runs(docs, least).collect()
    covered = {(r.doc, r.seq + k) for r in runs for k in range(r.n_lines)}
    assert covered == {(r.doc, r.seq) for r in repeated_lines(docs, least, 10**9).collect()}
    for r in runs:
        a, b = lines[r.doc][r.seq :], lines[r.from_doc][r.from_seq :]
        assert (r.from_doc, r.from_seq) < (r.doc, r.seq) and r.n_lines >= least
        assert a[: r.n_lines] == b[: r.n_lines] and a[r.n_lines : r.n_lines + 1] != b[r.n_lines : r.n_lines + 1] or len(a) == r.n_lines == len(b)
    assert {(r.doc, r.seq, r.n_lines, r.from_doc, r.from_seq) for r in runs} >= {(31, 1, 27, 30, 3), (32, 0, 40, 30, 0)}
    assert repeated_runs(empty(spark), least).collect() == []


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    vectors = np.repeat(base, 6, axis=0) + rng.normal(size=(360, 8)) * 0.25
    vectors = vectors.astype(np.float32)
    rows = [(i, v.tolist(), i % 3 if i % 7 else 0, "x") for i, v in enumerate(vectors)]
    rows += [(400 + k, vectors[5].tolist(), 2, "x") for k in range(40)]
    rows += [(500, None, 1, ""), (501, [0.0] * 8, 1, ""), (502, [float("nan")] * 8, 1, ""), (503, [1.0, None] * 4, 1, ""), (504, [float("inf")] * 8, 1, ""), (505, vectors[5].tolist(), None, ""), (506, [], 2, ""), (507, [1.0], 2, ""), (508, [2.0], 2, ""), (509, (vectors[5] * np.float32(3)).tolist(), 2, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string").repartition(5)
    sound = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab, _ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    keys = sorted(sound)
    links = [(i, j) for i in keys for j in keys if i < j and sound[i][1] == sound[j][1] and len(sound[i][0]) == len(sound[j][0]) and sound[i][0] @ sound[j][0] / np.linalg.norm(sound[i][0]) / np.linalg.norm(sound[j][0]) >= 0.93]
    count = {r[0]: 0 for r in rows}
    for i, j in links:
        count[i] += 1
        count[j] += 1
    low = roots(links, count)
    for tile in (16, 1024):
        found = near_duplicate_embeddings(table, tile=tile).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (count[i], low[i], low[i] == i) for i in count}
    assert near_duplicate_embeddings(table.limit(0)).collect() == []


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        words = prose(rng, 60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(bad).upper() + rng.choice(["", "!!", "###"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic) if rng.random() > 0.03 else int(not toxic)))
    rows += [(2000, None, "x"), (2001, "", "x"), (None, "vile", "x"), (2002, "vile " * 30_000, "x"), (2002, "vile", "x")]
    labels += [(2002, None), (None, 1), (3, 1), (9999, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = score_toxicity(docs, marks).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    truth = dict(labels[:1500])
    right = [r.predicted == truth[r.doc_id] for r in found if r.held_out and r.doc_id < 1500]
    assert len(right) > 200 and sum(right) / len(right) > 0.93
    assert {r.doc_id: r.predicted for r in found if r.doc_id in (2000, 2001, 2002, None)} == {2000: 0, 2001: 0, 2002: 1, None: 1}
    assert all(r.evidence for r in found if r.predicted)
    assert sorted((r.doc_id or -1, r.text or "") for r in drop_toxic(docs, marks).collect()) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect() if not any(b in (r.text or "").lower() for b in bad))
    assert {r.score for r in score_toxicity(docs, marks.limit(0)).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), marks).collect() == []


def test_toxicity_is_calibrated(spark):
    """Of the held-out texts with a score near s, about the share s is toxic; scores separate the labels."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(3000):
        hints = rng.choice([0, 1, 3])
        rows.append((i, " ".join([*prose(rng, 25).split(), *(rng.choice(["rude", "harsh", "grim"]) for _ in range(hints))])))
        labels.append((i, int(rng.random() < (0.05, 0.5, 0.95)[(0, 1, 3).index(hints)])))
    truth = dict(labels)
    found = [(r.score, truth[r.doc_id]) for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() if r.held_out]
    assert len(found) > 500 and sum((s - t) ** 2 for s, t in found) / len(found) < 0.16
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        own = [(s, t) for s, t in found if lo <= s < hi]
        assert len(own) > 50 and abs(sum(s for s, _ in own) / len(own) - sum(t for _, t in own) / len(own)) < 0.12


def test_toxicity_of_a_few_examples(spark):
    """No word is in five examples; each example is indexed all the same."""
    rng = random.Random(7)
    marks = [i for i in range(40) if i % 5 and zlib.crc32(str(i).encode()) % 5][:24]
    letters = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    texts = {i: letters() + (" scum moron" if k < 4 else "") for k, i in enumerate(marks)}
    rows = [*texts.items(), (1000, texts[marks[0]]), (1001, "scum"), (1002, texts[marks[9]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in score_toxicity(docs, spark.createDataFrame([(i, int(k < 4)) for k, i in enumerate(marks)], "doc_id long, toxic int")).collect()}
    assert len(marks) == 24 and all(found[i].evidence[0] == i for i in marks)
    assert [found[i].predicted for i in (1000, 1001, 1002)] == [1, 1, 0]
    assert found[1000].evidence[0] == marks[0] and found[1002].evidence[0] == marks[9]


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 30, 5000)) for i in range(20)] + [(90, None), (91, ""), (92, "short")]
    texts = [f"{prose(rng, 40, 5000)} {items[i][1].upper()}\n{prose(rng, 5, 5000)}" for i in range(10)] + [prose(rng, 200, 5000) for _ in range(30)] + [None, "", "short", items[3][1][: len(items[3][1]) // 2]]
    docs = documents(spark, [*enumerate(texts), (2, texts[2]), (None, texts[4])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_items(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in found), key=repr) == sorted([*((i, i, 0) for i in range(10)), (2, 2, 0), (None, 4, 0)], key=repr)
    assert sorted((r.doc_id for r in decontaminate(docs, bench).collect()), key=repr) == list(range(10, len(texts)))
    assert find_items(docs, bench.limit(0)).collect() == find_items(docs.limit(0), bench).collect() == []


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article>a&amp;b</article>", "t"), (1, "u", None, "t"), (None, None, "", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract_text(pages).collect()), key=repr) == sorted([(1, "u", "a&b", 3), (1, "u", "", 0), (None, None, "", 0)], key=repr)
    assert extract_text(pages.limit(0)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        rows = {r.doc_id: r for r in after.collect()}
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        texts = {r.doc_id: r.text for r in before.collect()}
        assert set(rows) <= set(texts) and len(rows) > 0.6 * len(texts), name
        if name != "line_dedup":
            assert all(rows[i].text == texts[i] for i in rows)
        if name == "ngram_join":
            sets = {i: shingles(r.text) for i, r in rows.items()}
            assert not any(sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for i in sets for j in sets if i < j)
        before = spark.createDataFrame([tuple(r) for r in rows.values()], docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf).count() == before.count()
