"""The operators' kernels against brute force, without Spark."""

import itertools
import random
import re

import numpy as np
import pytest

from quern.llm.decontaminate import Index, edit_distance_within, normalise
from quern.llm.embedding_dedup import _roots, quantise, tile_links
from quern.llm.exchange import pack, unpack
from quern.llm.html_text import main_text, min_cut
from quern.llm.ngram_join import count_vector, needed_overlap, tree_pairs
from quern.llm.shingles import shingle_set, word_hashes
from quern.llm.toxicity import NEIGHBOURS, Lists, words_of
from quern.llm.toxicity import Index as ToxicIndex


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(20)))
        assert edit_distance_within(item, text) == distance(item, text)


def edited(text, share, rng):
    out = []
    for c in text:
        if rng.random() < share:
            out.append(rng.choice(["", c + rng.choice("abcdefgh "), rng.choice("abcdefgh ")]))
        else:
            out.append(c)
    return "".join(out)


@pytest.mark.parametrize(("share", "recall"), [(0.0, 1.0), (0.03, 0.97), (0.06, 0.9), (0.1, 0.6)])
def test_leaks_are_found(share, recall):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(15, 50))) for i in range(150)]
    index = Index(items)
    texts, planted = [], set()
    for k, (i, t) in enumerate(items):
        texts.append(normalise(f"{prose(50)} {edited(t, share, rng)} {prose(60)}"))
        planted.add((k, i))
    clean = len(texts)
    texts += [normalise(prose(300)) for _ in range(50)]
    found = {(d, index.items[k][0]) for d, k, _ in index.matches(texts, 0.15)}
    assert len(found & planted) >= recall * len(planted)
    assert not {d for d, _ in found} & set(range(clean, len(texts)))


def changed(text, edits, rng):
    """The text after so many random insertions, deletions and replacements."""
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [out[k], rng.choice("abcdefgh ")], [rng.choice("abcdefgh ")]])
    return "".join(out)


@pytest.mark.parametrize("length", [48, 60, 100, 150, 300])
def test_all_leaks_within_the_distance_are_found(length):
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, normalise(prose(80)[:length].replace(" ", "x", 1) + "x")) for i in range(40)]
    index = Index(items)
    texts = [normalise(f"{prose(50)} {changed(t, int(0.15 * len(t)), rng)} {prose(60)}") for _, t in items]
    want = {(d, k): e for d, t in enumerate(texts) for k, (_, item) in enumerate(index.items) for e in [edit_distance_within(item, t)] if e <= int(0.15 * len(item))}
    assert set(want) >= {(k, k) for k in range(40)}
    assert {(d, k): e for d, k, e in index.matches(texts, 0.15)} == want


@pytest.mark.parametrize("length", [10, 13, 14, 20, 27, 33, 40, 47])
def test_short_items_are_found(length):
    rng = random.Random(length)
    prose = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    index = Index([(i, prose(length)) for i in range(30)])
    texts = [f"{prose(200)}{changed(t, rng.randrange(int(0.15 * length) + 1), rng)}{prose(200)}" for _, t in index.items]
    want = [(d, k, e) for d, t in enumerate(texts) for k, (_, item) in enumerate(index.items) for e in [edit_distance_within(item, t)] if e <= int(0.15 * len(item))]
    assert {(d, k) for d, k, _ in want} >= {(k, k) for k in range(30)}
    assert index.matches(texts, 0.15) == want
    for d, k, edits in index.matches(texts[:10], 0.15):
        assert edits == distance(index.items[k][1], texts[d])


def test_short_items_and_texts():
    line = "exactly forty-eight characters are in this line."
    index = Index([(1, None), (2, ""), (3, "too short"), (4, "x" * 60), (5, line)])
    assert len(line) == 48 and [i for i, _ in index.items] == [4, 5]
    assert index.matches(["", "x" * 60, "x", "é" * 50, line], 0.15) == [(1, 0, 0), (4, 1, 0)]
    assert Index([]).matches(["a b"], 0.15) == []


def test_minimum_cut():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 8)
        terminal = [rng.choice([-3, -1.5, -0.4, 0, 0.3, 1, 2.5]) for _ in range(n)]
        edges = {(i, j): rng.choice([0.2, 0.5, 1, 3]) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}

        def paid(label, terminal=terminal, edges=edges):
            return sum(abs(t) for t, x in zip(terminal, label, strict=True) if t and (t > 0) != x) + sum(w for (i, j), w in edges.items() if label[i] != label[j])

        best = min(paid(x) for x in itertools.product([False, True], repeat=n))
        assert paid(min_cut(terminal, edges)) == pytest.approx(best)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words of a page without markup at all, which are quite many here and go on", "plain words of a page without markup at all, which are quite many here and go on"),
        ("<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two  <b>th</b>ree\n<p>four &am x</article><footer>&copy; me</footer>", "A & B One two three four &am x"),
        ("<article><p>Body text</p><aside>more</aside><div class='comments'><p>reader says</p></div><form><p>Sign up</p><input></form><p>End</article>", "Body text End"),
        ("<body><header><h1>Site</h1></header><main><p>Text <!-- <p>gone --> here</p><style>p{}</style></main><div id=sidebar>Side</div><div class='ad'>Buy</div>", "Text here"),
        ("<article><p>a<i>b</i>c <a href='/x'>link</a> in text that has enough words to count</p></article>", "abc link in text that has enough words to count"),
        ("<article>un<!--closed", "un"),
        ("<div id=content><article><p>Text</p></article><p>more to read elsewhere on this site, in many words</p><article class='comment'>me too</article></div>", "Text"),
        ("<body class='single post'><div class=cookie-banner>We use cookies</div><main><p>Main <a href=x>text</a> of this page in some words</main><div class='comment-list'><p>First!</div>", "Main text of this page in some words"),
        ("<div class='post-content'><h2>Head</h2><p>One&nbsp;two&#8212;three</p></div><div class=sidebar><p>side</div><section id=comments><p>c</section>", "Head One two—three"),
        ("<article><p>x < y and <b title='>'>z</b></article>", "x < y and z"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_long_page():
    body = " ".join(f"<p>Paragraph {i} with some words in it.</p>" for i in range(5000))
    assert main_text(f"<nav>menu</nav><article>{body}</article>").count("Paragraph") == 5000


def test_tile_links():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 16)), 5, axis=0) + rng.normal(size=(200, 16)) * 0.25
    x[0] *= 1e30
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = quantise(unit)
    assert (np.linalg.norm(unit - s[:, None] * q, axis=1) <= e).all()
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.93), strict=True) if i < j}
    assert len(want) > 20
    assert set(zip(*(a.tolist() for a in tile_links(x, None, 0.93, 64)), strict=True)) == want
    cross = {(i, j + 90) for i, j in zip(*(a.tolist() for a in tile_links(x[:90], x[90:], 0.93)), strict=True)}
    assert cross == {(i, j) for i, j in want if i < 90 <= j}
    assert _roots(6, np.array([5, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 4, 1]


def test_tree_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 60), dtype=np.uint64)) for _ in range(60)]
    for i in range(150):
        base = sets[i % 60]
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 63, 1, dtype=np.uint64)])))
    sizes, points = np.array([len(s) for s in sets]), np.stack([count_vector(s).astype(np.uint32) for s in sets])
    groups = np.arange(len(sets))
    found = {tuple(sorted(p)) for p in zip(*(a.tolist() for a in tree_pairs(sizes, points, groups, None, 75)), strict=True)}
    linked = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        o = len(np.intersect1d(sets[i], sets[j]))
        if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
            linked.add((i, j))
            assert o >= needed_overlap(len(sets[i]), len(sets[j]), 75)
    assert len(linked) > 50 and linked <= found
    first = groups < 70
    split = {tuple(sorted(p)) for p in zip(*(a.tolist() for a in tree_pairs(sizes, points, groups, first, 75)), strict=True)}
    assert split == {(i, j) for i, j in found if first[i] != first[j]}


def test_shingles():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("aB c\t\x0b\x1cé ") for _ in range(rng.randrange(60)))
        words = "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\x0b", " ").split(" ")
        words = [w for w in words if w]
        runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(shingle_set(text)) == len(runs)
    assert len(set(word_hashes(b"ab ba aab b a ab").tolist())) == 5
    assert shingle_set("a b c").tolist() == shingle_set(" A\nb  c").tolist()
    assert len(shingle_set("x" * 3_000_000)) == 1


def test_pack():
    for values in ([], [0], [1, 255, 256], [0, (1 << 64) - 1]):
        x = np.array(values, np.uint64)
        assert unpack(pack(x), len(x)).tolist() == values


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(5)
    n, m = 700, 30
    vectors = rng.random((n, m)) * (rng.random((n, m)) < 0.15)
    vectors = vectors[vectors.any(axis=1)]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    n = len(vectors)
    index = ToxicIndex(np.arange(m), np.ones(m), vectors, np.arange(n), np.zeros(n), 0.0)
    for k in range(90):
        columns = np.sort(rng.choice(m, k % 9 + 1, replace=False))
        weights = rng.random(len(columns)) ** (k % 5 + 1)
        weights /= np.linalg.norm(weights)
        every = vectors[:, columns] @ weights
        rows, cosines = index.nearest(columns, weights)
        assert np.allclose(np.sort(every)[::-1][:NEIGHBOURS], cosines)
        assert np.allclose(every[rows], cosines)


def test_nearest_examples_skip_long_lists_of_little_worth(monkeypatch):
    """Words that may be skipped are those with many entries for what they add, whatever their bounds."""
    rng = np.random.default_rng(11)
    n, common, rare = 3000, 20, 40
    vectors = np.zeros((n, common + rare + 1))
    for j in range(common):
        vectors[rng.choice(n, 140, replace=False), j] = rng.random(140) * 0.5 + 0.5
    for j in range(rare):
        vectors[rng.choice(n, 2, replace=False), common + j] = rng.random(2) * 0.5 + 0.5
    vectors[:, -1] = rng.random(n) + 1
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    index = ToxicIndex(np.arange(vectors.shape[1]), np.ones(vectors.shape[1]), vectors, np.arange(n), np.zeros(n), 0.0)
    monkeypatch.setattr("quern.llm.toxicity.SKIP", 0.02)
    read, sums = [], Lists.sums
    monkeypatch.setattr(Lists, "sums", lambda self, lists, weights, size: (self is index.by_word and read.append(int((self.starts[lists + 1] - self.starts[lists]).sum())), sums(self, lists, weights, size))[1])
    columns = np.arange(vectors.shape[1])
    weights = np.concatenate([np.full(common, 0.0012), np.full(rare, 0.0009), [1.0]])
    weights /= np.linalg.norm(weights)
    every = vectors @ weights
    rows, cosines = index.nearest(columns, weights)
    assert np.allclose(np.sort(every)[::-1][:NEIGHBOURS], cosines) and np.allclose(every[rows], cosines)
    assert len(read) == 1 and read[0] < 140 * common / 3
    for _ in range(60):
        columns = np.sort(rng.choice(vectors.shape[1], 30, replace=False))
        weights = rng.random(30) ** 3
        weights /= np.linalg.norm(weights)
        every = vectors[:, columns] @ weights
        rows, cosines = index.nearest(columns, weights)
        assert np.allclose(np.sort(every)[::-1][:NEIGHBOURS], cosines) and np.allclose(every[rows], cosines)


def test_words_of_texts():
    texts = ["A b1c  É\u00e9_x", None, "", "\u201cvile\u201d", "\ud800 z" + "y" * 200, "vile VILE"] * 3
    want = [re.findall(r"[a-z\x80-\U0010ffff]+", re.sub(r"[^\x00-\x7f\w]", " ", (t or "").lower())) for t in texts]
    found = [[] for _ in texts]
    for a, z, owner, hashes in words_of(texts):
        assert z > a
        for o, h in zip(owner.tolist(), hashes.tolist()):
            found[a + o].append(h)
    names = {}
    for words, hashes in zip(want, found, strict=True):
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_words_that_a_polynomial_confuses():
    """Words and their complements by the Thue-Morse sequence have one sum under any odd base."""
    for n in (64, 1024, 4096):
        one = "".join("ab"[i.bit_count() % 2] for i in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        assert len(set(word_hashes(f"{one} {two}".encode()).tolist())) == 2
        assert not set(shingle_set(one).tolist()) & set(shingle_set(two).tolist())
