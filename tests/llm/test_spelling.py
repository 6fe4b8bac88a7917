"""Spelling variants against brute force, on kernels and on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import spelling
from quern.llm.spelling import Trie, flat, last_forms, misspelt_words, near_words, neighbours, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, form string, k string, run string"


def edits(word, words):
    letters = sorted({c for w in words for c in w})
    found = set()
    for i in range(len(word) + 1):
        found |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            found |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return (found - {word}) & set(words)


def counted(rows, min_length=7, every=31):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            run = run if h % every else run[:at] + run[at + 1 :]
            if len(run) >= min_length:
                found[run] += 1
    return found


def brute(rows, min_length=7, min_count=2, ratio=10, every=31):
    words = {w: n for w, n in counted(rows, min_length, every).items() if n >= min_count}
    near = {w: edits(w, words) for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= ratio * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", "c", "d") for i, t in rows], SCHEMA).repartition(5)


def mutated(rng, word):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + (rng.choice("abé") if kind else "") + word[at + (kind != 2) :]


def test_automaton_finds_each_neighbour_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abéz") for _ in range(rng.randrange(1, 7))) for _ in range(400)} | {"aaaa", "aaaaa", "aaa", "𝒳a", "a𝒳a"})
    letters, starts, sizes = flat(words)
    for cut in (1, 7, len(words)):
        tries = [(a, Trie.of_row(Trie.build(words[a : a + cut], np.ones(len(words[a : a + cut]))).row())) for a in range(0, len(words), cut)]
        found = []
        for a, trie in tries:
            word, target = neighbours(trie, letters, starts, sizes)
            found += [(words[w], words[a + t]) for w, t in zip(word.tolist(), target.tolist(), strict=True)]
            assert [trie.text(i) for i in range(len(trie.n))] == words[a : a + cut]
        assert len(found) == len(set(found))
        assert set(found) == {(w, o) for w in words for o in edits(w, words)}


@pytest.mark.parametrize("bounds", [None, (37, 120, 4000)])
def test_variants_equal_brute_force(spark, monkeypatch, bounds):
    """Also with many shards in many rounds."""
    if bounds:
        for name, value in zip(("SHARD_WORDS", "SHARD_LETTERS", "ROUND_BYTES"), bounds, strict=True):
            monkeypatch.setattr(spelling, name, value)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randrange(6, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "caféCafé"]
    rows = [(i, " ".join(w if rng.random() < 0.9 else mutated(rng, w) for w in rng.choices(base, range(1, 29), k=60))) for i in range(60)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (61, None), (62, ""), (63, "1234 ..."), (64, "x" * 3000 + " " + "x" * 2999 + "y"), (65, "x" * 3000 + "-" + "x" * 2999 + "y")]
    got = [tuple(r) for r in spelling_variants(frame(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want)


def test_words_lose_the_letter_that_the_crc_names(spark):
    rows = [(i, "Straßenbahn ÉCOLES écoles x÷y") for i in range(300)]
    got = Counter(r.word for r in misspelt_words(frame(spark, rows), min_length=3, every=5).collect())
    assert got == counted(rows, 3, 5)


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("w20", None), ("v", "w3"), ("alone", None)]
    got = dict(map(tuple, last_forms(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w20" for w, f in chain if f}


def test_near_words_leaves_nulls_out(spark):
    rows = spark.createDataFrame([("abc", 5), ("abd", 5), ("ab", 7), (None, 3), ("", 1), ("a", 1)], "word string, n long")
    got = {tuple(r) for r in near_words(rows).collect()}
    assert got == {("abc", 5, 2, "ab", 7), ("abd", 5, 2, "ab", 7), ("ab", 7, 3, "abc", 5), ("", 1, 1, "a", 1), ("a", 1, 2, "ab", 7)}


def test_empty_table(spark):
    assert spelling_variants(frame(spark, [])).collect() == []
    assert spelling_variants(frame(spark, [(1, None)])).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        spelling_variants(frame(spark, []), ratio=1)
