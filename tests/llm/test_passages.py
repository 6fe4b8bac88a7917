"""Passage removal against brute force."""

import hashlib
import random
import re

import pytest

from quern.llm import passage_dedup
from quern.llm.passage_dedup import remove_passages

SCHEMA = "doc_id long, text string, n_words long, seeds string, kept string"


def brute(rows, width=13):
    words = [[w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    first = {}
    for (doc, _), own in zip(rows, words, strict=True):
        for i in range(len(own) - width + 1) if doc is not None else ():
            key = tuple(own[i : i + width])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(own) - width + 1) if doc is not None else ():
            if first[tuple(own[i : i + width])] < doc:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        out.append((doc, len(own), len(gone), spans, hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(5)


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}é" for _ in range(n)]


@pytest.mark.parametrize("width", [8, 13, 20])
def test_removal_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(passage_dedup, "PIECE", 500)
    rng = random.Random(width)
    passages = [prose(rng, n) for n in (width - 1, width, width + 1, width + 4, 40, 90)]
    rows = []
    for i in range(60):
        own = prose(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(3) and rng.randrange(len(p))
            own += p[a : a + rng.randrange(1, len(p) + 1)] + prose(rng, rng.randrange(4))
        rows.append((rng.randrange(-30, 40), rng.choice([" ", "\n", "\t  "]).join(own)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(None, rows[1][1]), (200, None), (201, ""), (202, " \n "), (203, "a b a b " * 40), (204, "b a b a " * 40), (205, " ".join(["z"] * 3000)), (206, " ".join(["z"] * 15))]
    rows += [(300, " ".join(prose(rng, 3000) + passages[-1])), (-500, "Ω" * 5000 + " " + rows[2][1])]
    got = sorted((tuple(r) for r in remove_passages(frame(spark, rows), width, with_text=True).collect()), key=repr)
    assert got == brute(rows, width)
    assert sum(r[2] for r in got) > 1000


def test_passage_that_many_documents_share(spark):
    """A third of all rows hold one passage, in other surroundings each."""
    rng = random.Random(1)
    shared = prose(rng, 60)
    rows = [(i, " ".join(prose(rng, 20, 100000) + (shared if i % 3 == 0 else []) + prose(rng, 20, 100000))) for i in range(300)]
    got = sorted((tuple(r) for r in remove_passages(frame(spark, rows), with_text=True).collect()), key=repr)
    assert got == brute(rows)
    assert {r[2] for r in got} == {0, 60}


def test_empty_and_short(spark):
    assert remove_passages(frame(spark, [])).collect() == []
    assert remove_passages(frame(spark, [(1, "a b c"), (2, "a b c")])).select("doc_id", "n_removed").orderBy("doc_id").collect() == [(1, 0), (2, 0)]
    with pytest.raises(ValueError):
        remove_passages(frame(spark, []), 7)
