"""Removal of passages that an earlier document holds: seeds, extended both ways.

A seed is a run of `SEED` words that winnowing chooses: of the seeds in a window of `width` words, the one
with the smallest hash, the leftmost of equal ones. Equal windows have equal seeds at equal places, so that
documents which share a window meet at its seed; a corpus has about one seed for five words.

 1. Documents are joined on their seeds. Seeds of one document end here.
 2. A seed's match is extended both ways as far as windows have this seed: at most width - SEED words to
    each side, where the next seeds take over. Where an earlier document agrees all the way, the whole
    reach repeats. First copies of a reach end here, if their seed has no other reach.
 3. Elsewhere, at the ends of repeated passages, the match is extended k words to the left and
    width - SEED - k to the right for each k: a repeat over the threshold covers one of these windows.

What neighbouring seeds cover is joined to the maximal repeats. Each step is an exchange of sorted distinct
keys (`quern.llm.exchange`): a seed, reach or window travels once a split however many documents hold it,
so that no pairs of documents are made and a frequent one weighs no more than another. Strings are told
by 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.exchange import answers, exchange, splits_of
from quern.llm.shared import release
from quern.llm.shingles import _BLANK, _FACTORS, mix, run_hashes
from quern.llm.substring_dedup import _TOP, CELL_BITS, _cell, _joined, _merge_anchors, _merge_earlier, _merge_runs, _smallest

SEED, PIECE = 5, 1 << 18


class Reaches:
    """Seeds of a piece of text with their reaches: first window, number of windows, seed's hash, document (index
    in the split)."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, base: int, width: int):
        """words: hashes; owner: each word's document in the split; base: the piece's first word in the split."""
        self.words, self.base, self.width = words, base, width
        n = len(words) - width + 1
        seeds = np.zeros(len(words) - SEED + 1, np.uint64)
        for k in range(SEED):
            seeds = seeds * _FACTORS[20] + words[k : k + len(seeds)] * _FACTORS[21 + k]
        seeds = mix(seeds)
        least, where, reached = seeds, np.arange(len(seeds), dtype=np.int32), 1
        target = width - SEED + 1
        while reached < target:
            step = min(reached, target - reached)
            left, right = least[: len(least) - step], least[step:]
            keep = left <= right
            least, where = np.where(keep, left, right), np.where(keep, where[: len(keep)], where[step:])
            reached += step
        whole = owner[:n] == owner[width - 1 :]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (where[1:n] != where[: n - 1]) | (owner[1:n] != owner[: n - 1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        real = whole[start]
        self.start, self.count = start[real].astype(np.int32), count[real].astype(np.int32)
        # Seeds are the smallest hashes of many: mixed again, they are even over all numbers.
        self.seed = mix(seeds[where[self.start]] * _FACTORS[3])
        self.doc = owner[self.start]

    def _windows(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        for k in range(self.width):
            value = mix(value * _FACTORS[10] + self.words[at + k])
        return value

    def hash(self, chosen: np.ndarray) -> np.ndarray:
        """The hashes of the chosen reaches: all words of their windows, from the first, then from the last."""
        at, length = self.start[chosen], self.count[chosen] + self.width - 1
        value = self._windows(at, length.astype(np.uint64) * _FACTORS[9])
        for k in range(1, self.width - SEED + 1):
            value = mix(value * _FACTORS[11] + self.words[at + length - k])
        return value

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, hashes, documents) of the windows of the chosen reaches."""
        count = self.count[chosen]
        total = int(count.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        at = (np.repeat(self.start[chosen], count) + inside).astype(np.int32)
        return at, self._windows(at, np.full(total, np.uint64(self.width))), np.repeat(self.doc[chosen], count)


class Split:
    """The word hashes of a split's texts in a row, the documents' ids, and on demand their texts. Pieces overlap
    by a window less a word, so that each window is in one of them."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int, texts: bool = False):
        self.width = width
        ids, named, sizes, words = [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        self.texts: list[bytes] = []
        for batch in batches:
            named.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            ids.append(batch.column(0).fill_null(0).to_numpy())
            own = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            starts, hashes = run_hashes(b"\n".join(own), ~_BLANK)
            ends = np.cumsum(np.fromiter((len(t) + 1 for t in own), np.int64, len(own)))
            sizes.append(np.diff(np.searchsorted(starts, ends), prepend=0))
            words.append(hashes)
            if texts:
                self.texts += own
        self.ids, self.named, self.sizes, self.words = (np.concatenate(x) for x in (ids, named, sizes, words))
        self.ends = np.cumsum(self.sizes)
        #: Ids as unsigned numbers in their order, and each document's place among them.
        self.by_rank, rank = np.unique(self.ids.astype(np.uint64) + _TOP, return_inverse=True)
        self.rank = rank.astype(np.int32)

    def pieces(self) -> Iterator[Reaches]:
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        for a in range(0, len(self.words) - self.width + 1, PIECE):
            z = min(a + PIECE + self.width - 1, len(self.words))
            piece = Reaches(self.words[a:z], owner[a:z], a, self.width)
            keep = self.named[piece.doc]
            for name in ("start", "count", "seed", "doc"):
                setattr(piece, name, getattr(piece, name)[keep])
            yield piece


# Seeds -------------------------------------------------------------------------------------------


def _seed_keys(split: Split) -> tuple[np.ndarray, np.ndarray]:
    cells, docs = [], []
    for piece in split.pieces():
        cells.append(_cell(piece.seed))
        docs.append(split.rank[piece.doc])
    keys, low, high = _smallest(_joined(cells), _joined(docs, np.int32))
    return keys, (low != high).astype(np.uint64)


def _ask_seeds(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray]:
    return _seed_keys(Split(batches, width))


# Reaches -----------------------------------------------------------------------------------------


def _reach_keys(split: Split, seeds: str) -> tuple[np.ndarray, np.ndarray, list[tuple[Reaches, np.ndarray, np.ndarray]]]:
    """Keys of the second step: reaches (leading bit 0) with their smallest document, seeds (leading bit 1)
    with a print of their reach, or 0 if they have several. And the pieces with their shared seeds."""
    keys, _ = _seed_keys(split)
    shared = keys[answers(seeds, keys) == 1]
    pieces = []
    for piece in split.pieces():
        cell = _cell(piece.seed)
        at = np.minimum(np.searchsorted(shared, cell), max(len(shared) - 1, 0))
        chosen = np.flatnonzero(shared[at] == cell) if len(shared) else np.empty(0, int)
        pieces.append((piece, chosen, piece.hash(chosen)))
    one = np.uint64(1)
    hashes = _joined([h for _, _, h in pieces])
    reaches, low, _ = _smallest(hashes >> one, _joined([split.rank[p.doc[i]] for p, i, _ in pieces], np.int32))
    cells, least, most = _smallest(_joined([p.seed[i] for p, i, _ in pieces]) >> one | _TOP, hashes >> np.uint64(20) | one)
    return np.concatenate([reaches, cells]), np.concatenate([split.by_rank[low], np.where(least == most, least, np.uint64(0))]), pieces


def _ask_reaches(batches: Iterator[pa.RecordBatch], width: int, seeds: str) -> tuple[np.ndarray, np.ndarray]:
    return _reach_keys(Split(batches, width), seeds)[:2]


# Windows -----------------------------------------------------------------------------------------


def _window_keys(split: Split, seeds: str, reaches: str):
    """Keys of the third step with the rank of their smallest document; and by piece the first words and ends of
    reaches that go as a whole, and the windows asked for."""
    keys, values, pieces = _reach_keys(split, seeds)
    answer = answers(reaches, keys)
    one = np.uint64(1)
    found = []
    for piece, chosen, hashes in pieces:
        at = np.searchsorted(keys, hashes >> one)
        gone = (answer[at] == 1) | (split.by_rank[split.rank[piece.doc[chosen]]] > values[at])
        several = answer[np.searchsorted(keys, piece.seed[chosen] >> one | _TOP)] == 1
        whole = chosen[gone]
        first, value, doc = piece.windows(chosen[~gone & several])
        begin = piece.base + piece.start[whole].astype(np.int64)
        found.append((begin, begin + piece.count[whole] + split.width - 1, piece.base + first.astype(np.int64), value, split.rank[doc]))
    keys, low, _ = _smallest(_joined([f[3] for f in found]), _joined([f[4] for f in found], np.int32))
    return keys, low, found


def _ask_windows(batches: Iterator[pa.RecordBatch], width: int, seeds: str, reaches: str) -> tuple[np.ndarray, np.ndarray]:
    split = Split(batches, width)
    keys, low, _ = _window_keys(split, seeds, reaches)
    return keys, split.by_rank[low]


def removed_words(split: Split, seeds: str, reaches: str, windows: str) -> np.ndarray:
    """For each word of the split's texts, whether it goes."""
    keys, low, found = _window_keys(split, seeds, reaches)
    answer = answers(windows, keys)
    # A word begins or ends one reach and one window at most.
    change = np.zeros(len(split.words) + 1, np.int8)
    for begin, end, at, value, rank in found:
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        if len(at):
            k = np.searchsorted(keys, value)
            at = at[(answer[k] == 1) | (rank > low[k])]
            np.add.at(change, at, 1)
            np.add.at(change, at + split.width, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _cleaned(batches: Iterator[pa.RecordBatch], width: int, seeds: str, reaches: str, windows: str, text: bool) -> Iterator[pa.RecordBatch]:
    split = Split(batches, width, texts=True)
    gone = removed_words(split, seeds, reaches, windows)
    release()
    for a in range(0, len(split.texts), 500):
        rows = []
        for i in range(a, min(a + 500, len(split.texts))):
            own = gone[split.ends[i] - split.sizes[i] : split.ends[i]]
            n_removed = int(own.sum())
            words = split.texts[i].split()  # at ASCII white space
            kept = b" ".join(compress(words, ~own) if n_removed else words)
            n_spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if n_removed else 0
            rows.append((len(words), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
        n_words, removed, spans, digest, kept_texts = zip(*rows, strict=True)
        ids = pa.array(split.ids[a : a + 500], pa.int64(), mask=~split.named[a : a + 500])
        columns = [ids, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)]
        yield pa.record_batch([*columns, *([pa.array(kept_texts, pa.binary()).cast(pa.string())] if text else [])], ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])])


def remove_passages(docs: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, n_spans (maximal removed runs of words), kept_sha256,
    and with `with_text` the words kept, joined by one space.

    Words are runs of characters other than ASCII white space, as they are. Every word goes that `width`
    consecutive words cover which also start in a document with a smaller id; they are judged on the
    input. A null text has no words. Rows with equal ids are not earlier than each other; a row with a
    null id loses nothing and takes nothing from others. Texts of fewer words stay. Other columns are not
    read. An empty table gives an empty one. `width` is at least 8.
    """
    if width < SEED + 3:
        raise ValueError("width must be at least 8")
    rows, buckets = splits_of(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "texts")
    seeds = exchange(rows, buckets, functools.partial(_ask_seeds, width=width), _merge_anchors, "seeds", CELL_BITS)
    reaches = exchange(rows, buckets, functools.partial(_ask_reaches, width=width, seeds=seeds), _merge_runs, "reaches")
    windows = exchange(rows, buckets, functools.partial(_ask_windows, width=width, seeds=seeds, reaches=reaches), _merge_earlier, "windows")
    clean = functools.partial(_cleaned, width=width, seeds=seeds, reaches=reaches, windows=windows, text=with_text)
    return rows.mapInArrow(clean, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
