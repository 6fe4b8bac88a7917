"""Removal of long repeated substrings by a depth-limited radix sort of suffixes.

Suffixes matter only through their first `depth` bytes: two are equal when their windows are. They are
ordered by digits, the most significant first, and only groups of more than one go on:

 1. The first digit of a window is its anchor: of the 24-byte strings in it, the one with the smallest
    hash, the leftmost of equal ones. Equal windows have equal anchors at equal places, and neighbouring
    windows mostly share one, so that a corpus has about one anchor for 14 bytes. Anchors of one
    document end here.
 2. The second digit is the run of windows around an anchor, as a whole. A run that an earlier document
    has too is removed as a whole. First copies of runs end here, if their anchor has no other run.
 3. The third digit is the window. Only first copies of runs whose anchor has several runs, the edges
    of repeated passages, come this far.

A digit's groups are found by an exchange of sorted distinct keys: each split sends a key once, with the
smallest document that has it, and learns whether an earlier one has it elsewhere. Groups are by 64-bit
hashes of their strings.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.exchange import answers, exchange, merged, splits_of
from quern.llm.shared import release
from quern.llm.shingles import _FACTORS, eights, mix

GRAM, CELL_BITS, PIECE = 24, 36, 1 << 18
_TOP = np.uint64(1 << 63)


class Runs:
    """Runs of windows with one anchor in a piece of text: first window, number of windows, anchor's hash,
    document (index in the split)."""

    def __init__(self, data: np.ndarray, owner: np.ndarray, base: int, depth: int):
        """owner: each byte's document in the split; base: the piece's first byte in the split."""
        self.data, self.base, self.depth = data, base, depth
        n = len(data) - depth + 1
        words = eights(data)
        grams = mix(words[:-16] * _FACTORS[0] + words[8:-8] * _FACTORS[1] + words[16:] * _FACTORS[2])
        least, where, width = grams, np.arange(len(grams), dtype=np.int32), 1
        target = depth - GRAM + 1
        while width < target:
            step = min(width, target - width)
            left, right = least[: len(least) - step], least[step:]
            keep = left <= right
            least, where = np.where(keep, left, right), np.where(keep, where[: len(keep)], where[step:])
            width += step
        whole = owner[:n] == owner[depth - 1 :]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(where[1:n], where[: n - 1], out=new[1:])
        new[1:] |= owner[1:n] != owner[: n - 1]
        new[1:] |= whole[1:] != whole[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        real = whole[start]
        self.start, self.count = start[real].astype(np.int32), count[real].astype(np.int32)
        # Anchors are the smallest hashes of many: mixed again, they are even over all numbers.
        self.anchor = mix(grams[where[self.start]] * _FACTORS[3])
        self.doc = owner[self.start]

    def hash(self, chosen: np.ndarray) -> np.ndarray:
        """The hashes of the chosen runs."""
        return self._hashes(self.start[chosen], self.count[chosen].astype(np.int64) + self.depth - 1, self.depth - GRAM)

    def _hashes(self, at: np.ndarray, length: np.ndarray, more: int = 0) -> np.ndarray:
        """Hashes of the strings from `at`, `depth` bytes long and up to `more` longer: eight bytes at a time,
        first the front, then the end. Each step is mixed before the next."""
        words, value = eights(self.data), length.astype(np.uint64) * _FACTORS[9]
        for k in [*range(0, self.depth - 7, 8), self.depth - 8]:
            value = mix(value * _FACTORS[10] + words[at + k])
        for k in range(8, more + 8, 8) if more else ():
            value = mix(value * _FACTORS[11] + words[at + length - k])
        return value

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bytes, hashes, documents) of the windows of the chosen runs."""
        count = self.count[chosen]
        total = int(count.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        at = (np.repeat(self.start[chosen], count) + inside).astype(np.int32)
        value = self._hashes(at, np.full(total, self.depth))
        return at, value, np.repeat(self.doc[chosen], count)


class Split:
    """The texts of a split in a row, and their ids. Pieces overlap by a window less a byte, so that each
    window is in one of them."""

    def __init__(self, batches: Iterator[pa.RecordBatch], depth: int):
        self.depth = depth
        ids, named, sizes, texts = [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty(0, np.int64)], []
        for batch in batches:
            named.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            ids.append(batch.column(0).fill_null(0).to_numpy())
            column = batch.column(1).fill_null("")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            sizes.append(np.diff(offsets).astype(np.int64))
            if len(column) and offsets[-1] > offsets[0]:
                texts.append(column.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes())
        self.ids, self.named, self.sizes = np.concatenate(ids), np.concatenate(named), np.concatenate(sizes)
        self.ends = np.cumsum(self.sizes)
        self.text = b"".join(texts)
        #: Ids as unsigned numbers in their order, and each document's place among them.
        self.by_rank, rank = np.unique(self.ids.astype(np.uint64) + _TOP, return_inverse=True)
        self.rank = rank.astype(np.int32)

    def pieces(self) -> Iterator[Runs]:
        data = np.frombuffer(self.text, np.uint8)
        for a in range(0, len(data) - self.depth + 1, PIECE):
            z = min(a + PIECE + self.depth - 1, len(data))
            owner = np.searchsorted(self.ends, np.arange(a, z), side="right") if z - a < 256 else self._owners(a, z)
            runs = Runs(data[a:z], owner.astype(np.int32), a, self.depth)
            keep = self.named[runs.doc]
            for name in ("start", "count", "anchor", "doc"):
                setattr(runs, name, getattr(runs, name)[keep])
            yield runs

    def _owners(self, a: int, z: int) -> np.ndarray:
        first, last = np.searchsorted(self.ends, [a, z - 1], side="right")
        ends = np.minimum(self.ends[first : last + 1], z)
        return np.repeat(np.arange(first, last + 1), np.diff(np.concatenate([[a], ends])))


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the smallest and the largest of their documents."""
    if not len(keys):
        return keys, docs, docs
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)


def _cell(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(64 - CELL_BITS)


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


# First digit -------------------------------------------------------------------------------------


def _anchor_keys(split: Split) -> tuple[np.ndarray, np.ndarray]:
    cells, docs = [], []
    for runs in split.pieces():
        cells.append(_cell(runs.anchor))
        docs.append(runs.doc)
    keys, low, high = _smallest(_joined(cells), _joined(docs, np.int32))
    return keys, (low != high).astype(np.uint64)


def _ask_anchors(batches: Iterator[pa.RecordBatch], depth: int) -> tuple[np.ndarray, np.ndarray]:
    return _anchor_keys(Split(batches, depth))


def _merge_anchors(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """1 where several documents of one split, or several splits, have the anchor."""
    order, first, group = merged(keys)
    out = np.empty(len(keys), "u1")
    out[order] = (np.add.reduceat(several[order], first) + np.diff(np.append(first, len(keys))).astype(np.uint64) > 1)[group]
    return out


# Second digit ------------------------------------------------------------------------------------


def _shared(split: Split, anchors: str) -> Iterator[tuple[Runs, np.ndarray]]:
    """Pieces, with the indexes of their runs whose anchor several documents have."""
    keys, _ = _anchor_keys(split)
    shared = keys[answers(anchors, keys) == 1]
    for runs in split.pieces():
        if len(shared):
            cell = _cell(runs.anchor)
            at = np.minimum(np.searchsorted(shared, cell), len(shared) - 1)
            yield runs, np.flatnonzero(shared[at] == cell)
        else:
            yield runs, np.empty(0, int)


def _run_keys(split: Split, anchors: str) -> tuple[np.ndarray, np.ndarray, list[tuple[Runs, np.ndarray, np.ndarray]]]:
    """Keys of the second digit: runs (leading bit 0) with their smallest document, anchors (leading bit
    1) with a print of their run, or 0 if they have several."""
    pieces = [(r, i, r.hash(i)) for r, i in _shared(split, anchors)]
    one = np.uint64(1)
    hashes = _joined([h for _, _, h in pieces])
    runs, low, _ = _smallest(hashes >> one, _joined([split.rank[r.doc[i]] for r, i, _ in pieces], np.int32))
    cells, least, most = _smallest(_joined([r.anchor[i] for r, i, _ in pieces]) >> one | _TOP, hashes >> np.uint64(20) | one)
    return np.concatenate([runs, cells]), np.concatenate([split.by_rank[low], np.where(least == most, least, np.uint64(0))]), pieces


def _ask_runs(batches: Iterator[pa.RecordBatch], depth: int, anchors: str) -> tuple[np.ndarray, np.ndarray]:
    return _run_keys(Split(batches, depth), anchors)[:2]


def _merge_earlier(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """1 where another split has the key in an earlier document."""
    order, first, group = merged(keys)
    out = np.empty(len(keys), "u1")
    out[order] = docs[order] > np.minimum.reduceat(docs[order], first)[group]
    return out


def _merge_runs(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For runs as _merge_earlier; for anchors 1 where there are several runs. A bucket holds one kind."""
    if not keys[0] & _TOP:
        return _merge_earlier(keys, values)
    order, first, group = merged(keys)
    prints = values[order]
    least = np.minimum.reduceat(prints, first)
    out = np.empty(len(keys), "u1")
    out[order] = ((least == 0) | (least != np.maximum.reduceat(prints, first)))[group]
    return out


# Third digit -------------------------------------------------------------------------------------


def _edges(split: Split, anchors: str, runs_folder: str) -> Iterator[tuple[Runs, np.ndarray, np.ndarray]]:
    """Pieces, with the indexes of their runs that go as a whole, and of those whose windows are asked for."""
    keys, values, pieces = _run_keys(split, anchors)
    answer = answers(runs_folder, keys)
    one = np.uint64(1)
    for runs, chosen, hashes in pieces:
        at = np.searchsorted(keys, hashes >> one)
        gone = (answer[at] == 1) | (split.by_rank[split.rank[runs.doc[chosen]]] > values[at])
        several = answer[np.searchsorted(keys, runs.anchor[chosen] >> one | _TOP)] == 1
        yield runs, chosen[gone], chosen[~gone & several]


def _window_keys(split: Split, anchors: str, runs_folder: str):
    """Keys of the third digit with the rank of their smallest document, and the pieces they are from."""
    found = []
    for runs, gone, asked in _edges(split, anchors, runs_folder):
        at, value, doc = runs.windows(asked)
        found.append((runs.base + runs.start[gone], runs.base + runs.start[gone] + runs.count[gone] + split.depth - 1, runs.base + at, value, split.rank[doc]))
    keys, low, _ = _smallest(_joined([f[3] for f in found]), _joined([f[4] for f in found], np.int32))
    return keys, low, found


def _ask_windows(batches: Iterator[pa.RecordBatch], depth: int, anchors: str, runs_folder: str) -> tuple[np.ndarray, np.ndarray]:
    split = Split(batches, depth)
    keys, low, _ = _window_keys(split, anchors, runs_folder)
    return keys, split.by_rank[low]


def removed_bytes(split: Split, anchors: str, runs_folder: str, windows_folder: str) -> np.ndarray:
    """For each byte of the split's texts, whether it goes."""
    keys, low, found = _window_keys(split, anchors, runs_folder)
    release()
    answer = answers(windows_folder, keys)
    # A byte begins or ends one run and one window at most.
    change = np.zeros(len(split.text) + 1, np.int8)
    for begin, end, at, value, rank in found:
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        if len(at):
            k = np.searchsorted(keys, value)
            at = at[(answer[k] == 1) | (rank > low[k])]
            np.add.at(change, at, 1)
            np.add.at(change, at + split.depth, -1)
    gone, depth = np.empty(len(split.text), bool), 0
    for a in range(0, len(gone), PIECE):
        inside = np.cumsum(change[a : min(a + PIECE, len(gone))], dtype=np.int32) + depth
        gone[a : a + PIECE], depth = inside > 0, int(inside[-1])
    return gone


def _cleaned(batches: Iterator[pa.RecordBatch], depth: int, anchors: str, runs_folder: str, windows_folder: str, text: bool) -> Iterator[pa.RecordBatch]:
    split = Split(batches, depth)
    gone = removed_bytes(split, anchors, runs_folder, windows_folder)
    release()
    data = np.frombuffer(split.text, np.uint8)
    rows, begin = [], 0
    for size, end in zip(split.sizes.tolist(), split.ends.tolist(), strict=True):
        own = gone[begin:end]
        n_removed = int(own.sum())
        kept = data[begin:end][~own].tobytes() if n_removed else split.text[begin:end]
        n_spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if size else 0
        rows.append((size, n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if text else None))
        begin = end
    for a in range(0, len(rows), 500):
        n_bytes, n_removed, n_spans, digest, kept = zip(*rows[a : a + 500], strict=True)
        ids = pa.array(split.ids[a : a + 500], pa.int64(), mask=~split.named[a : a + 500])
        columns = [ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)]
        yield pa.record_batch([*columns, *([pa.array(kept, pa.binary())] if text else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])])


def remove_repeats(docs: DataFrame, depth: int = 50, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `with_text`
    the bytes kept (removal may cut a character).

    Of each text as UTF-8, every byte goes that a `depth`-byte string covers which also starts in a
    document with a smaller id; strings are judged on the input. A null text is empty. Rows with equal
    ids are not earlier than each other; a row with a null id loses nothing and takes nothing from
    others. Texts shorter than `depth` stay. Other columns are not read. An empty table gives an empty
    one. `depth` is at least 32.
    """
    if depth < GRAM + 8:
        raise ValueError("depth must be at least 32")
    rows, buckets = splits_of(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "texts")
    anchors = exchange(rows, buckets, functools.partial(_ask_anchors, depth=depth), _merge_anchors, "anchors", CELL_BITS)
    runs = exchange(rows, buckets, functools.partial(_ask_runs, depth=depth, anchors=anchors), _merge_runs, "runs")
    windows = exchange(rows, buckets, functools.partial(_ask_windows, depth=depth, anchors=anchors, runs_folder=runs), _merge_earlier, "windows")
    clean = functools.partial(_cleaned, depth=depth, anchors=anchors, runs_folder=runs, windows_folder=windows, text=with_text)
    return rows.mapInArrow(clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
