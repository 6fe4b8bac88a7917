"""Passages of benchmark items in documents, by counts of shared substrings along diagonals.

An edit changes q of a string's substrings of q characters at most. A document that holds an item of m
characters within k edits therefore has m - q + 1 - q k of them or more, in places whose distance to their
place in the item (the diagonal) varies by k at most. All the items' substrings stand in posting lists;
those of a document's are looked up, and what they find is counted by item and by narrow bands of diagonals.
Where the bands over k + 1 diagonals have the number, it is verified by the exact edit distance between the
item and the nearest substring there. No item that is within the distance is lost, wherever its edits are.

This replaces sampled CGK walks, whose keys lose items as their edits grow. Documents are read once; nothing
is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import entering, release

#: Least characters of an item; edits allowed, as a share of the item's length.
LEAST, MAX_EDITS = 10, 0.15
#: Lengths of the substrings of items under LONG characters and of others; bits of their hashes at most.
SHORT_GRAM, LONG_GRAM, LONG, BITS = 3, 5, 64, 22
#: Places found that are counted at a time; bits for a place; characters of documents that are searched at a time.
PLACES, PLACE_BITS, CHUNK = 1 << 21, 40, 1 << 15
#: A band is this power of two narrower than the diagonals that edits may lead over.
FINE = 3
#: Length of the substrings that an item and a place are compared by before their edit distance.
GRAM = 4
#: Bytes of items that a task holds at a time; more items are taken in several rounds over the documents.
ITEM_BYTES = 32 << 20


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def _characters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(data: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A hash of `bits` bits of the `size` characters at each place but the last ones."""
    n = max(0, len(data) - size + 1)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = key * np.uint64(0x100000001B3) + data[i : i + n]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def edit_distance_within(item: str, text: str) -> int:
    """The least edit distance between `item` and a substring of `text`, by bit vectors."""
    m = len(item)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        match = masks.get(c, 0)
        vertical = match | minus
        across = (((match & plus) + plus) ^ plus) | match
        up, down = minus | ~(across | plus) & full, plus & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        best = min(best, score)
    return best


class Postings:
    """The substrings of `size` characters of some items (their numbers and texts), by hash. What is kept
    of each is its item's number, shifted by PLACE_BITS, less its offset."""

    def __init__(self, numbers: np.ndarray, texts: list[str], size: int):
        self.numbers, self.size = numbers, size
        lengths = np.array([len(t) - size + 1 for t in texts], np.int64)
        self.bits = min(BITS, max(10, int(lengths.sum()).bit_length() + 4))
        data, before = _characters(texts), np.cumsum(lengths + size - 1) - lengths - size + 1
        offsets = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = _hashes(data, size, self.bits)[np.repeat(before, lengths) + offsets]
        order = np.argsort(key, kind="stable")
        self.values = ((np.repeat(numbers, lengths) << PLACE_BITS) - offsets)[order]
        self.starts = np.searchsorted(key[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def bands(self, data: np.ndarray, moved: np.ndarray, shift: int, most: int) -> np.ndarray:
        """Sorted bands of 2^shift diagonals, with the item's number before them, one for each substring that
        may be equal there, `most` at least if there are more; `moved` is added to each place."""
        key = _hashes(data, self.size, self.bits)
        low = self.starts[key]
        many = self.starts[key + 1] - low
        at = np.flatnonzero(many)
        low, many, at = low[at].astype(np.int64), many[at].astype(np.int64), at + moved[at]
        ends = np.cumsum(many)
        bands = np.empty(0, np.int64)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - many[a] + PLACES, "right")))
            own = np.arange(int(ends[b - 1] - ends[a] + many[a])) + np.repeat(low[a:b] - ends[a:b] + many[a:b] + ends[a] - many[a], many[a:b])
            new = (self.values[own] + np.repeat(at[a:b], many[a:b])) >> shift
            bands = np.sort(np.concatenate([bands, new]) if len(bands) else new)
            if b < len(at) or a:
                bands = bands[np.append(np.ones(min(most, len(bands)), bool), bands[most:] != bands[:-most])]
            a = b
        return bands


class Index:
    """A bounded set of items, [(item_id, normalised text)], and where their substrings are."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if len(t) >= LEAST]
        self.lengths = np.array([len(t) for _, t in self.items], np.int64)
        self.postings = []
        kinds = [(t_len >= LONG, int(MAX_EDITS * t_len).bit_length()) for t_len in self.lengths.tolist()]
        for kind in sorted(set(kinds)):
            numbers = np.array([k for k, own in enumerate(kinds) if own == kind], np.int64)
            self.postings.append(Postings(numbers, [self.items[k][1] for k in numbers], LONG_GRAM if kind[0] else SHORT_GRAM))

    def _windows(self, texts: list[str], share: float) -> Iterator[tuple[int, int, int, int]]:
        """(text's index, item's index, begin, end) of places that may hold the item; every one that does
        is within such a place."""
        if not len(self.lengths) or not texts:
            return
        allowed = (share * self.lengths).astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        # places are counted with a gap before each text, so that no place meets two texts
        ends = np.cumsum(sizes + int((self.lengths + 8 * (allowed + 1)).max()))
        firsts = np.cumsum(sizes + LONG_GRAM) - sizes - LONG_GRAM
        before = ends - sizes
        data = _characters([t + "\0" * LONG_GRAM for t in texts])
        moved = np.repeat(before - firsts, sizes + LONG_GRAM)
        for postings in self.postings:
            needed = self.lengths - postings.size + 1 - postings.size * allowed
            shift = max(0, int(allowed[postings.numbers].max()).bit_length() - FINE)
            own = np.maximum(needed[postings.numbers], 1)
            bands = postings.bands(data, moved, shift, int(own.max()))
            reach, least = (allowed >> shift) + 1, int(own.min())
            first = np.flatnonzero(bands[least - 1 :] - bands[: max(0, len(bands) - least + 1)] <= int(reach[postings.numbers].max()))
            owner = bands[first] >> (PLACE_BITS - shift)
            at = first + np.maximum(needed[owner], 1) - 1
            good = (at < len(bands)) & (bands[np.minimum(at, len(bands) - 1)] - bands[first] <= reach[owner])
            owner, start = owner[good], (bands[first[good]] & ((1 << (PLACE_BITS - shift)) - 1)) << shift
            doc = np.searchsorted(ends, start, "left")
            new = np.ones(len(start), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > allowed[owner[1:]])
            last = np.flatnonzero(np.append(new, True))[1:] - 1  # places that overlap are one
            doc, owner, start, final = doc[new], owner[new], start[new], start[last]
            begin = start - allowed[owner] - before[doc]
            end = final + (1 << shift) + self.lengths[owner] + allowed[owner] - before[doc]
            yield from zip(doc.tolist(), owner.tolist(), begin.tolist(), end.tolist(), strict=True)
            for k in postings.numbers[needed[postings.numbers] <= 0].tolist():
                yield from ((d, k, 0, len(t)) for d, t in enumerate(texts))

    def matches(self, texts: list[str], share: float) -> list[tuple[int, int, int]]:
        """(text's index, item's index, edits) for each item that a text holds within `share` of its length."""
        best: dict[tuple[int, int], int] = {}
        for doc, k, begin, end in self._windows(texts, share):
            item, text = self.items[k][1], texts[doc]
            if best.get((doc, k)) == 0:
                continue
            window, allowed = text[max(0, begin) : max(0, end)], int(share * len(item))
            if item in window:
                edits = 0
            else:
                held = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
                if sum(item[i : i + GRAM] in held for i in range(len(item) - GRAM + 1)) < len(item) - GRAM + 1 - GRAM * allowed:
                    continue
                edits = edit_distance_within(item, window)
            if edits <= allowed:
                best[doc, k] = min(edits, best.get((doc, k), edits))
        return [(doc, k, edits) for (doc, k), edits in sorted(best.items())]


def _found(batches: Iterator[pa.RecordBatch], index: Index, share: float, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    def out(ids: list, texts: list[str]) -> pa.RecordBatch:
        rows = index.matches(texts, share)
        return pa.record_batch([pa.array([ids[d] for d, _, _ in rows], pa.int64()), pa.array([index.items[k][0] for _, k, _ in rows], pa.int64()), pa.array([e for _, _, e in rows], pa.int64()), pa.array([len(index.items[k][1]) for _, k, _ in rows], pa.int64())], ["doc_id", "item_id", "edits", "n_chars"])

    entering("items")
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(normalise(text))
            size += len(texts[-1])
            if size > chunk:
                yield out(ids, texts)
                ids, texts, size = [], [], 0
        if texts:
            yield out(ids, texts)
    release()


def _indexes(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """Indexes of all items, each of about ITEM_BYTES at most; one empty index if there are none."""
    items = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, -(-total // ITEM_BYTES))
    for k in range(rounds):
        yield Index([tuple(r) for r in (items.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k) if rounds > 1 else items).collect()])


def find_items(docs: DataFrame, items: DataFrame, share: float = MAX_EDITS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, n_chars) for each document and each benchmark item that it holds: some
    substring of the document is within `share` times the item's length (n_chars) of the item, by edit
    distance of the normalised texts. All of them are found.

    Texts are compared in lower case with white space runs as one space. Items of fewer than LEAST
    characters, null and empty ones among them, match nothing: they are too short to tell a leak. Null
    and empty texts hold nothing. Rows that repeat are each answered; a null doc_id stays null. Other
    columns are not read. Empty tables give an empty one.
    """
    found = None
    for index in _indexes(items, item_key, item_text):
        own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(functools.partial(_found, index=index, share=share), "doc_id long, item_id long, edits long, n_chars long")
        found = own if found is None else found.unionByName(own)
    return found


def _clean(batches: Iterator[pa.RecordBatch], index: Index, share: float, at: int) -> Iterator[pa.RecordBatch]:
    entering("items")
    for batch in batches:
        texts = [normalise(t) for t in batch.column(at).to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
            held = {d for d, _, _ in index.matches(texts[a:z], share)}
            yield batch.slice(a, z - a).filter(pa.array([i not in held for i in range(z - a)], pa.bool_()))
            a = z
    release()


def decontaminate(docs: DataFrame, items: DataFrame, share: float = MAX_EDITS, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` without the rows whose text holds an item, as find_items has it. Rows are judged one by one,
    also those without an id or with another's; nothing is shuffled."""
    for index in _indexes(items, item_key, item_text):
        docs = docs.mapInArrow(functools.partial(_clean, index=index, share=share, at=docs.columns.index(text)), docs.schema)
    return docs
