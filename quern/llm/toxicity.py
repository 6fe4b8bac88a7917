"""Toxicity by the nearest labelled examples.

Labelled documents are TF-IDF vectors over all their words (document frequencies over the whole corpus); a
word weighs more the more its presence goes with the label, by 1 + chi-square. A document's score is the
vote of its nearest examples by exact cosine, the nearer the heavier, drawn to the share of toxic examples.
These examples are its evidence.

The index is inverted: each word has a list of the examples that hold it, with their weights, and a list of
the blocks of BLOCK examples that hold it, with the largest weight in each. A query's words are taken by
falling worth (their bound, that is their weight times the word's largest weight, an entry of the list) until
the bounds of what is left add up to SKIP at most. The sums so far give a least cosine that the nearest
examples have; the block maxima of the words left say which examples may reach it, and only these are
computed in full. No example is lost. The longest lists are held as rows over all examples, and many queries
at a time are multiplied with them; the longest lists of blocks are rows as well.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import release, resident, stored
from quern.llm.shingles import run_hashes

#: Labelled examples that the index holds at most (by the order of a hash of their ids); with their words
#: these bound what is broadcast.
MAX_EXAMPLES = 20_000
NEIGHBOURS, BLOCK, NEAR, PRIOR_WEIGHT, SKIP = 15, 64, 0.05, 1.0, 0.08
#: Lists held as rows: at most so many, of words that this share of the examples have; queries at a time.
ROWS, SHARE, QUERIES = 192, 0.05, 64
#: Lists of blocks held as rows at most.
TOPS = 4096
#: Bytes of texts whose words are read at a time; texts that are taken from a batch at a time.
CHUNK, TEXTS = 1 << 18, 512
#: More than single precision errs by.
SLACK = 1e-5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
#: Other than ASCII, what is neither a letter nor a digit.
_odd = re.compile(r"[^\x00-\x7f\w]")


def _plain(text: str | None) -> bytes:
    """The text in lower case, with its letters and those other digits as the only bytes marked as letters."""
    low = (text or "").lower()
    return (low if low.isascii() else _odd.sub(" ", low)).encode("utf-8", "surrogatepass")


def words_of(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, z, index of each word's text from a on, the word's hash) of texts a to z, some at a time. Words are
    runs of letters, in lower case; they go by 64-bit hashes."""
    parts, a, size = [], 0, 0
    for z, text in enumerate(texts, 1):
        parts.append(_plain(text))
        size += len(parts[-1])
        if size > CHUNK or z == len(texts):
            ends = np.cumsum([len(p) + 1 for p in parts])
            at, hashes = run_hashes(b" ".join(parts), _LETTER)
            yield a, z, np.searchsorted(ends, at, "right"), hashes.view(np.int64)
            parts, a, size = [], z, 0


def _counted(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, and of the distinct pairs, in order: owner, which value, how often)."""
    names, which = np.unique(values, return_inverse=True)
    pairs, count = np.unique(owner * len(names) + which, return_counts=True)
    return names, *np.divmod(pairs, max(1, len(names))), count


def _known(words: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column of each name among the sorted words, whether it is one of them)."""
    if not len(words):
        return np.zeros(len(names), int), np.zeros(len(names), bool)
    column = np.minimum(np.searchsorted(words, names), len(words) - 1)
    return column, words[column] == names


class Lists:
    """One list of places and values after another: list i is from starts[i] to starts[i + 1]. A place and its
    value in single precision are one number of 64 bits, so that lists are put together by copying bytes."""

    def __init__(self, starts: np.ndarray, places: np.ndarray, values: np.ndarray):
        self.starts = starts
        pairs = np.empty(len(places), "<u8")
        self.places, self.values = pairs.view("<u4")[::2], pairs.view("<f4")[1::2]
        self.places[:], self.values[:] = places, values
        self._pairs = memoryview(pairs)

    @staticmethod
    def of(matrix: np.ndarray | Lists) -> Lists:
        """The rows of a matrix, as far as they are not 0."""
        if isinstance(matrix, Lists):
            return matrix
        rows, places = np.nonzero(matrix)
        return Lists(np.searchsorted(rows, np.arange(len(matrix) + 1)), places, matrix[rows, places])

    def joined(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, values, how many each has) of some lists, one after another."""
        low, high = self.starts[lists], self.starts[lists + 1]
        parts = b"".join([self._pairs[a:z] for a, z in zip(low.tolist(), high.tolist(), strict=True)])
        pairs = np.frombuffer(parts, "<u8") if parts else np.empty(0, "<u8")
        return (pairs & np.uint64(0xFFFFFFFF)).view(np.int64), pairs.view("<f4")[1::2], high - low

    def sums(self, lists: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        """The sums of weighted values by place."""
        places, values, many = self.joined(lists)
        return np.bincount(places, values * np.repeat(weights, many), size)


def _numbered(chosen: np.ndarray, size: int) -> np.ndarray:
    """The place of each of `size` numbers among the chosen ones, or -1."""
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    return place


class Index:
    """words: hashes of the columns' words, in order; idf: their weights; examples: columns and values of each, of
    length 1; by_word and tops: each word's examples and blocks; ids and labels of the examples; prior: share
    of toxic examples."""

    def __init__(self, words: np.ndarray, idf: np.ndarray, examples: np.ndarray | Lists, ids: np.ndarray, labels: np.ndarray, prior: float):
        self.words, self.idf, self.ids, self.labels, self.prior = words, idf, ids, labels, prior
        self.examples = Lists.of(examples)
        self.blocks = -(-len(ids) // BLOCK)
        rows = np.arange(len(ids), dtype=np.uint16 if self.blocks * BLOCK < 1 << 16 else np.uint32)
        rows = np.repeat(rows, np.diff(self.examples.starts))
        order = np.argsort(self.examples.places, kind="stable")
        column, block, inside = self.examples.places[order], rows[order] // BLOCK, rows[order] % BLOCK
        # Sums over examples stand block by block in columns, so that a block's largest is found along rows.
        self.by_word = Lists(np.searchsorted(column, np.arange(len(idf) + 1)), inside * rows.dtype.type(self.blocks) + block, self.examples.values[order])
        first = np.flatnonzero(np.append(True, (column[1:] != column[:-1]) | (block[1:] != block[:-1]))[: len(column)])
        top = np.maximum.reduceat(self.by_word.values, first) if len(first) else self.by_word.values
        self.tops = Lists(np.searchsorted(column[first], np.arange(len(idf) + 1)), block[first], top)
        most = np.zeros(len(idf))
        np.maximum.at(most, column[first], top)
        del rows, order, column, block, inside, first
        many = np.diff(self.by_word.starts)
        self.most, self.worth = most, most / np.maximum(many, 1)
        long = np.argsort(-many, kind="stable")[:ROWS]
        long = long[many[long] > SHARE * len(ids)]
        self.row_of = _numbered(long, len(idf))
        self.rows = np.zeros((len(long), self.blocks * BLOCK), np.float32)
        for i, word in enumerate(long.tolist()):
            a, z = self.by_word.starts[word], self.by_word.starts[word + 1]
            self.rows[i, self.by_word.places[a:z]] = self.by_word.values[a:z]
        many = np.diff(self.tops.starts)
        wide = np.argsort(-many, kind="stable")[:TOPS]
        wide = wide[many[wide] > self.blocks / 8]
        self.top_of = _numbered(wide, len(idf))
        self.top_rows = np.zeros((len(wide), self.blocks), np.float32)
        places, values, many = self.tops.joined(wide)
        self.top_rows[np.repeat(np.arange(len(wide)), many), places] = values
        self.query, self.asked = np.zeros(len(idf)), np.zeros(len(idf), bool)

    def columns(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, counts) of each text's words that the index has."""
        for a, z, owner, words in words_of(texts):
            names, owner, which, count = _counted(owner, words)
            column, known = _known(self.words, names)
            known = np.flatnonzero(known[which])
            column, count = column[which[known]], count[known]
            cuts = np.searchsorted(owner[known], np.arange(z - a + 1))
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield column[b:e], count[b:e]

    def by_rows(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Queries x examples: what the words with rows add to the cosines, in single precision."""
        weights = np.zeros((len(queries), len(self.rows)), np.float32)
        for i, (columns, values) in enumerate(queries):
            row = self.row_of[columns]
            weights[i, row[row >= 0]] = values[row >= 0]
        return weights @ self.rows

    def nearest(self, columns: np.ndarray, weights: np.ndarray, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the nearest examples, those with a common word; of equally near ones, the first
        rows. weights are of length 1; found: what by_rows gives."""
        found = self.by_rows([(columns, weights)])[0] if found is None else found
        short = self.row_of[columns] < 0
        own, values = columns[short], weights[short]
        # Lists whose entries are worth least go last: the bounds of what is skipped add up to SKIP at most.
        order = np.argsort(-values * self.worth[own], kind="stable")
        cut = len(order) - int(np.searchsorted(np.cumsum((values * self.most[own])[order][::-1]), SKIP, "right"))
        heavy, light = order[:cut], order[cut:]
        found = (self.by_word.sums(own[heavy], values[heavy], len(found)).astype(np.float32) + found).reshape(BLOCK, self.blocks)
        best = found.max(axis=0)
        # the best of so many blocks are so many examples
        least = np.partition(best, len(best) - NEIGHBOURS)[len(best) - NEIGHBOURS] if len(best) > NEIGHBOURS else 0.0
        top = self.top_of[own[light]]
        wide, narrow = light[top >= 0], light[top < 0]
        reach = values[wide].astype(np.float32) @ self.top_rows[top[top >= 0]] + self.tops.sums(own[narrow], values[narrow], self.blocks).astype(np.float32)
        at = np.flatnonzero(found >= np.maximum(least - SLACK, 1e-30) - reach)
        rows = np.sort(at % self.blocks * BLOCK + at // self.blocks)
        rows = rows[rows < len(self.ids)]
        self.query[columns], self.asked[columns] = weights, True
        places, held, many = self.examples.joined(rows)
        common = np.flatnonzero(self.asked[places])
        cosines = np.bincount(np.repeat(np.arange(len(rows)), many)[common], held[common] * self.query[places[common]], len(rows))
        self.asked[columns] = False
        best = np.lexsort((rows, -np.round(cosines, 12)))[:NEIGHBOURS]
        best = best[cosines[best] > 0]
        return rows[best], cosines[best]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> tuple[float, list[int]]:
        """(score, ids of up to three nearest examples)."""
        votes = 1 / (1 - np.minimum(cosines, 1) + NEAR) * NEAR * cosines
        score = (float(votes @ self.labels[rows]) + PRIOR_WEIGHT * NEAR * self.prior) / (float(votes.sum()) + PRIOR_WEIGHT * NEAR)
        return min(1.0, max(0.0, score)), self.ids[rows[:3]].tolist()

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Of each text. Without examples, or a word of theirs, that is the share of toxic examples."""
        queries = []
        for columns, counts in self.columns(texts):
            weights = (1 + np.log(counts)) * self.idf[columns]
            length = np.sqrt((weights**2).sum())
            queries.append((columns, weights / length) if length else (columns[:0], weights[:0]))
        out = []
        for a in range(0, len(queries), QUERIES):
            for (columns, weights), found in zip(queries[a : a + QUERIES], self.by_rows(queries[a : a + QUERIES]), strict=True):
                out.append(self.vote(*self.nearest(columns, weights, found)) if len(columns) and len(self.ids) else (self.prior, []))
        return out


class Packed:
    """An index as it is sent. Where it arrives it is the index; a worker makes that once, not once a task."""

    def __init__(self, *parts):
        self.packed = zlib.compress(pickle.dumps(parts), 3)

    def __reduce__(self):
        return _sent, (hashlib.blake2b(self.packed).digest(), self.packed)


def _sent(digest: bytes, packed: bytes) -> Index:
    return resident("toxicity", "index", digest, lambda: _unpacked(packed))


def _unpacked(packed: bytes) -> Index:
    words, idf, starts, planes, counts, ids, labels, prior = pickle.loads(zlib.decompress(packed))
    columns = np.cumsum(np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel(), dtype=np.int32)
    values = (1 + np.log(np.arange(int(counts.max(initial=0)) + 1).clip(1))).astype(np.float32)[counts]
    values *= idf.astype(np.float32)[columns]
    if len(ids):
        values /= np.repeat(np.sqrt(np.add.reduceat(values**2, starts[:-1])), np.diff(starts))
    examples = Lists(starts, columns, values)
    del planes, counts, columns, values
    index = Index(words, idf, examples, ids, labels, prior)
    release()
    return index


def _planes(columns: np.ndarray) -> bytes:
    """Steps between numbers, by bytes: these compress well."""
    return np.diff(columns, prepend=np.int32(0)).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, toxic): in how many examples each word is, and how toxic they are in sum, some at a time."""
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for a, _, owner, words in words_of(batch.column(0).to_pylist()):
            names, owner, which, _ = _counted(owner, words)
            n, toxic = np.bincount(which, minlength=len(names)), np.bincount(which, labels[a + owner], len(names))
            yield pa.record_batch([pa.array(names), pa.array(n), pa.array(toxic)], ["word", "n", "toxic"])


def _frequencies(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(column, n): in how many texts each of the words is; column -1 counts the texts."""
    n, docs = np.zeros(len(words), np.int64), 0
    for batch in batches:
        docs += len(batch)
        for _, _, owner, found in words_of(batch.column(0).to_pylist()):
            names, _, which, _ = _counted(owner, found)
            column, known = _known(words, names)
            n[column[known]] += np.bincount(which, minlength=len(names))[known]
    held = np.flatnonzero(n)
    yield pa.record_batch([pa.array(np.append(held, -1)), pa.array(np.append(n[held], docs))], ["column", "n"])


def fit(examples: DataFrame, corpus: DataFrame, text: str = "text") -> Packed:
    """Index of `examples` (doc_id, text, toxic from 0 to 1; MAX_EXAMPLES ids at most), with document
    frequencies of `corpus`. Rows with a null label or id are left out; rows that repeat an id are one
    example. Without examples every score is 0."""
    chosen = examples.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias(text), F.avg(F.col("toxic").cast("double")).alias("toxic"))
    chosen = stored(chosen, "examples")
    n, toxic = chosen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    present = chosen.select(text, "toxic").mapInArrow(_present, "word long, n long, toxic double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("a"))
    b, c = F.col("n") - F.col("a"), F.lit(float(toxic)) - F.col("a")
    d = F.lit(float(n - toxic)) - b
    both = F.col("n") * (n - F.col("n")) * float(toxic) * float(n - toxic)
    chi2 = F.when(both > 0, n * (F.col("a") * d - b * c) ** 2 / both).otherwise(0.0)
    best = present.select("word", chi2.alias("chi2")).toArrow().sort_by("word")  # the words of MAX_EXAMPLES at most
    words = best.column(0).to_numpy()
    held = corpus.select(text).mapInArrow(functools.partial(_frequencies, words=words), "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(words) + 1)
    found[held.column(0).to_numpy()] = held.column(1).to_numpy()
    idf = np.log((2 + found[-1]) / (1 + found[:-1])) * (1 + best.column(1).to_numpy())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Index(words, idf, np.zeros((0, len(words))), np.empty(0, int), np.empty(0), 0.0)
        for batch in batches:
            made = list(reader.columns(batch.column(1).to_pylist()))
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array([m[i].astype(np.int32).tobytes() for m in made], pa.binary()) for i in (0, 1))], ["doc_id", "toxic", "columns", "counts"])

    rows = chosen.select("doc_id", text, "toxic").mapInArrow(vectors, "doc_id long, toxic double, columns binary, counts binary").where("length(columns) > 0").toArrow()  # MAX_EXAMPLES at most
    # Shorter ones first; taken in Arrow, for the driver's sake.
    order = np.lexsort((rows.column("doc_id").to_numpy(), pc.binary_length(rows.column("columns")).to_numpy()))
    rows = rows.take(order).combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column("columns")).to_numpy() // 4)]).astype(np.int64)
    every, often = (np.frombuffer(b"".join(c.buffers()[2] for c in rows.column(x).chunks if c.buffers()[2]), np.int32)[: starts[-1]] for x in ("columns", "counts"))
    packed = Packed(words, idf, starts, _planes(every), often, rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy(), float(toxic) / n if n else 0.0)
    del rows, every, often
    release()
    return packed


def _scored(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, len(whole), TEXTS):
            batch = whole.slice(a, TEXTS)
            made = index.scores(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array([int(s >= 0.5) for s, _ in made], pa.int32()), pa.array([near for _, near in made], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])
    release()


def held_out(doc_id: Column) -> Column:
    """Whether the id's CRC-32, as text, is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Examples of `docs` that may be learnt from: labels of ids that are not held out (of an id with
    several, their mean)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, evidence (ids of the nearest examples).

    A null or empty text, and one without a word of any example, gets the share of toxic examples. Rows that repeat are each scored; a null id is scored and not held out.
    Without labels every score is 0. Only `text` makes the score.
    """
    index = fit(labelled(docs, labels), docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_scored, index=index), "doc_id long, score double, predicted int, evidence array<long>")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def _accepted(batches: Iterator[pa.RecordBatch], index: Index, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, len(whole), TEXTS):
            batch = whole.slice(a, TEXTS)
            yield batch.filter(pa.array([score < threshold for score, _ in index.scores(batch.column(at).to_pylist())], pa.bool_()))
    release()


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score_toxicity gives at least `threshold`. Rows are judged one by one,
    also those without an id or with another's; nothing is shuffled but the examples."""
    index = fit(labelled(docs, labels), docs)
    return docs.mapInArrow(functools.partial(_accepted, index=index, at=docs.columns.index("text"), threshold=threshold), docs.schema)
