"""Spelling variants: words one edit apart, by Levenshtein automata run over shards of a trie.

Words are counted by Spark. The distinct words are cut by ranges into shards, each a trie in flat arrays
of bounded size. Shards are broadcast in rounds of bounded size; every word's distance-one automaton is
run over every shard of a round, depth-first, and what it accepts is reduced to one row a word: the
number of neighbours and the best of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import entering, resident, stored, text_of

LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A shard ends at the first of so many words and letters; the shards of a round have so many bytes in all.
#: A single longer word is a shard, and a single larger shard a round.
SHARD_WORDS, SHARD_LETTERS, ROUND_BYTES = 100_000, 2_000_000, 32 << 20
#: Words whose automata run together, and words that a task searches for.
BLOCK, TASK_WORDS = 4096, 50_000

_NEAR = "word string, n_near long, form string, form_n long"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
_SHARD = "size long, codes binary, first binary, word binary, n binary, words binary, lengths binary"


def misspelt_words(docs: DataFrame, min_length: int = 7, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word of each run of letters with `min_length` letters or more, A-Z in lower case, a row an occurrence.

    Where the crc32 of "<key>:<run>" is a multiple of `every`, the run has lost its letter at crc32 modulo
    its length. A null text has no words; a null key counts as empty in the crc32.
    """
    # A run in letters of the Basic Plane has as many UTF-16 units as code points, and a shorter one can't get longer.
    runs = F.regexp_extract_all(text_of(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run"))
    found = found.select("k", F.translate("run", _UPPER, _LOWER).alias("run"))
    crc = F.crc32(F.concat_ws(":", "k", "run").cast("binary"))
    at = F.pmod(crc, F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return found.select(F.when(crc % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_length)


class Trie:
    """Words in code-point order as a trie in flat arrays. Nodes are numbered by level, so that a node's children
    are neighbours, in order of their letters."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, word: np.ndarray, n: np.ndarray, words: bytes, lengths: np.ndarray):
        """codes: the letter that leads to each node; first: each node's first child, and the end; word: the
        number of the word that ends at a node, or -1; n: the words' counts; words: UTF-8; lengths: in bytes."""
        self.codes, self.first, self.word, self.n, self.words, self.lengths = codes, first, word, n, words, lengths
        self.ends = np.cumsum(lengths, dtype=np.int64)
        parents = np.repeat(np.arange(len(codes), dtype=np.int64), np.diff(first))
        #: Parent and letter of each node but the root, ascending.
        self.keys = parents << 21 | codes[1:]

    @classmethod
    def build(cls, words: list[str], n: np.ndarray) -> Trie:
        letters, starts, sizes = flat(words)
        node, alive = np.zeros(len(words), np.int64), np.arange(len(words))
        codes, parents, ends_at = [np.zeros(1, np.uint32)], [], np.empty(len(words), np.int64)
        total = 1
        for depth in range(int(sizes.max(initial=0)) + 1):
            over = sizes[alive] == depth
            ends_at[alive[over]] = node[over]
            alive, node = alive[~over], node[~over]
            if not len(alive):
                break
            letter = letters[starts[alive] + depth]
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])])
            codes.append(letter[new])
            parents.append(node[new])
            node = total - 1 + np.cumsum(new)
            total += int(new.sum())
        first = np.ones(total + 1, np.int32)
        first[1:] += np.cumsum(np.bincount(np.concatenate([np.empty(0, np.int64), *parents]), minlength=total)).astype(np.int32)
        word = np.full(total, -1, np.int32)
        word[ends_at] = np.arange(len(words))
        encoded = [w.encode() for w in words]
        return cls(np.concatenate(codes), first, word, n.astype(np.int64), b"".join(encoded), np.array([len(w) for w in encoded], np.int32))

    def row(self) -> dict:
        blobs = {"codes": self.codes.tobytes(), "first": self.first.tobytes(), "word": self.word.tobytes(), "n": self.n.tobytes(), "words": self.words, "lengths": self.lengths.tobytes()}
        return {"size": sum(map(len, blobs.values()))} | blobs

    @classmethod
    def of_row(cls, row: dict) -> Trie:
        kinds = {"codes": np.uint32, "first": np.int32, "word": np.int32, "n": np.int64, "lengths": np.int32}
        return cls(words=bytes(row["words"]), **{k: np.frombuffer(row[k], t) for k, t in kinds.items()})

    def text(self, i: int) -> str:
        return self.words[self.ends[i] - self.lengths[i] : self.ends[i]].decode()

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of the states that have a child by that letter, those children)."""
        key = node << 21 | letter
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.empty(0, np.int64)
        return found, at[found] + 1


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all letters, each word's first letter, each word's length); a zero follows the last word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join([*words, "\0"]).encode("utf-32-le"), np.uint32)
    return letters, np.cumsum(sizes) - sizes, sizes


def neighbours(trie: Trie, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, numbers of the trie's words exactly one edit away), each pair once.

    A state is a word, a node, the number of letters read, and whether the edit is spent. Those that have
    spent it go first, as far as they come; then the others go one letter deeper. A letter is inserted only
    before another one and deleted only at the end of a run of equals, so that no pair is found twice.
    """
    found_word, found_target = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    word, node, read = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
    while len(word):
        more = sizes[word] > read
        letter = np.where(more, letters[np.minimum(starts[word] + read, len(letters) - 1)], 0)
        # All children, with the edit: in place of the next letter, or before it.
        count = trie.first[node + 1] - trie.first[node]
        owner = np.repeat(np.arange(len(word)), count)
        child = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + trie.first[node][owner]
        other = trie.codes[child] != letter[owner]
        owner, child = owner[other], child[other]
        replaced = more[owner]
        # The next letter left out.
        following = np.where(sizes[word] > read + 1, letters[np.minimum(starts[word] + read + 1, len(letters) - 1)], 0)
        left_out = np.flatnonzero(more & (following != letter))
        w = word[np.concatenate([owner[replaced], owner, left_out])]
        v = np.concatenate([child[replaced], child, node[left_out]])
        i = np.concatenate([np.full(int(replaced.sum()), read + 1), np.full(len(owner), read), np.full(len(left_out), read + 1)])
        while len(w):
            done = i == sizes[w]
            if done.any():
                target = trie.word[v[done]]
                hit = target >= 0
                found_word.append(w[done][hit])
                found_target.append(target[hit])
                w, v, i = w[~done], v[~done], i[~done]
            on, v = trie.step(v, letters[starts[w] + i].astype(np.int64))
            w, i = w[on], i[on] + 1
        # The same letter, the edit still to come.
        on, deeper = trie.step(node[more], letter[more].astype(np.int64))
        word, node, read = word[more][on], deeper, read + 1
    return np.concatenate(found_word), np.concatenate(found_target).astype(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of a partition of (word, n), in order."""
    entering("spelling")
    words: list[str] = []
    counts: list[int] = []
    letters = 0

    def shard() -> pa.RecordBatch:
        row = Trie.build(words, np.array(counts)).row()
        return pa.record_batch([pa.array([row[k]], pa.int64() if k == "size" else pa.binary()) for k in row], names=list(row))

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and (len(words) == SHARD_WORDS or letters + len(word) > SHARD_LETTERS):
                yield shard()
                words, counts, letters = [], [], 0
            words.append(word)
            counts.append(n)
            letters += len(word)
    if words:
        yield shard()


def _best(tries: list[Trie], words: list[str]) -> pa.RecordBatch:
    """Of each word with neighbours in the shards: how many, and the most frequent (the first of equals)."""
    letters, starts, sizes = flat(words)
    n_near, form, form_n = np.zeros(len(words), np.int64), [None] * len(words), np.full(len(words), -1, np.int64)
    for trie in tries:
        word, target = neighbours(trie, letters, starts, sizes)
        if not len(word):
            continue
        n = trie.n[target]
        order = np.lexsort((target, -n, word))
        word, target, n = word[order], target[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        n_near[word[at]] += np.diff(np.append(at, len(word)))
        # Shards come in the order of their words, so that an equal count of a later one is no better.
        for k in at[n[at] > form_n[word[at]]].tolist():
            form[word[k]], form_n[word[k]] = trie.text(target[k]), n[k]
    some = np.flatnonzero(n_near).tolist()
    return pa.record_batch([pa.array([words[k] for k in some], pa.string()), pa.array(n_near[some]), pa.array([form[k] for k in some], pa.string()), pa.array(form_n[some])], schema=_NEAR_ARROW)


def _search(words: DataFrame, shards: Broadcast) -> DataFrame:
    """One row for each word with a neighbour in the broadcast shards."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = resident("spelling", "tries", name, lambda: [Trie.of_row(r) for r in shards.value])
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a in range(0, len(column), BLOCK):
                yield _best(tries, column[a : a + BLOCK])

    return words.mapInArrow(run, _NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: for each row of `words` (distinct words, counts n) the number of other words
    exactly one inserted, deleted or replaced code point away, and the most frequent of
    them (the smallest in code-point order of equals), null without any. Null words are left out."""
    spark = words.sparkSession
    words = stored(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    n_words = words.count()
    cut = words.repartitionByRange(max(1, -(-n_words // SHARD_WORDS)), "word").sortWithinPartitions("word")
    shards = stored(cut.mapInArrow(_build, _SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")
    # A row a shard: its number, ascending with its words, and its size.
    rounds: list[list[int]] = []
    room = 0
    for shard, size in shards.select("shard", "size").orderBy("shard").toLocalIterator():
        if size > room or not rounds:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(shard)
        room -= size
    parts = [words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))]
    # The stored words lie in files of any size; they are dealt to tasks of even work.
    asked = words.select("word").repartition(max(1, -(-n_words // TASK_WORDS)))
    for chosen in rounds:
        held = shards.where(F.col("shard").between(chosen[0], chosen[-1])).orderBy("shard").collect()
        sent = spark.sparkContext.broadcast([r.asDict() for r in held])
        parts.append(stored(_search(asked, sent), "near").select("word", F.lit(0).cast("long").alias("n"), "n_near", "form", "form_n"))
        sent.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))).alias("best")
    grouped = every.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return grouped.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root for each row of `forms` (word, form) that has a form: what following forms ends at. Forms have to
    lead to no circle. Rounds are logarithmic in the longest chain; the state is written each round."""
    left = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        up = left.select(F.col("word").alias("root"), F.col("root").alias("up"))
        moved = left.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("went"))
        left = stored(moved, "forms")
        if left.where("went").isEmpty():
            return left.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of `misspelt_words` with `min_count` occurrences.

    form is the most frequent word exactly one edit away (the smallest in code-point order of equals) if it
    occurs `ratio` times as often at least; root is what following forms ends at, the word itself without
    a form; form_n is form's count. Forms rise in count, so that they never lead back (`ratio` is above 1).
    Rows with equal ids count as they are; other columns are not read. An empty table gives an empty one.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = misspelt_words(docs, min_length, every, key, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    near = near_words(words)
    good = F.col("form_n") >= ratio * F.col("n")
    near = stored(near.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "variants")
    rooted = near.join(last_forms(near), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
