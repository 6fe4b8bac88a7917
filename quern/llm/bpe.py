"""BPE encoding and decoding over a table of distinct words.

Texts are split to words in Spark, the distinct words of the corpus are encoded once each, and
every position of a text takes its word's ids from that table.

The join by position moves words, not texts: what a split of the input needs of the word table is
joined by (split, word) and stored as that split's dictionary, sorted by split. A task then reads
its own dictionary and its own split of the input. A word that its dictionary does not hold (the
input was split otherwise meanwhile) is encoded in place, so results never depend on the splits.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.shared import fresh, release, resident, shared_path

#: Fixed values of the tokenizer file: its word pattern, and the special strings it takes from raw text.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = r"<\|(?:startoftext|endoftext)\|>"

_words = regex.compile(WORD)
#: The same words below U+0250, where these are all the numbers, for the faster engine.
_latin_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\w\s]|_)+")
#: From here on, Unicode tables of libraries may differ; such texts are split by the tokenizer itself.
_beyond = re.compile("[ɐ-\U0010ffff]")
_special = re.compile(SPECIAL, re.IGNORECASE)
#: What the tokenizer's \s has but regex's has not, or the other way around: none below U+0250 but these controls.
_odd_space = re.compile("[\x1c-\x1f]")


def tokenizer(path: str):
    """The tokenizer of a worker, without truncation and padding."""

    def load():
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        return loaded

    return resident("tokens", "tokenizer", path, load)


def split_words(text: str, path: str) -> list[str] | None:
    """The words of a text as the tokenizer normalises and splits it; None if the text names a special
    token, which only the tokenizer as a whole handles."""
    if "<|" in text and _special.search(text):
        return None
    if _beyond.search(text) or _odd_space.search(text):
        text = tokenizer(path).normalizer.normalize_str(text)
        if _beyond.search(text) or _odd_space.search(text):
            return _library_words(text, path)
        return _words.findall(text)
    low = text.lower()
    return _latin_words.findall(low) if "İ" not in text else _words.findall(low)


def _library_words(text: str, path: str) -> list[str]:
    """Words by the tokenizer's own tables. Offsets are in characters of the normalised text."""
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def encode_word(word: str, path: str) -> list[int]:
    return tokenizer(path).encode(word, add_special_tokens=False).ids


def shared_encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker: what one task has encoded serves the next."""
    return resident("tokens", "encoder", path, lambda: WordEncoder(path, bound=1_000_000))


class WordEncoder:
    """Encodes texts by words, each word once while it is remembered: at most `bound` words, then anew."""

    def __init__(self, path: str, bound: int = 400_000, known: dict[str, np.ndarray] | None = None):
        self.path, self.bound, self.known = path, bound, {} if known is None else known
        self.model = tokenizer(path).model

    def ids(self, text: str) -> np.ndarray:
        words = split_words(text, self.path)
        if words is None:
            return np.array(tokenizer(self.path).encode(text, add_special_tokens=False).ids, "u4")
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for word in set(words).difference(known):
            # The tokenizer hands words of ASCII letters to its model as they are; only others need its byte mapping.
            own = [t.id for t in self.model.tokenize(word)] if word.isascii() and word.isalpha() else encode_word(word, self.path)
            known[word] = np.array(own, "<u4").tobytes()
        return np.frombuffer(b"".join([known[w] for w in words]), "<u4")


#: Distinct words that a task remembers before it sends them; texts that are taken from a batch at a time.
REMEMBERED, TEXTS = 400_000, 500


def _distinct_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(split, word) of a task, each word once while at most REMEMBERED are remembered."""
    split = TaskContext.get().partitionId()
    seen: set[str] = set()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            yield pa.record_batch([pa.array([split] * len(part), pa.int32()), pa.array(part, pa.string())], ["split", "word"])
        seen.clear()

    for batch in batches:
        for a in range(0, len(batch), TEXTS):
            for text in batch.column(0).slice(a, TEXTS).to_pylist():
                seen.update(split_words(text or "", path) or ())
            if len(seen) > REMEMBERED:
                yield from out()
    yield from out()
    release()


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """ids of each word of the distinct-word table, beside the splits that need it."""
    for batch in batches:
        ids = [e.ids for e in tokenizer(path).encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
        yield pa.record_batch([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "splits", "ids"])


def pieces(path: str) -> list[str]:
    """The id-to-piece table as a list: one entry per id, bounded by the vocabulary."""
    own = tokenizer(path)
    return [own.id_to_token(i) for i in range(own.get_vocab_size())]


class _Dictionary(dict):
    """word -> its number; the ids of word k are ids[starts[k] : starts[k + 1]]. Words that are missing are
    encoded in place."""

    def __init__(self, path: str):
        self.path, self.starts, self.ids = path, array("q", [0]), array("I")

    def __missing__(self, word: str) -> int:
        return self.put(word, encode_word(word, self.path))

    def put(self, word: str, ids: list[int]) -> int:
        self[word] = out = len(self.starts) - 1
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """The ids of a text, by the positions of its words."""
        at = np.array([self[w] for w in words], np.int64)
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.uint32)
        many = starts[at + 1] - starts[at]
        return ids[np.arange(int(many.sum())) + np.repeat(starts[at] - (np.cumsum(many) - many), many)]


class _Written:
    """What each id stands for in a joined text, with a space behind it: id by id, and in a table of WIDE bytes an
    entry, zeros behind the shorter ones, for texts without a longer one."""

    WIDE = 16

    def __init__(self, names: list[str]):
        self.names = [name.encode() + b" " for name in names]
        self.long = np.array([len(name) > self.WIDE or b"\0" in name for name in self.names])
        self.table = np.array([b" " if long else name for name, long in zip(self.names, self.long, strict=True)])

    def digest(self, ids: np.ndarray) -> str:
        if self.long[ids].any():
            joined = b"".join([self.names[i] for i in ids.tolist()])
        else:
            joined = self.table[ids].tobytes().translate(None, b"\0")
        return hashlib.sha256(memoryview(joined)[:-1]).hexdigest()


def _dictionary(folder: str, split: int, path: str) -> _Dictionary:
    out = _Dictionary(path)
    fs, inner = pafs.FileSystem.from_uri(f"{folder}/split={split}")
    if fs.get_file_info(inner).type == pafs.FileType.NotFound:
        return out
    table = ds.dataset(inner, filesystem=fs, format="parquet", ignore_prefixes=["_", "."])
    for batch in table.to_batches(columns=["word", "ids"], batch_size=5_000, batch_readahead=1, fragment_readahead=1):
        for word, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.put(word, ids)
    return out


def _digest(batches: Iterator[pa.RecordBatch], path: str, folder: str, schema: pa.Schema, n_keep: int) -> Iterator[pa.RecordBatch]:
    known = None
    piece = resident("tokens", "pieces", path, lambda: _Written(pieces(path)))
    decimal = resident("tokens", "decimal", path, lambda: _Written([str(i) for i in range(len(piece.names))]))
    for whole in batches:
        if known is None:
            known = _dictionary(folder, TaskContext.get().partitionId(), path)
        for a in range(0, len(whole), TEXTS):
            batch = whole.slice(a, TEXTS)
            counts, digests, decoded = [], [], []
            for text in batch.column(n_keep).to_pylist():
                words = split_words(text or "", path)
                ids = known.of(words) if words is not None else np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
                counts.append(len(ids))
                digests.append(decimal.digest(ids))
                decoded.append(piece.digest(ids))
            yield pa.record_batch([*batch.columns[:n_keep], pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], schema=schema)
    del known
    release()


def token_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256, decoded_sha256 of every row of `docs`.

    Encoding is the tokenizers library's with add_special_tokens=False, decoding its
    decode(ids, skip_special_tokens=False); special strings in a text become their ids, as there.
    A null or empty text has no tokens: 0 and the digests of the empty string. Rows that repeat give
    rows that repeat; other columns are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(*keep, F.col(text).alias(fresh(docs, "text")))
    found = source.select(source.columns[-1]).mapInArrow(functools.partial(_distinct_words, path=path), "split int, word string")
    found = found.groupBy("word").agg(F.collect_set("split").alias("splits"))
    encoded = found.mapInArrow(functools.partial(_encoded, path=path), "word string, splits array<int>, ids array<int>")
    folder = shared_path(spark, "words")
    needed = encoded.select(F.explode("splits").alias("split"), "word", "ids")
    needed.repartition("split", F.pmod(F.hash("word"), F.lit(4))).write.option("compression", "zstd").partitionBy("split").parquet(folder)
    schema = T.StructType([source.schema[c] for c in keep])
    for name, kind in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())):
        schema = schema.add(name, kind)
    return source.mapInArrow(functools.partial(_digest, path=path, folder=folder, schema=to_arrow_schema(schema), n_keep=len(keep)), schema)
