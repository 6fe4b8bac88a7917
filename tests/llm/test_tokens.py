"""BPE digests and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quern.llm.bpe import WordEncoder, split_words, token_digests, tokenizer
from quern.llm.shared import shared_path
from quern.llm.token_files import read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "it's 123 %%% don't'll", "ΑΣ ΣΑΣ İstanbul ẞ ß ǅ", "a\x1cb\x1fc\x85d\xa0e", "<|endoftext|> x", "<|ENDOFTEXT|>", "a<|startoftext|>b", "é ö Å ﬁ", "日本語 テスト 😀👍🏽", "٠١ ½ Ⅷ", "'S 'T 'LL", "a​b c", "\x00\x01", "x" * 3000, "ͅΐ"]


def library(text):
    ids = tokenizer(PATH).encode(text, add_special_tokens=False).ids
    return ids, tokenizer(PATH).decode(ids, skip_special_tokens=False)


def texts(n=400):
    rng = random.Random(5)
    pools = ["abc XYZ'stdm.,!? \n\t12", "éÈßİıſƒǅȺ '" + "".join(map(chr, range(0x20, 0x250))), "".join(map(chr, range(0x250, 0x3100, 7))) + " Σσς", "".join(chr(rng.randrange(0xE000, 0x1FAFF)) for _ in range(200)) + " a"]
    return [*ODD, *("".join(rng.choice(pools[i % 4]) for _ in range(rng.randrange(40))) for i in range(n))]


def test_words_encode_as_the_whole_text():
    encoder = WordEncoder(PATH, bound=50)
    for text in texts(3000):
        assert encoder.ids(text).tolist() == library(text)[0], repr(text)
    assert split_words("a <|endoftext|>", PATH) is None


def test_digests_and_files(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "y"), (9999, None, None), (5000, "again", "z"), (5000, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((i, len(library(t or "")[0]), sha(" ".join(map(str, library(t or "")[0]))), sha(library(t or "")[1])) for i, t, _ in rows), key=repr)
    assert sorted(map(tuple, token_digests(docs, PATH).collect()), key=repr) == want
    folder = shared_path(spark, "test")
    manifest = write_token_files(docs, PATH, folder)
    found = sorted(read_token_files(spark, folder, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert found[-1].start + found[-1].n_tokens == sum(m["n_ids"] for m in manifest)
    start = 0
    by_id = {i: t for i, t, _ in rows}
    for r in found:
        ids = [*library(by_id[r.doc_id] or "")[0], 1]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("end_id", [1, None])
def test_empty_table(spark, end_id):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = shared_path(spark, "test")
    assert write_token_files(docs, PATH, folder, end_id) == []
    assert read_token_files(spark, folder).collect() == [] == token_digests(docs, PATH).collect()
