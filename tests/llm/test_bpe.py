"""Byte-level BPE against the public tokenizers library and a plain merge loop."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evalspark.llm import bpe
from evalspark.llm.queries import op12_bpe

from . import tables


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load()


def plain(word, vocabulary):
    """Merge the pair of least rank, the leftmost of equals, until no pair merges."""
    ids = [vocabulary.first[b] for b in word]
    while True:
        ranks = [(vocabulary.ranks[a].get(b), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        ranks = [r for r in ranks if r[0] is not None]
        if not ranks:
            return ids
        rank, i = min(ranks)
        ids[i : i + 2] = [vocabulary.made[rank]]


def test_queue_equals_plain_merging(vocabulary):
    rng = random.Random(1)
    for _ in range(400):
        word = "".join(rng.choice("aaabcdeth ingé漢!") for _ in range(rng.randint(0, 30))).encode()
        assert bpe.merged(word, vocabulary) == plain(word, vocabulary)
    assert bpe.merged(b"a" * 50_000, vocabulary)


def test_splits_on_every_character(library, vocabulary):
    encoder = bpe._Encoder(vocabulary)
    split = library.pre_tokenizer.pre_tokenize_str
    for c in (c for c in range(0x110000) if not 0xD800 <= c < 0xE000):
        text = f"a{chr(c)}1{chr(c)}! {chr(c)} {chr(c)}{chr(c)}a"
        assert [len(w) for w in encoder.words(text)] == [b - a for _, (a, b) in split(text)], hex(c)


def test_texts_equal_the_library(spark, library, vocabulary):
    rng = random.Random(2)
    docs = dict(tables.documents())
    parts = ["<|endoftext|>", "<|endoftext|", " ", "\n", "\t ", "'s", "'LL", "it's", "  two", "123", "՘x", "\U0001f600", "漢字", "\u0000", "z" * 70]
    docs |= {1000 + i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for i in range(200)}
    docs |= {2000: "<|endoftext|>" * 3, 2001: "x" * 100_000, 2002: "same", 2003: "same"}
    df = tables.frame(spark, docs).union(tables.frame(spark, {2002: "other"})).repartition(3)
    rows = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    assert rows.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.decoded, list(r.ids)) for r in rows.collect())
    texts = [(i if i is not None else -99, t or "") for i, t in [*docs.items(), (2002, "other")]]
    want = [(i, t, library.encode(t, add_special_tokens=False).ids) for i, t in texts]
    assert got == sorted(want)
    assert all(library.decode(ids, skip_special_tokens=False) == t for _, t, ids in want)
    assert bpe.encode(tables.empty(spark), vocabulary).collect() == []


def test_small_memory_gives_the_same_ids(spark, library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    encoder = bpe._Encoder(vocabulary)
    for text in list(tables.documents().values())[:10]:
        assert encoder.ids(text or "") == library.encode(text or "", add_special_tokens=False).ids


def test_words_in_use_are_learned_once(vocabulary, monkeypatch):
    learned, plain_merge = [], bpe.merged
    monkeypatch.setattr(bpe, "MEMO_WORDS", 4)
    monkeypatch.setattr(bpe, "merged", lambda word, given: learned.append(word) or plain_merge(word, given))
    encoder = bpe._Encoder(vocabulary)
    for i in range(30):
        encoder.ids(f"the {i}x")
    assert learned.count(b"the") == 1 and len(encoder.memo) <= 4 and len(encoder.memo.old) <= 4


def test_decoding_any_ids(spark, library, vocabulary):
    rng = random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 12))] for _ in range(300)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lists)] + [(None, None, None)], "doc_id long, ids array<int>, decoded string")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, vocabulary).collect()}
    assert got.pop(None) == ""
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = op12_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(docs[r.doc_id]))


def test_what_is_not_built_is_refused(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        given = json.load(file)
    given["normalizer"] = {"type": "NFC"}
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(given))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.load(str(path))
