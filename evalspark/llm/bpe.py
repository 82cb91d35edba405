"""Byte-level BPE: encoding by a priority queue of merges, decoding by concatenating vocabulary strings."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

MEMO_WORDS = 1 << 18  # split words whose ids a task remembers, and as many old ones
MEMO_CHARS = 64  # longer ones are not remembered

#: How the byte-level splitter cuts a text, and the first character that is newer than the
#: Unicode version (16) of the classes it was defined on. Where a text holds such a character, the letters and
#: digits of the ranges below, which later versions added, count as other characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


class Vocabulary(NamedTuple):
    """`strings` has the bytes of each id; `first` is the id of each byte; `ranks` has for each id the ids that it merges
    with to its right, and the ranks of these merges; `made` is the id that the merge of a rank makes; `special` has the
    strings that are ids as they stand."""

    strings: list[bytes]
    first: list[int]
    ranks: list[dict[int, int]]
    made: list[int]
    special: dict[str, int]


def byte_letters() -> dict[str, int]:
    """The byte that each character of a vocabulary string stands for: visible Latin-1 characters for themselves, the
    other 68 bytes, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def load(path: str | None = None) -> Vocabulary:
    """Read the JSON file of a byte-level BPE tokenizer (on the driver). Its size bounds all that tasks are sent.
    What would change the result and is not built, such as a normalizer, dropout or flags of added tokens, is refused."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, splitter = given["model"], given["pre_tokenizer"]
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "truncation", "padding") if given.get(k)]
    if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        odd.append("pre_tokenizer")
    for token in given["added_tokens"]:
        odd += [f"{flag} of {token['content']}" for flag in ("single_word", "lstrip", "rstrip", "normalized") if token.get(flag)]
    if odd:
        raise ValueError(f"not supported by this encoder: {', '.join(odd)}")
    letters = byte_letters()
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in given["added_tokens"]}
    strings = [b""] * (1 + max([*ids.values(), *special.values()]))
    for text, i in ids.items():
        strings[i] = bytes(letters[c] for c in text)
    for text, i in special.items():
        strings[i] = text.encode()
    names = {b: c for c, b in letters.items()}
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
    ranks: list[dict[int, int]] = [{} for _ in strings]
    made = []
    for rank, (a, b) in enumerate(pairs):
        ranks[ids[a]][ids[b]] = rank
        made.append(ids[a + b])
    return Vocabulary(strings, [ids[names[b]] for b in range(256)], ranks, made, special)


def merged(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one split word. Symbols are a doubly linked list over the places of their first bytes; the queue
    holds the merges of neighbours, rank and place in one number, so the least rank comes first and of equal ones the
    leftmost. An entry whose symbols have merged otherwise meanwhile no longer has that rank: it is stale and skipped."""
    _, first, ranks, made, _ = vocabulary
    symbol = [first[b] for b in word]
    n = len(symbol)
    now = [ranks[a].get(b, -1) for a, b in zip(symbol, symbol[1:])]  # rank of each place's merge, -1 for none
    now.append(-1)
    queue = [rank * n + at for at, rank in enumerate(now) if rank >= 0]  # small numbers are cheaper
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        top = heappop(queue)
        rank = top // n
        at = top - rank * n
        if now[at] != rank:
            continue
        gone = after[at]
        new = symbol[at] = made[rank]
        symbol[gone] = now[gone] = now[at] = -1
        beyond = after[at] = after[gone]
        if beyond < n:
            before[beyond] = at
            rank = now[at] = ranks[new].get(symbol[beyond], -1)
            if rank >= 0:
                heappush(queue, rank * n + at)
        if at:
            earlier = before[at]
            rank = now[earlier] = ranks[symbol[earlier]].get(new, -1)
            if rank >= 0:
                heappush(queue, rank * n + earlier)
    return [s for s in symbol if s >= 0]


class _Memo(dict):
    """Ids of split words, as int32 in bytes, learned when first asked for. When MEMO_WORDS are reached they become the
    old ones, of which those asked for again come back and the rest goes at the next turn."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("i", merged(word.encode(), self.vocabulary)).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class _Encoder:
    """Ids of whole texts, on one task, which remembers the ids of split words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        newer = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
        self.newer = re.compile("[՘-\U0010ffff]")
        simple = SPLIT.replace(" ?L+", r" ?\p{L}+").replace(" ?N+", r" ?\p{N}+")
        strict = SPLIT.replace(" ?L+", rf" ?[\p{{L}}--[{newer}]]+").replace(" ?N+", rf" ?[\p{{N}}--[{newer}]]+")
        strict = strict.replace(r" ?[^\s\p{L}\p{N}]+", rf" ?[[^\s\p{{L}}\p{{N}}]||[{newer}]]+")
        self.split = regex.compile(simple).findall
        self.split_strict = regex.compile(strict, regex.V1).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.memo = _Memo(vocabulary)

    def words(self, text: str) -> list[str]:
        return (self.split_strict if self.newer.search(text) else self.split)(text)

    def packed(self, text: str) -> bytes:
        """The ids as int32 in bytes."""
        found = self.memo.__getitem__
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return b"".join(map(found, self.words(text)))
        of = self.vocabulary.special
        return b"".join(chain.from_iterable(
            [np.int32(of[part]).tobytes()] if k % 2 else map(found, self.words(part)) for k, part in enumerate(parts)
        ))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def _encode(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, _, _ in A.byte_groups(texts, 1 << 20):
                found = [encoder.packed(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                at = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists], names=["id", "ids"])

    return run


def _decode(strings: list[bytes]):
    """Bytes of all ids of a group by one gather; sequences that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum([len(s) for s in strings])
        begin, size = np.concatenate(([0], ends[:-1])), np.array([len(s) for s in strings])
        for batch in batches:
            lists = batch.column("ids")
            for lo in range(0, len(lists), 256):
                part = lists.slice(lo, 256)
                counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                n = size[ids]
                total = np.concatenate(([0], np.cumsum(n)))
                raw = pool[np.repeat(begin[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
                at = total[np.concatenate(([0], np.cumsum(counts)))].tolist()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, 256) for c in batch.columns), pa.array(texts, pa.string())], names=["id", "ids", "decoded"]
                )

    return run


def encode(documents: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: id, ids (the tokens of the whole text, array of int).

    A text is cut at special tokens, then by the splitter; each split word is merged by `merged`, equal ones once per
    task while they are remembered. Null and empty texts have no ids. Null, repeated and shared ids pass through; other
    columns are not read. A word without breaks, however long, takes n log n steps.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(vocabulary), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of `encoded`: id, ids, decoded. Null and empty lists decode to the empty text. An id outside
    the vocabulary, or null, is an error."""
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    out = rows.mapInArrow(_decode(vocabulary.strings), "id long, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")
