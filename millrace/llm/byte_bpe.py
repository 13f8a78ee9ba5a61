"""Byte-level BPE: encoding through the tokenizers library over Arrow batches, and decoding.

The vocabulary is a file of ranks, one base64 token and its rank a line. Each match of a pattern
is encoded apart. The library's merge list is made from the ranks: each split of a token into two
tokens is a merge, in the order of the token's rank, which is the order in which adjacent parts
join when the lowest rank joins first.

For the usual pattern, texts are cut before each space between two visible characters, which never parts
a match. Each distinct word of a group of texts goes to the library once, many words in one call, and a task
remembers the ids of up to ``_REMEMBERED`` words; a text's ids are gathered from its words'. At its end they are
dropped and the memory goes back to the system. Offsets, and other patterns, take whole texts.

Bytes stand for characters inside the library; decoding goes through the reverse table to bytes
first, so a character whose bytes are split over tokens comes back whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .idle import lean

#: The library holds about 200 bytes for a token, so texts go to it in groups of this many characters.
_GROUP = 1 << 18
#: Texts are cut into words in groups of this many characters, and batches into parts of as many bytes of text.
_WORDS_GROUP = 1 << 20
#: A task remembers the ids of this many words of up to this many characters; beyond it, it starts anew.
_REMEMBERED, _LONGEST = 600_000, 64
#: Fixed: the pattern for which words are known to be whole matches; for others, texts go whole.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between characters that aren't white space: no match reaches over the place before it.
_APART = re.compile(r"(?<=\S) (?=\S)")
_CLOSE = re.compile(r"\s \S| \s")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """An encoder and decoder made from one file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each Spark task has one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_characters()
        name = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for t in sorted(ranks, key=ranks.__getitem__):
            merges += [(name[t[:i]], name[t[i:]]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=10_000))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        vocab = self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            tokens[i] = bytes(back[c] for c in s)
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.known = np.array([bool(t) for t in tokens])
        self.decimal = [str(i) for i in range(len(tokens))]
        self.forget()
        self.by_word = pattern == _PATTERN

    def forget(self) -> None:
        """Drop the remembered words."""
        self.slots: dict[str, int] = {}  # by word
        self.kept = np.zeros(0, np.int32)  # ids of the words with a space before them, one after another
        self.ends = np.zeros(0, np.int64)  # of each word in ``kept``

    def encode(self, texts: list[str | None], offsets: bool = False) -> Iterator[tuple[list[int], list[tuple[int, int]] | None]]:
        """Ids of each text, and if asked for the characters [from, to) that each id covers."""
        if offsets:
            for group in _groups(texts, _GROUP):
                for e in self.tokenizer.encode_batch(group, add_special_tokens=False):
                    yield e.ids, e.offsets
        else:
            yield from ((ids.tolist(), None) for ids in self.arrays(texts))

    def arrays(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as int32; null counts as empty."""
        if not self.by_word:
            yield from self._whole(texts)
            return
        for group in _groups(texts, _WORDS_GROUP):
            yield from self._by_word(group)

    def _whole(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for group in _groups(texts, _GROUP):
            for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False):
                yield np.array(e.ids, np.int32)

    def _remember(self, words: list[str]) -> None:
        """Learn the ids of new words, each with a space before it, from joined text."""
        for group in _groups(words, _GROUP):
            joined = " " + " ".join(group)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            reached = np.cumsum(self.at[ids + 1] - self.at[ids])
            sizes = np.cumsum([len(w.encode()) + 1 for w in group])
            last = np.searchsorted(reached, sizes)
            if not np.array_equal(reached[last], sizes):
                raise ValueError("a token reaches over a word's end")
            self.slots.update(zip(group, range(len(self.slots), len(self.slots) + len(group)), strict=True))
            self.ends = np.concatenate([self.ends, len(self.kept) + last + 1])
            self.kept = np.concatenate([self.kept, ids])

    def _by_word(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids by way of the ids of each text's words, each but the first with the space before it."""
        if len(self.slots) > _REMEMBERED:
            self.forget()
        close = [t[:1] == " " or _CLOSE.search(t) is not None for t in texts]
        plain = pc.split_pattern(pa.array([t for t, c in zip(texts, close, strict=True) if not c], pa.large_string()), " ")
        other = pa.array([_APART.split(t) for t, c in zip(texts, close, strict=True) if c], plain.type)
        place = np.empty(len(texts), np.int64)
        place[np.argsort(close, kind="stable")] = np.arange(len(texts))
        lists = pa.concat_arrays([plain, other])
        words, at = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        later = np.ones(len(words), bool)
        later[at[:-1]] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        # Words that a space after them might change, and long ones, go apart, as the first ones do.
        apart = {w for w in distinct if not w or len(w) > _LONGEST or w[-1].isspace()}
        self._remember([w for w in distinct if w not in self.slots and w not in apart])
        alone = words.take(pa.array(at[:-1])).to_pylist()
        pieces = list(dict.fromkeys([*alone, *(" " + w for w in apart)]))
        number = {w: i for i, w in enumerate(pieces, len(self.slots))}
        slots = np.array([number[" " + w] if w in apart else self.slots[w] for w in distinct], np.int64)
        of = np.empty(len(words), np.int64)
        of[later] = slots[coded.indices.to_numpy()]
        of[at[:-1]] = [number[w] for w in alone]
        own = list(self._whole(pieces))
        ids = np.concatenate([self.kept, *own])
        ends = np.concatenate([self.ends, len(self.kept) + np.cumsum([len(x) for x in own], dtype=np.int64)])
        sizes = np.diff(ends, prepend=0)[of]
        reached = np.cumsum(sizes)
        out = ids[np.arange(reached[-1]) + np.repeat(ends[of] - reached, sizes)]
        bounds = np.concatenate([[0], reached])[at]
        for i in place:
            yield out[bounds[i] : bounds[i + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids. Null or unknown ids raise ValueError."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        start, size = self.at[ids], self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(size)
        return self.table[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes()


def _groups(texts: list[str | None], size: int) -> Iterator[list[str]]:
    """Texts in their order, null as empty, in groups that end when they reach ``size`` characters."""
    group, held = [], 0
    for t in texts:
        group.append(t or "")
        held += len(group[-1])
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows of batches in their order, in batches of about ``_WORDS_GROUP`` bytes of text at most, one row at least."""
    for b in batches:
        ends, i = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(), dtype=np.int64), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _WORDS_GROUP, "right")))
            yield b.slice(i, j - i)
            i = j


def _coded(batches: Iterator[pa.RecordBatch], column: int, path: str, pattern: str) -> Iterator[tuple[Codec, pa.RecordBatch, list[str | None], list[np.ndarray]]]:
    """(codec, part of a batch, its texts, their ids); after the last, the words that the worker remembers are dropped."""
    c = codec(path, pattern)
    try:
        for b in _parts(batches, column):
            texts = b.column(column).to_pylist()
            yield c, b, texts, list(c.arrays(texts))
    finally:
        c.forget()


def _map(df: DataFrame, fields: list[T.StructField], of: str, run, end=lambda: None) -> DataFrame:
    """``df`` with new columns that ``run`` makes from the column ``of`` of each batch; ``end`` is called after the last."""
    new = {f.name for f in fields}
    old = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in df.schema.fields]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in it:
                made = run(b.column(names.index(of)))
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(f.name)) for f in old), *made], names=[*(f.name for f in old), *(f.name for f in fields)])
        finally:
            end()

    return df.mapInArrow(lean(batches), T.StructType([*old, *fields]))


def encode(df: DataFrame, *, path: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``token_ids`` array<int> and ``n_tokens`` long of every whole text.

    Null counts as empty and has no tokens. With ``offsets``, ``token_spans`` has the characters
    [start, end) each token touches; tokens that split a character share its span. Columns of these
    names are replaced, others pass through.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(column: pa.Array) -> list[pa.Array]:
        c, spans = codec(path, pattern), []
        if offsets:
            both = list(c.encode(column.to_pylist(), True))
            every, spans = [np.array(ids, np.int32) for ids, _ in both], [own for _, own in both]
        else:
            every = list(c.arrays(column.to_pylist()))
        sizes = [len(ids) for ids in every]
        flat = np.concatenate([*every, np.zeros(0, np.int32)])
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        out = [pa.ListArray.from_arrays(at, pa.array(flat)), pa.array(sizes, pa.int64())]
        if offsets:
            out.append(pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], kind))
        return out

    return _map(df, fields + [T.StructField("token_spans", span)] * offsets, text_col, run, lambda: codec(path, pattern).forget())


def decode(df: DataFrame, *, path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded`` binary, the bytes of ``token_ids``, and ``decoded_text`` string.

    A null list gives nulls. Bytes that aren't UTF-8 are U+FFFD in ``decoded_text`` alone.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        c = codec(path, pattern)
        got = [None if ids is None else c.decode(np.asarray(ids, np.int64)) for ids in column.to_pylist()]
        return [pa.array(got, pa.binary()), pa.array([None if g is None else g.decode("utf-8", "replace") for g in got], pa.string())]

    return _map(df, [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())], ids_col, run)


def encode_checked(df: DataFrame, *, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The other columns with ``token_ids``, ``n_tokens`` and ``round_trip``: whether the ids decode to
    the text's bytes, in place of the text. Null counts as empty."""
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    keep = [f for f in df.schema.fields if f.name != text_col and f.name not in {x.name for x in fields}]
    names = [f.name for f in df.schema.fields]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, b, texts, ids in _coded(it, names.index(text_col), path, pattern):
            same = [c.decode(x.astype(np.int64)) == (t or "").encode() for x, t in zip(ids, texts, strict=True)]
            sizes = [len(x) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(f.name)) for f in keep), lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], names=[*(f.name for f in keep), *(f.name for f in fields)])

    return df.mapInArrow(lean(batches), T.StructType([*keep, *fields]))


def digests(df: DataFrame, *, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and return the other columns with ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` in place of the text, in one pass over Arrow batches."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    keep = [f for f in df.schema.fields if f.name != text_col and f.name not in {x.name for x in fields}]
    names = [f.name for f in df.schema.fields]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, b, _, every in _coded(it, names.index(text_col), path, pattern):
            n, ids_hex, bytes_hex = [], [], []
            for ids in every:
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(c.decode(ids.astype(np.int64))).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(f.name)) for f in keep), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())], names=[*(f.name for f in keep), *(f.name for f in fields)])

    return df.mapInArrow(lean(batches), T.StructType([*keep, *fields]))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of what the ids decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return digests(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
