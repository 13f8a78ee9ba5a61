"""Benchmark decontamination: every passage of every document is a query against the test items.

The test items are the indexed side. Terms are words of letters, marks and digits in lower case, on both
sides, so signs glued to a word don't count; items of signs alone are compared by words between white
space. An item's weight for a term is BM25's. Weights are divided by the item's own threshold, ``share`` of the score of its own text, so
1 is the threshold of all items. Items stand in blocks of ``BLOCK`` by length, and the index keeps the
largest weight of each term in each block.

A document is cut into passages of 2 H words, H apart, H the longest item's words, so an item that
a document holds lies whole in one passage. As in block-max WAND, the sum of a passage's block
maxima bounds the score of every item of the block; only blocks whose bound reaches 1 are scored,
exactly, and every item at 1 or more is retrieved. A retrieved item is verified: the shares of
the 5-word shingles of its question and of its answer that the passage holds must both reach
``overlap``. An altered word takes five shingles, all that a short part has; so a part of under 14 words
may also reach it by shorter shingles, of which an altered word takes half at most, within the place beside the
other part where an item so aligned has it. The question is the first line, the answer the rest; an item of one line parts in the middle.

Items go through in groups of ``GROUP``, sorted by length, a broadcast index and a pass over the
documents each, so a benchmark of any size keeps memory bounded. No pass shuffles documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import pieces, shingle_hashes, text_bytes, word_hashes

BLOCK = 8
GROUP = 1000
#: Fixed: BM25's constants.
K1, B = 1.2, 0.75
SHINGLE = 5
#: Words by which a short part may lie off its place: on the item's outer sides, and toward the other part.
OUTER, INNER = 5, 2


def _plain(column: pa.Array) -> pa.Array:
    """Lower case, with one space for each run of anything but letters, marks and digits."""
    return pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string())), r"[^\pL\pM\pN ]+", " ")


def _words(text: str, signs: bool = False) -> np.ndarray:
    raw = np.frombuffer((text if signs else _plain(pa.array([text]))[0].as_py()).encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, np.array([0, len(words)]), n)[0])


class Part:
    """A part's shingles of five words or, if it is shorter, its words as one; and its shorter shingles by place."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.n = min(SHINGLE, len(words))
        self.shingles = _shingles(words, max(1, self.n))
        self.short = min(SHINGLE, max(1, (len(words) + 1) // 3))
        own = shingle_hashes(words, np.array([0, len(words)]), self.short)[0] if len(words) else words
        self.own, self.offset = np.unique(own, return_index=True)

    def hits(self, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``span`` of the part's short shingles, and which ones."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = shingle_hashes(span, np.array([0, len(span)]), self.short)[0]
        which = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        at = np.flatnonzero(self.own[which] == h)
        return at, which[at]


def aligned_shares(span: np.ndarray, parts: tuple[Part, Part], shares: list[float]) -> list[float]:
    """``shares`` with those of parts under 14 words by short shingles, for the place of the item that suits both best.

    Places are those at which the part with the longer shingles has one. If both parts are under five
    words, the item is one part.
    """
    if max(p.short for p in parts) == 1:
        whole = Part(np.concatenate([p.words for p in parts]))
        if whole.short == 1:
            return shares
        return [max(aligned_shares(span, (whole, Part(whole.words[:0])), [0.0, 1.0])[0], x) for x in shares]
    hits = [p.hits(span) for p in parts]
    main = 0 if parts[0].short >= parts[1].short else 1
    at, which = hits[main]
    size = len(parts[0].words)
    best = shares
    for start in np.unique(at - parts[main].offset[which] - main * size).tolist():
        limits = ((start - OUTER, start + size + INNER), (start + size - INNER, start + size + len(parts[1].words) + OUTER))
        new = []
        for part, (p, k), (low, high), share in zip(parts, hits, limits, shares, strict=True):
            if part.short < SHINGLE and len(part.words):
                share = max(share, len(np.unique(k[(p >= low) & (p + part.short <= high)])) / len(part.own))
            new.append(share)
        best = max(best, new, key=min)
    return best


def question_answer(text: str, signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of both parts."""
    first, _, rest = text.strip().partition("\n")
    if rest.strip():
        return _words(first, signs), _words(rest, signs)
    words = _words(text, signs)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


class ItemIndex:
    """The index of one group of items, (id, text) sorted by length."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean: float, share: float, signs: bool = False) -> None:
        words = [_words(t, signs) for _, t in items]
        self.signs = signs
        self.ids = [i for i, _ in items]
        self.half = max(32, max(map(len, words)))
        self.terms = np.unique(np.concatenate(words))
        n_blocks = -(-len(items) // BLOCK)
        self.weights = np.zeros((n_blocks, len(self.terms), BLOCK), np.float32)
        self.parts = []
        for k, (w, (_, text)) in enumerate(zip(words, items, strict=True)):
            own, tf = np.unique(w, return_counts=True)
            df = np.array([frequency[int(t)] for t in own])
            idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            self.weights[k // BLOCK, np.searchsorted(self.terms, own), k % BLOCK] = weight / (share * weight.sum())
            question, answer = question_answer(text, signs)
            self.parts.append((Part(question), Part(answer)))
        self.best = np.ascontiguousarray(self.weights.max(2).T)  # a row for each term
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.terms & np.uint64((1 << 18) - 1)] = True

    def _known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their terms' numbers."""
        at = np.flatnonzero(self.maybe[words & np.uint64((1 << 18) - 1)])
        t = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        same = self.terms[t] == words[at]
        return at[same], t[same]

    def search(self, words: np.ndarray, at: np.ndarray, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item's place, score, question's overlap, answer's overlap) of verified items in texts."""
        count = np.diff(at)
        halves = -(-count // self.half)
        first = np.concatenate([[0], np.cumsum(halves)])
        place, term = self._known(words)
        text = np.searchsorted(at, place, "right") - 1
        half = first[text] + (place - at[text]) // self.half
        both = np.unique(half * len(self.terms) + term)
        half, term = both // len(self.terms), both % len(self.terms)
        start = np.searchsorted(half, np.arange(first[-1] + 1))
        bound = np.zeros((first[-1] + 1, self.best.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(start))
        for k in range(0, len(some), 4096):
            own = some[k : k + 4096]
            a, b = start[own[0]], start[own[-1] + 1]
            bound[own] = np.add.reduceat(self.best[term[a:b]], start[own] - a, axis=0)
        # A passage is a half and the next of the same text, if there is one.
        follows = np.ones(first[-1], bool)
        follows[first[1:][halves > 0] - 1] = False
        reach = bound[:-1] + np.where(follows[:, None], bound[1:], 0)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        passages, blocks = np.nonzero(reach >= 0.9999)
        shingles: dict[tuple[int, int], np.ndarray] = {}
        for p, blk in zip(passages.tolist(), blocks.tolist(), strict=True):
            upto = p + 2 if follows[p] else p + 1
            own = np.unique(term[start[p] : start[upto]])
            scores = self.weights[blk, own].sum(0, dtype=np.float64)
            for j in np.flatnonzero(scores >= 0.99999):
                item = blk * BLOCK + int(j)
                t = int(np.searchsorted(first, p, "right")) - 1
                a = at[t] + (p - first[t]) * self.half
                span = words[a : min(at[t + 1], a + 2 * self.half)]
                shares = []
                for part in self.parts[item]:
                    if not part.n:
                        shares.append(1.0)
                        continue
                    if (p, part.n) not in shingles:
                        shingles[p, part.n] = _shingles(span, part.n)
                    shares.append(float(np.isin(part.shingles, shingles[p, part.n]).mean()))
                if min(shares) < overlap:
                    shares = aligned_shares(span, self.parts[item], shares)
                if min(shares) >= overlap and (float(scores[j]), *shares) > found.get((t, item), (0.0, 0.0, 0.0)):
                    found[t, item] = (float(scores[j]), *shares)
        for (t, item), x in found.items():
            yield t, item, *x


def build(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", share: float = 0.5) -> Iterator[ItemIndex]:
    """The indexes of all groups of items. Items without words are left out; repeated items stay.

    Term statistics cover all items: they come to the driver with the items, which a benchmark's size bounds.
    """
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(r"t rlike '[^ \\t\\n\\r\\f\\x0B]'")
    rows = rows.orderBy(F.length("t"), "i", "t")
    frequency: dict[int, int] = {}
    n = total = 0
    for r in rows.toLocalIterator():
        w = _words(r["t"])
        w = w if len(w) else _words(r["t"], True)
        n, total = n + 1, total + len(w)
        for t in set(w.tolist()):
            frequency[t] = frequency.get(t, 0) + 1
    groups: dict[bool, list[tuple[int, str]]] = {False: [], True: []}
    for r in rows.toLocalIterator():
        signs = not len(_words(r["t"]))
        groups[signs].append((r["i"], r["t"]))
        if len(groups[signs]) == GROUP:
            yield ItemIndex(groups[signs], frequency, n, total / n, share, signs)
            groups[signs] = []
    for signs, group in groups.items():
        if group:
            yield ItemIndex(group, frequency, n, total / n, share, signs)


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap`` of every verified pair, once.

    ``score`` is the passage's score as a multiple of the item's threshold, the best of the
    document's passages. Documents without words and items without words have no pairs; without
    items the result is empty. Repeated rows give repeated pairs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def one(index: ItemIndex) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                made = []
                for i, words, at in _pieces(batch.column(1), own.signs):
                    made += [(i + t, own.ids[k], *x) for t, k, *x in own.search(words, at, overlap)]
                if made:
                    at, ids, *rest = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), *(pa.array(c, pa.float64()) for c in rest)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(run, schema)

    found = [one(index) for index in build(items, share=share)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def remove(docs: DataFrame, items: DataFrame, *, text_col: str = "text", share: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """``docs`` without the documents that hold a verified item; all columns pass through, nothing shuffles."""
    names = docs.columns

    def one(df: DataFrame, index: ItemIndex) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, words, at in _pieces(batch.column(names.index(text_col)), own.signs):
                    clean[[i + t for t, *_ in own.search(words, at, overlap)]] = False
                yield batch.filter(pa.array(clean))

        return df.mapInArrow(run, docs.schema)

    return reduce(one, build(items, share=share), docs)


def _pieces(column: pa.Array, signs: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, at = text_bytes(column if signs else _plain(column))
    for i, _, r, a in pieces(raw, at):
        words, word_at = word_hashes(r, a)
        if len(words):
            yield i, words, word_at


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
