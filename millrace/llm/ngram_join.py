"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of num / den or more.

1. Sets. Every text becomes a set of 64-bit shingle hashes. A row keeps the set's 128-bit signature, a
   bitmap of about two to four bits an element, and the set's prefix. Equal sets become one.
2. Prefixes. Under one order of all shingles, two sets that are similar enough share an element among
   the first n - ceil(t n) + 1 of each. The order puts the shingles that are frequent in the
   corpus last, so prefixes hold rare ones; any order gives the same links.
3. Tiles. Sets that share a prefix element are compared in tiles, banded by size: a tile holds sets
   whose sizes allow the similarity, up to ``TILE`` on a side. Bit counts of two bitmaps bound the
   overlap from above: every bit of one that the other lacks is an element that isn't shared.
   A tile returns a spanning forest of the pairs that pass, never all of them.
4. Exact step. Sets that the forests connect are gathered again in tiles and verified by the
   intersection of their sorted arrays; again a tile returns a spanning forest, now of links.
   Components of those links are the result.

A tile starts from one set and goes on with those it links, each time looking only at the sets not
reached yet, so a group of thousands of near copies costs about one comparison for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .scratch import materialise
from .wordhash import pieces, shingle_hashes, text_bytes, word_hashes

#: At most this many shingles are put last in the order; the broadcast list has 8 bytes for each.
FREQUENT = 20_000
#: Sets on one side of a tile.
TILE = 4096
#: Tiles of this many sets or fewer are compared one pair at a time.
SMALL = 12
#: Elements on one side of an exact tile, but for one set that alone has more.
EXACT = 2_000_000


def _texts(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, offsets) of pieces of a batch whose second column is the text."""
    raw, at = text_bytes(batch.column(1))
    for i, _, r, a in pieces(raw, at):
        words, word_at = word_hashes(r, a)
        yield i, *shingle_hashes(words, word_at, n)


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of shingles frequent in the corpus, ``FREQUENT`` at most.

    Counts cover all documents; a task leaves out what it meets once in a piece of text. Only the
    order of shingles depends on this, no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(1 << 62)  # prefixes are the lowest hashes
        for batch in batches:
            for _, h, _ in _texts(batch, n):
                h, count = np.unique(h[h < low], return_counts=True)
                some = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(count[some])], names=["h", "n"])

    counts = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 3")
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def _bitmap(elements: np.ndarray, bits: int) -> np.ndarray:
    mask = np.zeros(bits, bool)
    mask[(elements >> np.uint64(20)) & np.uint64(bits - 1)] = True
    return np.packbits(mask, bitorder="little").view(np.uint64)


def _bits_for(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def shingle_sets(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """``doc_id``, ``n``, ``sig_a``, ``sig_b``, ``prefix`` array<long>, ``packed`` binary of each row of (id, text)."""
    last = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = last.value
        for batch in batches:
            for i, h, at in _texts(batch, n):
                size, sig, prefix, bits = [], [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = np.unique(h[a:b])
                    k = len(own)
                    size.append(k)
                    sig.append((int(own.sum(dtype=np.uint64).view(np.int64)), int((own * own * np.uint64(0x9E3779B97F4A7C15) ^ own).sum(dtype=np.uint64).view(np.int64))))
                    bits.append(k.to_bytes(8, "little") + _bitmap(own, _bits_for(k)).tobytes())
                    if len(late) and k:
                        is_late = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
                        own = np.concatenate([own[~is_late], own[is_late]])
                    prefix.append(own[: k - (k * num + den - 1) // den + 1 if k else 0].view(np.int64))
                sizes = np.array([len(p) for p in prefix])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(size)), pa.array(size, pa.int64()), pa.array([s for s, _ in sig], pa.int64()), pa.array([s for _, s in sig], pa.int64()), lists, pa.array(bits, pa.binary())], names=["doc_id", "n", "sig_a", "sig_b", "prefix", "packed"])

    return docs.mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, prefix array<long>, packed binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, values) of runs of rows that are equal in ``keys``, of batches in which they are adjacent."""
    ids: list[np.ndarray] = []
    values: list[bytes] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        own_ids, own_values = batch.column("id").to_numpy(), batch.column(value).to_pylist()
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(at[:-1], at[1:], strict=True):
            # A run may go on from the batch before; runs inside a batch differ.
            if i or tuple(c[0] for c in cols) != now:
                if ids:
                    yield np.concatenate(ids) if len(ids) > 1 else ids[0], values
                ids, values = [], []
            ids.append(own_ids[i:j])
            values += own_values[i:j]
        now = tuple(c[-1] for c in cols)
    if ids:
        yield np.concatenate(ids) if len(ids) > 1 else ids[0], values


def _edges(made: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Pairs of ids as batches."""
    while some := list(islice(made, 10_000)):
        a, b = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def spanning_forest(size: np.ndarray, passes: Callable[[int, np.ndarray], np.ndarray], num: int, den: int) -> Iterator[tuple[int, int]]:
    """(root, member) places of a forest that spans the links of a tile.

    ``size`` is sorted. ``passes(i, js)`` is true where i and j are linked. Only places whose sizes
    allow the similarity are asked for, and only those not reached yet.
    """
    left = np.ones(len(size), bool)
    for root in range(len(size)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            i = front.pop()
            a = np.searchsorted(size, -(-size[i] * num // den), "left")
            b = np.searchsorted(size, size[i] * den // num, "right")
            js = np.flatnonzero(left[a:b]) + a
            if len(js):
                for j in js[passes(i, js)]:
                    left[j] = False
                    front.append(int(j))
                    yield root, int(j)


class _Bitmaps:
    """Bitmaps of a tile, and the bound of their bit counts."""

    def __init__(self, size: np.ndarray, bits: list[bytes], num: int, den: int) -> None:
        self.size, self.num, self.den = size, num, den
        self.width = np.array([len(b) // 8 for b in bits])
        self.level, self.place = {}, np.zeros(len(bits), np.int64)
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.level[int(w)] = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(-1, w)

    @staticmethod
    def _folded(rows: np.ndarray, w: int) -> np.ndarray:
        while rows.shape[-1] > w:
            half = rows.shape[-1] // 2
            rows = rows[..., :half] | rows[..., half:]
        return rows

    def passes(self, i: int, js: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(js), bool)
        mine = self.level[int(self.width[i])][self.place[i]]
        for w in np.unique(self.width[js]):
            own = np.flatnonzero(self.width[js] == w)
            least = int(min(w, self.width[i]))
            for k in range(0, len(own), 1024):
                at = js[own[k : k + 1024]]
                theirs = self._folded(self.level[int(w)][self.place[at]], least)
                x = self._folded(mine, least)
                only_x = np.bitwise_count(x & ~theirs).sum(1, dtype=np.int64)
                only_y = np.bitwise_count(theirs & ~x).sum(1, dtype=np.int64)
                most = np.minimum(self.size[i] - only_x, self.size[at] - only_y)
                ok[own[k : k + 1024]] = most * (self.num + self.den) >= self.num * (self.size[i] + self.size[at])
        return ok


def _small_forest(size: list[int], bits: list[bytes], num: int, den: int) -> Iterator[tuple[int, int]]:
    """The forest of a few sets by the same bound, with whole numbers for bitmaps."""
    maps = [int.from_bytes(b, "little") for b in bits]
    left = set(range(len(size)))
    while left:
        root = min(left)
        left.remove(root)
        front = [root]
        while front and left:
            i = front.pop()
            for j in sorted(left):
                lo, hi = sorted((size[i], size[j]))
                if lo * den < hi * num:
                    continue
                x, y = maps[i], maps[j]
                w, v = len(bits[i]) * 8, len(bits[j]) * 8
                while w > v:
                    w //= 2
                    x = (x >> w) | (x & ((1 << w) - 1))
                while v > w:
                    v //= 2
                    y = (y >> v) | (y & ((1 << v) - 1))
                most = min(size[i] - (x & ~y).bit_count(), size[j] - (y & ~x).bit_count())
                if most * (num + den) >= num * (size[i] + size[j]):
                    left.remove(j)
                    front.append(j)
                    yield root, j


def _tiles(rows: DataFrame, key: str, weight, most: int, num: int, den: int) -> DataFrame:
    """``rows`` with ``tile_i`` and ``tile_j``, repeated for each tile that a row belongs to.

    A key's rows in order of size ``n`` fall into blocks of weight ``most``. Tiles are pairs of
    blocks that hold sizes near enough; a key with one block has one tile, so only large groups repeat rows.
    """
    order = Window.partitionBy(key).orderBy("n", "id")
    rows = rows.withColumn("blk", F.floor((F.sum(weight).over(order) - weight) / most).cast("int"))
    # The last block in reach: the largest block among sizes up to n * den / num, on a log scale.
    scale = 1e6
    rows = rows.withColumn("lg", F.floor(F.log("n") * scale).cast("long"))
    reach = Window.partitionBy(key).orderBy("lg").rangeBetween(0, int(log(den / num) * scale) + 2)
    back = Window.partitionBy(key).orderBy("lg").rangeBetween(-int(log(den / num) * scale) - 2, 0)
    rows = rows.withColumns({"hi": F.max("blk").over(reach), "lo": F.min("blk").over(back)})
    pair = F.transform(F.sequence("lo", "hi"), lambda k: F.struct(F.least(k, F.col("blk")).alias("i"), F.greatest(k, F.col("blk")).alias("j")))
    return rows.withColumn("tile", F.explode(pair)).withColumns({"tile_i": F.col("tile.i"), "tile_j": F.col("tile.j")}).drop("blk", "lg", "hi", "lo", "tile")


def candidate_edges(reps: DataFrame, num: int, den: int) -> DataFrame:
    """``a``, ``b``: forests over sets that share a prefix element and whose bitmaps allow the similarity.

    ``reps`` has ``id``, ``n``, ``prefix``, and ``packed``: the size in 8 bytes and the bitmap.
    """
    rows = reps.select("id", "n", F.explode("prefix").alias("key"))
    by = Window.partitionBy("key").orderBy("n", "id")
    near = (F.lag("n").over(by) * den >= F.col("n") * num) | (F.lead("n").over(by) * num <= F.col("n") * den)
    rows = rows.withColumn("near", near).where("near").drop("near")
    rows = materialise(rows, "join-rows")
    tiled = _tiles(rows, "key", F.lit(1), TILE, num, den).join(reps.select("id", "packed"), "id")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for ids, packed in _groups(batches, ["key", "tile_i", "tile_j"], "packed"):
            if len(ids) == 1:
                continue
            # The size stands before the bitmap, so a row has one binary.
            size = np.array([int.from_bytes(p[:8], "little") for p in packed])
            bits = [p[8:] for p in packed]
            if len(ids) <= SMALL:
                made = _small_forest(size.tolist(), bits, num, den)
            else:
                order = np.lexsort((ids, size))
                ids, size = ids[order], size[order]
                made = spanning_forest(size, _Bitmaps(size, [bits[i] for i in order], num, den).passes, num, den)
            for i, j in made:
                yield int(ids[i]), int(ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(forests(batches))

    tiled = tiled.select("key", "tile_i", "tile_j", "id", "packed").repartition("key", "tile_i", "tile_j").sortWithinPartitions("key", "tile_i", "tile_j")
    return tiled.mapInArrow(run, "a long, b long")


def exact_edges(docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``a``, ``b``: forests over links among the sets of one ``root``; ``members`` has ``id``, ``n``, ``root``."""
    tiled = _tiles(members, "root", F.col("n"), EXACT, num, den)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h, at in _texts(batch, n):
                own = [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(own)), pa.array(own, pa.binary())], names=["id", "elements"])

    texts = docs.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    full = texts.mapInArrow(sets, "id long, elements binary")
    rows = tiled.join(full, "id").select("root", "tile_i", "tile_j", "id", "elements")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for ids, elements in _groups(batches, ["root", "tile_i", "tile_j"], "elements"):
            own = [np.frombuffer(e, np.uint64) for e in elements]
            size = np.array([len(e) for e in own])
            order = np.lexsort((ids, size))
            ids, size, own = ids[order], size[order], [own[i] for i in order]
            maps = _Bitmaps(size, [_bitmap(e, _bits_for(len(e))).tobytes() for e in own], num, den) if len(own) > SMALL else None

            def passes(i: int, js: np.ndarray) -> np.ndarray:
                ok = maps.passes(i, js) if maps else np.ones(len(js), bool)
                for k in np.flatnonzero(ok):
                    x, y = own[i], own[js[k]]
                    if len(x) > len(y):
                        x, y = y, x
                    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    ok[k] = both * den >= num * (len(x) + len(y) - both)
                return ok

            for i, j in spanning_forest(size, passes, num, den):
                yield int(ids[i]), int(ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(forests(batches))

    rows = rows.repartition("root", "tile_i", "tile_j").sortWithinPartitions("root", "tile_i", "tile_j")
    return rows.mapInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of each row: the least id that links lead to, itself included.

    Two rows are linked when den * intersection >= num * union of their sets of n-word shingles; a text
    with fewer words is one shingle. Rows with null or empty texts, or without words, have an empty
    set and no links. Ids are integers; rows of one id are one document, linked; a null id isn't
    linked and its component is null. An empty table gives an empty table; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(shingle_sets(docs, n, num, den, frequent_shingles(docs, n)), "join-sets")
    linked = sets.where("n > 0 and doc_id is not null")
    classes = materialise(linked.groupBy("sig_a", "sig_b", "n").agg(F.min("doc_id").alias("rep")), "join-classes")
    reps = linked.join(classes, ["sig_a", "sig_b", "n"]).where("doc_id = rep").dropDuplicates(["doc_id", "sig_a", "sig_b"])
    reps = materialise(reps.select(F.col("doc_id").alias("id"), "n", "prefix", "packed"), "join-reps")
    roots = materialise(connected_components(candidate_edges(reps, num, den)), "join-candidates")
    members = roots.withColumnRenamed("node", "id").join(reps.select("id", "n"), "id")
    links = exact_edges(docs, members, n, num, den)
    # Classes of one set that rows of one id hold apart are linked through the id.
    same = linked.select("doc_id", "sig_a", "sig_b", "n").join(classes, ["sig_a", "sig_b", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    again = linked.groupBy("doc_id").agg(F.count_distinct("sig_a", "sig_b").alias("k")).where("k > 1").select(F.col("doc_id").alias("a"))
    links = links.unionByName(same.join(again, "a", "left_semi"))
    found = materialise(connected_components(links), "join-components")
    out = sets.join(classes, ["sig_a", "sig_b", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    out = out.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, one of each; all columns as they are.

    Rows with a null id and rows without links stay. Of repeated ids one row stays, the one with the least text.
    """
    key = F.col(id_col).cast("long")
    found = materialise(jaccard_join(docs, id_col=id_col, text_col=text_col, n=n, num=num, den=den), "join-result")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_mr_id")).distinct()
    rows = docs.withColumn("_mr_id", key).join(gone, "_mr_id", "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("_mr_id"))
    twice = materialise(twice, "join-twice")
    if twice.isEmpty():
        return rows.drop("_mr_id").select(*[F.col(f"`{c}`") for c in docs.columns])
    once = rows.join(twice, "_mr_id", "left_anti")
    number = F.row_number().over(Window.partitionBy("_mr_id").orderBy(F.col(text_col)))
    one = rows.join(twice, "_mr_id", "left_semi").withColumn("_mr_n", number).where("_mr_n = 1").drop("_mr_n")
    return once.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)
