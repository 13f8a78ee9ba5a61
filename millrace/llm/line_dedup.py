"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Lines are the parts of a text between line feeds. Two lines are linked if they are equal, or if the
edits between them (code points inserted, deleted or replaced) are at most the distance that ``BANDS``
gives the shorter one. Components of links are the classes of lines; the first line of a class
stays and the others go. First is a smaller id, then a smaller hash of the document's text, then a smaller line
number. Blank lines stay; lines too short for the first band go for equal ones alone.

1. Equal lines become one by a 128-bit hash, with their first occurrence and count.
2. Sizes fall into classes, four to a doubling. A class has a distance t and cuts t + 1 segments of one
   size. Of t edits one segment i is spared with exactly i - 1 edits before it, so it lies in the other line
   at most i - 1 places off from the line's start, or t + 1 - i from its end, whichever is less. A line is
   indexed under its segments and its substrings at those places: 2 and 5 keys for 1 and 2 edits,
   and once more in the class below if a shorter line of that class may be near.
3. A key's occurrences are counted with their least and largest line. Two lines make a pair; up to
   ``SMALL`` make all their pairs, a bounded number each.
4. In larger groups every line is compared with one hub, the line whose keys are the most popular, and groups that
   links have joined into one are done. What is left is cut into 4 (t + 1) chunks. Of those t + 1 that are the rarest among such lines, the other line
   has one, t places off at most; lines that meet there, are not joined yet, and whose bitmaps of character triples allow the distance make pairs.
5. Pairs must share all but t of their 4 (t + 1) chunks within t places. What lies between their common ends is
   then verified by a banded bit-parallel automaton: one bit for each of the 2 t + 1 diagonals, a
   register for each number of edits, all advanced by one character at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .scratch import materialise

#: (least length, distance): from 10 code points one edit, and so on.
BANDS = ((10, 1), (20, 2))
#: Keys of up to this many lines give all their pairs.
SMALL = 8
_NONE = -(1 << 63)
#: Steps in which common ends are measured.
_STEPS = (4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8)


def _check(bands: tuple[tuple[int, int], ...]) -> None:
    for (least, t), (after, more) in zip(bands, [*bands[1:], (1 << 30, 17)][: len(bands)], strict=True):
        step = 1 << max(0, least.bit_length() - 3)
        if not (0 < t < more and t <= 16 and least < after) or least % step or step < t or least < 4 * (t + 1):
            raise ValueError(f"a band of {t} edits can't start at {least}: lengths and distances ascend, a length has at most three leading bits and is 4 (t + 1) at least, and t at most a quarter of its leading power of two")


def _size_class(n: Column) -> Column:
    """The least size of n's class: n with all but its three leading bits cleared."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(n)) - 3, F.lit(0)))
    return n - n % step


def _by_band(bands: tuple[tuple[int, int], ...], size: Column, what) -> Column:
    """``what(t)`` of the band that a size lies in, null below the first and for null."""
    out = F.when(size >= bands[-1][0], what(bands[-1][1]))
    for least, t in bands[-2::-1]:
        out = out.when(size >= least, what(t))
    return out


def _classes(n: str, bands: tuple[tuple[int, int], ...]) -> tuple[Column, Column]:
    """The size class of a line, and the class below if it holds sizes that may be near, else null."""
    own = _size_class(F.col(n))
    below = _size_class(own - 1)
    return own, F.when(F.col(n) - _by_band(bands, below, F.lit) < own, below)


def _hashes(line: str) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("h2")


def _segment_keys(size: str, bands: tuple[tuple[int, int], ...]) -> Column:
    """array<long> of the keys of a line in the class ``size``, empty below the first band.

    ``wide`` is the line with four bytes for each of its ``n`` code points, so that a segment is found without a walk.
    """

    def keys(t: int) -> Column:
        one = F.call_function("div", F.col(size), F.lit(t + 1)).cast("int")
        out = []
        for i in range(1, t + 2):
            before, after = i - 1, t + 1 - i
            start = one * before if before <= after else F.col("n") - one * (after + 1)
            reach = min(before, after)
            out += [F.xxhash64(F.substr("wide", 4 * (start + s) + 1, 4 * one), F.lit(i), F.col(size)) for s in range(-reach, reach + 1)]
        return F.array(*out)

    return F.coalesce(_by_band(bands, F.col(size), keys), F.array().cast("array<bigint>"))


def lines_of(docs: DataFrame, id_col: str, text_col: str, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """``id``, ``doc``, ``line_no`` from 0, ``h``, ``h2``, ``keys`` of lines with more than white space.

    A line with keys in the class below has a second row for these, whose ``own`` is false.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.explode(F.array(F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.xxhash64(text).alias("doc"), F.split(text, "\n").alias("lines")))).alias("d"))
    rows = rows.select("d.id", "d.doc", F.posexplode("d.lines").alias("line_no", "line"))
    rows = rows.where(F.col("line").rlike(r"[^ \t\r\f\x0B]"))
    places = ["id", "doc", "line_no"]
    if not bands:
        return rows.select(*places, *_hashes("line"), F.lit(True).alias("own"), F.array().cast("array<bigint>").alias("keys"))
    own, below = _classes("n", bands)
    rows = rows.select(*places, *_hashes("line"), F.explode(F.array(F.struct(F.length("line").alias("n"), F.encode("line", "UTF-32").alias("wide")))).alias("c"))
    # Generators, so that what they make is made once for a line and not once for a key.
    rows = rows.select(*places, "h", "h2", "c.n", "c.wide")
    rows = rows.select(*places, "h", "h2", "n", "wide", F.posexplode(F.when(below.isNull(), F.array(own)).otherwise(F.array(own, below))).alias("k", "size"))
    # The lambda keeps this projection out of whole-stage code, where all keys would stand in one method too long for the JIT.
    own_row = F.exists(F.array("k"), lambda k: k == 0)
    return rows.select(*places, "h", "h2", own_row.alias("own"), _segment_keys("size", bands).alias("keys"))


def _texts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """``h`` and ``row``, a struct of ``at``, ``n``, ``t`` (the distance of its band) and ``line``, of ``places`` (h, h2, at)."""
    need = places.groupBy("at.id", "at.doc").agg(F.collect_set("at.line_no").alias("need"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.col(text_col).alias("text")).withColumn("doc", F.xxhash64("text")).join(need, ["id", "doc"])
    rows = rows.select("id", "doc", "need", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.array_contains("need", F.col("line_no")))
    rows = rows.select(F.struct("id", "doc", "line_no").alias("at"), "line", *_hashes("line"))
    rows = rows.dropDuplicates(["h", "h2"]).withColumn("n", F.length("line"))
    return rows.select("h", F.struct("at", "n", _by_band(bands, F.col("n"), F.lit).alias("t"), "line").alias("row"))


def may_be_near() -> Column:
    """Whether all but t of the 4 (t + 1) chunks of the shorter line lie in the longer one, at most t places off; rows are ``s``, ``l``."""
    a, b, t = F.col("s.line"), F.col("l.line"), F.col("s.t")
    m = 4 * (t + 1)
    one = F.greatest((F.col("s.n") / m).cast("int"), F.lit(1))

    def spared(j: Column) -> Column:
        start = one * j
        there = F.substr(b, F.greatest(start - t, F.lit(0)) + 1, one + t + F.least(start, t))
        return there.contains(F.substr(a, start + 1, one))

    return (F.col("l.n") - F.col("s.n") <= t) & (F.size(F.filter(F.sequence(F.lit(0), m - 1), spared)) >= m - t)


def within(a: Column, b: Column, most: int, distance: Column) -> Column:
    """Whether two arrays of characters are within the distance, ``most`` at most, by a banded bit-parallel automaton.

    Bit d + most of register k is set after j characters of b if its first j and a's first j + d
    are within k edits. Needs lengths that differ by ``most`` at most.
    """
    width = 2 * most + 1
    mask = (1 << width) - 1
    names = [f"r{k}" for k in range(most + 1)]
    start = F.struct(*[F.lit(sum(1 << (d + most) for d in range(k + 1))).alias(names[k]) for k in range(most + 1)])

    def equal(c: Column, j: Column) -> Column:
        """The diagonals on which character j of b meets an equal one of a."""
        return reduce(Column.bitwiseOR, [F.when(F.get(a, j + d) == c, F.lit(1 << (d + most))).otherwise(F.lit(0)) for d in range(-most, most + 1)])

    def step(acc: Column, e: Column) -> Column:
        new: list[Column] = []
        for k, name in enumerate(names):
            own = acc[name].bitwiseAND(e)
            if k:
                fewer = acc[names[k - 1]]
                own = own.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(mask))
            new.append(own)
        return F.struct(*[x.alias(n) for x, n in zip(new, names, strict=True)])

    steps = F.transform(b, equal)
    at_end = F.aggregate(steps, start, step, lambda acc: F.get(F.array(*[acc[n] for n in names]), distance))
    return F.call_function("shiftright", at_end, F.size(a) - F.size(b) + most).bitwiseAND(F.lit(1)) == 1


def linked(pairs: DataFrame, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """``a``, ``b``: places of those pairs (``s`` and ``l``, rows of ``_texts``, the shorter first) that are linked."""
    pairs = pairs.where(may_be_near()).withColumns({"x": F.col("s.line"), "y": F.col("l.line"), "m": F.col("s.n"), "k": F.col("l.n"), "p": F.lit(0), "q": F.lit(0)})
    for size in _STEPS:
        same = (F.col("p") + size <= F.col("m")) & (F.substr("x", F.col("p") + 1, F.lit(size)) == F.substr("y", F.col("p") + 1, F.lit(size)))
        pairs = pairs.withColumn("p", F.col("p") + F.when(same, size).otherwise(0))
    for size in _STEPS:
        ends = [F.substr(c, F.col(k) - F.col("q") - size + 1, F.lit(size)) for c, k in (("x", "m"), ("y", "k"))]
        pairs = pairs.withColumn("q", F.col("q") + F.when((F.col("p") + F.col("q") + size <= F.col("m")) & (ends[0] == ends[1]), size).otherwise(0))
    inner = [F.substr(c, F.col("p") + 1, F.col(k) - F.col("p") - F.col("q")) for c, k in (("x", "m"), ("y", "k"))]
    pairs = pairs.select(F.col("s.at").alias("a"), F.col("l.at").alias("b"), F.col("s.t").alias("t"), inner[0].alias("x"), inner[1].alias("y"))
    # Out of a generator: a filter on split() itself would move into it and split for every character.
    pairs = pairs.withColumn("c", F.explode(F.array(F.struct(F.split("x", "").alias("x"), F.split("y", "").alias("y")))))
    return pairs.where(within(F.col("c.x"), F.col("c.y"), bands[-1][1], F.col("t"))).select("a", "b")


def _with_texts(pairs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Pairs ``a``, ``b`` of ``key`` as the rows ``s``, the shorter (then the earlier) line, and ``l``."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col(key).alias(side), F.col("row").alias(f"{side}_row")), side)
    order = [F.struct(F.col(f"{c}.n"), F.col(f"{c}.at")) for c in ("a_row", "b_row")]
    both = [F.struct(F.col(x).alias("s"), F.col(y).alias("l")) for x, y in (("a_row", "b_row"), ("b_row", "a_row"))]
    # Out of a generator, so that the order is found once for a pair.
    return pairs.select(F.explode(F.array(F.when(order[0] < order[1], both[0]).otherwise(both[1]))).alias("p")).select("p.s", "p.l")


def _hub_pairs(members: DataFrame, most: int) -> DataFrame:
    """Pairs ``a``, ``b`` of each key's lines with its hub, the line whose keys have the most lines, if their sizes differ by ``most`` or less.

    ``members`` has ``key``, ``at``, ``n``, ``times``.
    """
    fame = members.groupBy("at").agg(F.sum("times").alias("fame"))
    hubs = members.join(fame, "at").groupBy("key").agg(F.max(F.struct("fame", "at", "n")).alias("hub"))
    rows = members.join(hubs, "key").where(F.abs(F.col("n") - F.col("hub.n")) <= most).select("at", F.col("hub.at").alias("hub")).where("at <> hub")
    return rows.select(F.least("at", "hub").alias("a"), F.greatest("at", "hub").alias("b")).distinct()


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``at``, ``label`` of the lines of those keys (``key``, ``at``) whose lines ``links`` don't join into one."""
    labels = connected_components(links).withColumnRenamed("node", "at")
    members = members.join(labels, "at", "left").select("key", "at", F.coalesce("root", "at").alias("label"))
    members = materialise(members, "line-large")
    open_keys = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return members.join(open_keys, "key", "left_semi").select("at", "label").distinct()


#: Longs of a line's bitmap of character triples.
_LONGS = 32


def _bitmaps(lines: DataFrame) -> DataFrame:
    """``at`` and ``m``, an array of ``_LONGS`` longs whose bits tell if an odd number of all triples of adjacent characters hash to them.

    Unlike bits that are set, those that are turned over keep telling lines apart however long these are.
    """
    rows = lines.select("at", "n", F.encode("line", "UTF-32").alias("wide")).select("at", "wide", F.explode(F.sequence(F.lit(0), F.col("n") - 3)).alias("i"))
    rows = rows.select("at", F.pmod(F.xxhash64(F.substr("wide", 4 * F.col("i") + 1, F.lit(12))), F.lit(64 * _LONGS)).cast("int").alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x") % 64)
    slots = [F.bit_xor(F.when((F.col("x") / 64).cast("int") == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(_LONGS)]
    return rows.groupBy("at").agg(*slots).select("at", F.array(*[f"m{k}" for k in range(_LONGS)]).alias("m"))


def _rare_links(lines: DataFrame, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """Links between lines of different labels; ``lines`` has ``at``, ``label``, ``n``, ``line``, ``row``.

    A shorter line is found by one of its t + 1 rarest chunks. Chunks of the first half are placed from the start, the others from the end.
    """
    own, below = _classes("n", bands)
    rows = lines.select("at", "label", "n", F.encode("line", "UTF-32").alias("wide")).withColumn("size", F.explode(F.filter(F.array(own, below), lambda c: c.isNotNull())))
    rows = rows.withColumn("t", _by_band(bands, F.col("size"), F.lit)).where("t is not null").withColumn("one", (F.col("size") / (4 * (F.col("t") + 1))).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), 4 * F.col("t") + 3)))
    start = F.when(F.col("j") < 2 * (F.col("t") + 1), F.col("j") * F.col("one")).otherwise(F.col("n") - (4 * (F.col("t") + 1) - F.col("j")) * F.col("one"))
    rows = rows.withColumn("start", start)

    def key(of: Column) -> Column:
        return F.xxhash64(F.substr("wide", 4 * of + 1, 4 * F.col("one")), F.col("j"), F.col("size"))

    chunks = rows.where(F.col("size") == own).select("at", "label", "n", "t", "j", key(F.col("start")).alias("key"))
    rare = F.row_number().over(Window.partitionBy("at").orderBy("times", "j"))
    times = chunks.groupBy("key").agg(F.count("*").alias("times"))
    index = chunks.join(times, "key").withColumn("rank", rare).where("rank <= t + 1").select("key", F.col("at").alias("s_at"))
    index = materialise(index, "line-rare")
    probes = rows.withColumn("off", F.explode(F.sequence(-F.col("t"), F.col("t")))).withColumn("from", F.col("start") + F.col("off"))
    probes = probes.where((F.col("from") >= 0) & (F.col("from") + F.col("one") <= F.col("n"))).select(key(F.col("from")).alias("key"), F.col("at").alias("l_at"))
    probes = probes.join(index.select("key").distinct(), "key", "left_semi").distinct()
    maps = materialise(lines.select("at", "label", "n", "t").join(_bitmaps(lines), "at"), "line-bitmaps")
    # A longer line has one of t + 1 lengths, so lines meet by chunk and length.
    left = index.join(maps.withColumnRenamed("at", "s_at"), "s_at").select("key", "s_at", F.col("label").alias("s_label"), "t", F.explode(F.sequence("n", F.col("n") + F.col("t"))).alias("n"), *[F.col("m")[k].alias(f"s{k}") for k in range(_LONGS)])
    right = probes.join(maps.withColumnRenamed("at", "l_at"), "l_at").select("key", "l_at", F.col("label").alias("l_label"), "n", *[F.col("m")[k].alias(f"l{k}") for k in range(_LONGS)])
    # An edit takes away three triples and adds three at most, and each turns one bit over.
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"l{k}"))) for k in range(_LONGS)])
    on = [F.col("x.key") == F.col("y.key"), F.col("x.n") == F.col("y.n"), differ <= 6 * F.col("x.t"), F.col("s_label") != F.col("l_label")]
    pairs = left.alias("x").join(right.alias("y"), reduce(Column.__and__, on))
    pairs = pairs.select(F.least("s_at", "l_at").alias("a"), F.greatest("s_at", "l_at").alias("b")).distinct()
    return linked(_with_texts(pairs, lines.select("at", "row"), "at"), bands)


def candidates(keyed: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a``, ``b`` of lines that share a key, and ``key``, ``h``, ``times`` of the lines of keys that over ``SMALL`` share.

    ``repeated`` has ``h``, ``n`` of the lines that occur more than once. Rows here are hashes; no text moves.
    """
    keyed = keyed.select(F.explode("keys").alias("key"), "h")
    groups = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("times")).where("a <> b")
    # A group has two lines and no more if their occurrences are all that it has.
    for side in ("a", "b"):
        groups = groups.join(repeated.select(F.col("h").alias(side), F.col("n").alias(f"n_{side}")), side, "left")
    two = F.col("times") == F.coalesce("n_a", F.lit(1)) + F.coalesce("n_b", F.lit(1))
    groups = materialise(groups.select("key", "a", "b", two.alias("two")), "line-groups")
    more = materialise(groups.where("not two").select("key"), "line-more")
    members = keyed.join(more, "key", "left_semi").distinct()
    times = members.groupBy("key").agg(F.count("*").alias("times"))
    members = materialise(members.join(times, "key"), "line-members")
    small = members.where(F.col("times") <= SMALL).groupBy("key").agg(F.collect_set("h").alias("s"))
    small = small.select(F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    pairs = materialise(groups.where("two").select("a", "b").unionByName(small).distinct(), "line-pairs")
    return pairs, members.where(F.col("times") > SMALL)


def near_links(pairs: DataFrame, large: DataFrame, texts: DataFrame, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """``a``, ``b``: places of linked lines, whose components are those of all links."""
    large = large.join(texts.select("h", "row.at", "row.n"), "h")
    # Lines of one 64-bit hash and different texts, if any, are all tried.
    links = linked(_with_texts(pairs, texts, "h").unionByName(_with_texts(_hub_pairs(large, bands[-1][1]), texts, "row.at")), bands)
    links = materialise(links.distinct(), "line-links")
    rest = materialise(_unsettled(large.select("key", "at"), links).join(texts.select("row.at", "row.n", "row.t", "row.line", "row"), "at"), "line-rest")
    if rest.isEmpty():
        return links
    return links.unionByName(materialise(_rare_links(rest, bands), "line-rare-links"))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """``id``, ``doc``, ``line_no``, ``h``, ``near``, ``of_id``, ``of_line``: every line that goes, and the first line of its class.

    ``near`` is false if an equal line occurs earlier. ``doc`` is the text's xxhash64. Null ids stand
    before all others, as the least long. Rows equal in id and text are one document: they keep
    or lose the same lines. Null and empty texts have no lines. Without ``bands`` equal lines alone are linked.
    """
    _check(bands)
    lines = materialise(lines_of(docs, id_col, text_col, bands), "lines", dictionary=False)
    keyed, lines = lines.select("keys", "h"), lines.where("own").drop("keys")
    repeated = materialise(lines.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1"), "line-repeated")
    some = repeated.select("h")
    if bands:
        pairs, large = candidates(keyed, repeated.groupBy("h").agg(F.sum("n").alias("n")))
        near = materialise(pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(large.select("h")).distinct(), "line-near")
        some = materialise(some.unionByName(near).distinct(), "line-some")
    classes = lines.join(some, "h", "left_semi").groupBy("h", "h2").agg(F.min(F.struct("id", "doc", "line_no")).alias("at"), F.count("*").alias("n"))
    classes = marks = materialise(classes, "line-classes")
    if bands:
        texts = materialise(_texts(docs, classes.join(near, "h", "left_semi"), id_col, text_col, bands), "line-texts")
        found = connected_components(near_links(pairs, large, texts, bands))
        marks = marks.join(found.withColumnRenamed("node", "at"), "at", "left").where("n > 1 or root <> at")
        marks = marks.withColumn("root", F.coalesce("root", "at"))
    else:
        marks = marks.where("n > 1").withColumn("root", F.col("at"))
    marks = materialise(marks.drop("n"), "line-marks")
    out = lines.select("id", "doc", "line_no", "h", "h2").join(marks, ["h", "h2"])
    own = F.struct("id", "doc", "line_no")
    return out.where(own != F.col("root")).select("id", "doc", "line_no", "h", (own == F.col("at")).alias("near"), F.col("root.id").alias("of_id"), F.col("root.line_no").alias("of_line"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: tuple[tuple[int, int], ...] = BANDS, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the lines of ``repeats``; other columns pass through, ``n_chars`` is counted anew if there.

    A document that had lines and is left with blank ones alone repeats others whole; it goes unless
    ``drop_emptied`` is false. A document without lines stays as it is.
    """
    gone = repeats(docs, id_col=id_col, text_col=text_col, bands=bands)
    gone = gone.groupBy(F.col("id").alias("_mr_id"), F.col("doc").alias("_mr_doc")).agg(F.collect_set(F.struct("line_no", "h")).alias("_mr_gone"))
    rows = docs.withColumns({"_mr_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)), "_mr_doc": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}).join(gone, ["_mr_id", "_mr_doc"], "left")
    kept = F.filter(F.transform(F.split(text_col, "\n"), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: ~F.array_contains("_mr_gone", F.struct(x["i"].alias("line_no"), F.xxhash64(x["s"]).alias("h"))))
    text = F.when(F.col("_mr_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda x: x["s"]), "\n"))
    rows = rows.withColumn("_mr_new", text)
    if drop_emptied:
        rows = rows.where(F.col("_mr_gone").isNull() | F.col("_mr_new").rlike(r"[^ \t\r\n\f\x0B]"))
    out = [F.col("_mr_new").alias(c) if c == text_col else F.when(F.col("_mr_gone").isNull(), F.col("n_chars")).otherwise(F.length("_mr_new")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*out)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Of every document: its lines, those that go as equal and as near ones, and the documents of their classes' first lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = repeats(docs).groupBy("id", "doc").agg(
        F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("n_equal"),
        F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("n_near"),
        F.sort_array(F.collect_set("line_no")).alias("lines"),
        F.sort_array(F.collect_set("of_id")).alias("repeats_of"),
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("doc"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_NONE))).join(gone, ["id", "doc"], "left")
    return rows.select(
        "doc_id",
        "n_lines",
        F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce(F.array_join("lines", ","), F.lit("")).alias("gone_lines"),
        F.coalesce(F.array_join("repeats_of", ","), F.lit("")).alias("repeats_of"),
    )


#: The tables' letters beyond ASCII, as one byte each: DuckDB counts edits in bytes.
_LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"

# Sizes here fall into classes by band alone, with the segments of the shorter line found anywhere within the distance.
LINE_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, string_split(text, chr(10))[i] AS line
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) r(i)),
f AS (SELECT *, length(line) AS n FROM l WHERE regexp_matches(line, '[^ \t\r\f\v]')),
c AS (SELECT line, n, min(struct_pack(d := doc_id, k := line_no)) AS first FROM f GROUP BY line, n),
s AS (
  SELECT translate(line, '{_LETTERS}', '{"".join(map(chr, [*range(1, 9), *range(14, 27)]))}') AS line, first, n,
    CASE WHEN n < 20 THEN 1 ELSE 2 END AS t FROM c WHERE n >= 10),
-- Within t edits, one of t + 1 parts of the shorter line is in the longer one, shifted by t places at most.
ak AS (SELECT line, first, n AS l, i, substr(line, i * (n // (t + 1)) + 1, n // (t + 1)) AS part FROM s, range(0, 4) g(i) WHERE i <= t),
b AS (SELECT line, first, n - d AS l, CASE WHEN n - d < 20 THEN 1 ELSE 2 END AS t FROM s, range(0, 4) u(d) WHERE n - d >= 10),
bk AS (SELECT line, first, l, i, substr(line, i * (l // (t + 1)) + 1 + x, l // (t + 1)) AS part FROM b, range(0, 4) g(i), range(-3, 4) v(x) WHERE i <= t AND abs(x) <= t AND length(line) - l <= t AND i * (l // (t + 1)) + x >= 0),
k AS (SELECT DISTINCT a.line AS la, b.line AS lb, a.first AS fa, b.first AS fb, a.l FROM ak a JOIN bk b USING (l, i, part) WHERE a.line <> b.line),
p AS (SELECT fa, fb FROM k WHERE levenshtein(la, lb) <= CASE WHEN l < 20 THEN 1 ELSE 2 END),
e AS (SELECT fa AS u, fb AS v FROM p UNION SELECT fb, fa FROM p),
w AS (SELECT u, u AS root FROM (SELECT DISTINCT u FROM e) UNION SELECT e.v, w.root FROM w JOIN e ON w.u = e.u WHERE w.root < e.v),
m AS (SELECT u AS first, min(root) AS root FROM w GROUP BY u),
g AS (
  SELECT f.doc_id, f.line_no, (c.first.d = f.doc_id AND c.first.k = f.line_no) AS is_first, coalesce(m.root, c.first).d AS d
  FROM f JOIN c USING (line) LEFT JOIN m ON m.first = c.first
  WHERE NOT (coalesce(m.root, c.first).d = f.doc_id AND coalesce(m.root, c.first).k = f.line_no)),
o AS (
  SELECT doc_id, sum(CASE WHEN is_first THEN 0 ELSE 1 END) AS n_equal, sum(CASE WHEN is_first THEN 1 ELSE 0 END) AS n_near,
    string_agg(line_no, ',' ORDER BY line_no) AS gone_lines, array_to_string(list_sort(list_distinct(list(d))), ',') AS repeats_of
  FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  coalesce(gone_lines, '') AS gone_lines, coalesce(repeats_of, '') AS repeats_of
FROM documents LEFT JOIN o USING (doc_id)
"""
