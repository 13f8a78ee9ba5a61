"""N-gram join, line dedup, decontamination and the pipeline's stages, against brute force."""

import random
import re
from itertools import combinations

import pytest
from odd_rows import ROWS
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choices(words, k=12))
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.5:
            w = rng.choice(made).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        else:
            t = " ".join(rng.choices(words, k=rng.choice([1, 3, 6, 30, 60, 150])))
            t = f"{common} {t}" if rng.random() < 0.3 else t
        made.append(t)
        rows.append((i * 3, t))
    return rows


@pytest.mark.parametrize(("n", "num", "tile", "small"), [(4, 85, 4096, 12), (5, 80, 3, 12), (4, 85, 4096, 0)])
def test_join_agrees_with_brute_force(spark, monkeypatch, n, num, tile, small):
    from millrace.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "EXACT", 4096 if tile > 100 else 200)
    rows = corpus(n)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), n=n, num=num).collect()
    want = components(rows, n, num, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, n)) for i, t in rows}
    assert len(set(want.values())) < len(rows) - 20


def test_join_odd_rows(spark, odd, none):
    from millrace.llm.ngram_join import jaccard_join, keep_first

    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(odd, n=4, num=85).collect()), key=str)
    want = components(ROWS, 4, 85, 100)
    assert len(got) == len(ROWS)
    assert all(c == want.get(i) for i, _, c in got)
    kept = keep_first(odd, n=4, num=85)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 2
    assert jaccard_join(none).count() == 0 and keep_first(none).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def gone_lines(rows, bands):
    """(id, line_no) of lines that go: whether as a near one, and the first line of the class."""
    places, first = [], {}
    for i, text in sorted(rows):
        for k, s in enumerate(text.split("\n")):
            if s.strip(" \t\r\f\v"):
                places.append((i, k, s))
                first.setdefault(s, (i, k))
    root = dict(zip(first, first, strict=True))

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(first, 2):
        t = max((t for least, t in bands if least <= min(len(a), len(b))), default=0)
        if t and abs(len(a) - len(b)) <= t and edits(a, b) <= t:
            x, y = sorted((find(a), find(b)), key=first.get)
            root[y] = x
    return {(i, k): ((i, k) == first[s], *first[find(s)]) for i, k, s in places if first[find(s)] != (i, k)}


def got_lines(spark, rows, **how):
    from millrace.llm.line_dedup import repeats

    found = repeats(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    return {(r["id"], r["line_no"]): (r["near"], r["of_id"], r["of_line"]) for r in found.collect()}


@pytest.mark.parametrize(("bands", "bases"), [((), 25), (((10, 1), (20, 2)), 25), (((10, 1), (20, 2)), 3), (((10, 1), (20, 2), (96, 3)), 3), (((20, 4),), 10)])
def test_line_dedup_agrees_with_brute_force(spark, bands, bases):
    """Few bases make groups of over SMALL lines, which go through hubs and rare chunks."""
    rng = random.Random(bases)
    base = ["".join(rng.choices("abcde é", k=rng.choice([9, 10, 11, 19, 20, 21, 23, 24, 25, 40, 95, 96, 98]))) for _ in range(bases)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                p = rng.randrange(len(s))
                s[p : p + rng.randint(0, 1)] = rng.choices("abcz😀", k=rng.randint(0, 1))
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    got = got_lines(spark, rows, bands=bands)
    assert got == gone_lines(rows, bands)
    assert got


def test_line_dedup_near_lines_of_any_length(spark):
    rows = [(1, "color of the sky"), (2, "colour of the sky"), (3, "short one"), (4, "shore one"), (5, "color of the skies")]
    assert got_lines(spark, rows) == {(2, 0): (True, 1, 0)}


def test_line_dedup_many_near_copies_pair_with_a_hub(spark, monkeypatch):
    """Copies of one line make about a pair each, not all pairs."""
    from millrace.llm import line_dedup

    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh ", k=60))
    rows = [(0, base)] + [(i, base[:p] + rng.choice("xyzw") + rng.choice("xyzw") + base[p + 2 :]) for i, p in enumerate(rng.choices(range(58), k=90), 1)]
    made = []
    linked = line_dedup.linked
    monkeypatch.setattr(line_dedup, "linked", lambda pairs, bands: (made.append(pairs.count()), linked(pairs, bands))[1])
    assert got_lines(spark, rows) == gone_lines(rows, line_dedup.BANDS)
    assert sum(made) < 10 * len(rows)


def test_banded_automaton(spark):
    from millrace.llm.line_dedup import within

    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("ab😀", k=rng.randint(0, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.split("a", "").alias("x"), F.split("b", "").alias("y"))
    df = df.select("a", "b", F.when(F.col("a") == "", F.array().cast("array<string>")).otherwise(F.col("x")).alias("x"), F.when(F.col("b") == "", F.array().cast("array<string>")).otherwise(F.col("y")).alias("y"))
    for r in df.select("a", "b", within(F.col("x"), F.col("y"), 2, F.lit(2)).alias("ok")).collect():
        assert r["ok"] == (edits(r["a"], r["b"]) <= 2), (r["a"], r["b"])


def test_line_dedup_many_share_a_segment(spark):
    from millrace.llm.line_dedup import BANDS

    rows = [(i, f"The same long beginning of very many lines, then number {i * 7919 % 100_000:05d} and the same end") for i in range(60)]
    assert got_lines(spark, rows) == gone_lines(rows, BANDS)


def test_line_dedup_odd_rows(spark, odd, none):
    from millrace.llm.line_dedup import dedup

    out = dedup(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    got = {}
    for r in out.select("doc_id", "text", "n_chars").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert got[1] == [ROWS[0][1]]
    assert 2 not in got and got[3] == [""] and got[4] == [None] and got[5] == [ROWS[5][1]]
    assert set(got[None]) == {COPY_TEXT, None} and 8 not in got and 9 not in got
    assert dedup(odd, drop_emptied=False).count() == len(ROWS)
    assert dedup(none).count() == 0


COPY_TEXT = ROWS[8][1]


def test_decontamination(spark, odd, none):
    from millrace.llm.decontaminate import find, remove

    rng = random.Random(5)
    words = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(12, 50))) + rng.choice(["", "\nthe answer is " + " ".join(rng.choices(words, k=9))])) for i in range(40)]
    items += [(40, None), (41, ""), (42, items[3][1]), (None, items[4][1])]
    docs, want = [], set()
    for d in range(150):
        text = " ".join(rng.choices(words, k=rng.randint(0, 400)))
        if d % 3 == 0:
            i = rng.randrange(40)
            at = rng.randint(0, len(text))
            text = f"{text[:at]} {items[i][1].upper()} {text[at:]}"
            want |= {(d, j) for j, t in items if t and t == items[i][1]}
        docs.append((d, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = find(rows, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["score"] >= 1 and r["question_overlap"] == 1 and r["answer_overlap"] == 1 for r in got)
    assert {r[0] for r in remove(rows, bench).select("doc_id").collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert find(odd, bench).count() == 0 and remove(odd, bench).count() == len(ROWS)
    assert remove(odd, bench).columns == odd.columns
    assert find(none, bench).count() == 0 and find(odd, bench.limit(0)).count() == 0 and remove(odd, bench.limit(0)).count() == len(ROWS)
    one = spark.createDataFrame([(1, COPY_TEXT)], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in find(odd, one).collect()) == ["-5", "8", "9", "None"]


def test_decontamination_glued_signs_and_altered_words(spark):
    from millrace.llm.decontaminate import find

    question = "Which of these rivers runs through the old town of Basel and then on to the sea"
    items = [(1, f"{question}\nIt is the river Rhine"), (2, "Name the tallest hill near Oslo\nGrefsen ridge"), (3, "?? !! ;; ++\n== -- <<")]
    docs = [
        (1, f"before*** {question}\nIt is the river Rhine.%%% after"),
        (2, f"before {question.upper()} “It is the big Rhine” after"),
        (3, "x (Name the tallest hill near Oslo) Grefsen%%% ridge$$$ y"),
        (4, "x Name the tallest hill near Bergen: Grefsen slope y"),
        (5, f"{question}? Nobody said so. Many words that are others follow here until the river comes"),
        (6, "a ?? !! ;; ++ == -- << b"),
        (7, "Grefsen is near Oslo, and a hill; the tallest name of a ridge is another"),
    ]
    got = find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (3, 2), (4, 2), (6, 3)]


def test_block_bounds_find_what_scoring_all_finds(spark):
    """Every item at its threshold is retrieved: against BM25 of all passages and items."""
    import numpy as np

    from millrace.llm import decontaminate as dc

    rng = random.Random(11)
    words = [f"t{i}" for i in range(60)]
    items = sorted(((i, " ".join(rng.choices(words, k=rng.randint(5, 12)))) for i in range(30)), key=lambda x: len(x[1]))
    frequency = {}
    for _, t in items:
        for w in set(dc._words(t).tolist()):
            frequency[w] = frequency.get(w, 0) + 1
    mean = sum(len(t.split()) for _, t in items) / len(items)
    index = dc.ItemIndex(items, frequency, len(items), mean, 0.5)
    text = " ".join(rng.choices(words, k=500))
    w = dc._words(text)
    found = {(k, round(s, 4)) for _, k, s, _, _ in index.search(w, np.array([0, len(w)]), 0.0)}
    want = {}
    for p in range(0, max(1, -(-len(w) // index.half) - 1)):
        span = set(w[p * index.half : (p + 2) * index.half].tolist())
        own = [i for i, t in enumerate(index.terms.tolist()) if t in span]
        for k in range(len(items)):
            s = float(index.weights[k // dc.BLOCK, own, k % dc.BLOCK].sum(dtype=np.float64))
            if s >= 0.99999:
                want[k] = max(want.get(k, 0), s)
    assert {k for k, _ in found} == set(want) and want
    assert all(abs(s - want[k]) < 1e-3 for k, s in found)


def test_stages_keep_columns_and_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(8, 0, 1), (1, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no document holds this item or any of its words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd.select("doc_id", "text", "lang", "n_chars"), odd.select("doc_id", "text", "lang", "n_chars").limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(rows, docs.schema)
        assert all(r["round_trip"] for r in rows)
