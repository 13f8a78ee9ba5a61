"""Encoding, chat formatting, sharding, licence scan, WARC, fingerprints and toxicity."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
from odd_rows import ROWS
from pyspark.sql import functions as F

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
FUZZ = ["ab ", "a", " \n\t\r", "-=!%", "aàé'sdt ", "012 9", "日本語 x", "  \xa0\x1c\x1d\x85​ x1", "😀👩‍👩‍👧 é"]


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.choice(FUZZ), k=rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_public_encoding(spark, tiktoken_encoding, odd, none):
    from millrace.llm import byte_bpe

    texts = fuzz(1500, 1) + [t for _, t in ROWS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = byte_bpe.encode(df, path=PATH, pattern=PATTERN)
    for r in byte_bpe.decode(enc, path=PATH, pattern=PATTERN).collect():
        t = r["text"] or ""
        assert list(r["token_ids"]) == tiktoken_encoding.encode_ordinary(t)
        assert r["n_tokens"] == len(r["token_ids"]) and bytes(r["decoded"]) == t.encode() and r["decoded_text"] == t
    for r in byte_bpe.digests(df, path=PATH, pattern=PATTERN).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert byte_bpe.encode(odd, path=PATH, pattern=PATTERN).count() == len(ROWS)
    assert byte_bpe.encode_checked(none, path=PATH, pattern=PATTERN).count() == 0


def test_bpe_offsets_and_split_characters(spark):
    from millrace.llm import byte_bpe

    df = spark.createDataFrame([("a 🜲 b",), (None,)], "text string")
    r, empty = byte_bpe.encode(df, path=PATH, pattern=PATTERN, offsets=True).collect()
    assert empty["token_ids"] == [] and empty["token_spans"] == []
    text = "".join(sorted({(s["start"], r["text"][s["start"] : s["end"]]) for s in r["token_spans"]}, key=lambda x: x[0])[0][1])
    assert text and r["token_spans"][-1]["end"] == len(r["text"])
    half = spark.createDataFrame([(list(r["token_ids"])[:2],), ([],), (None,)], "token_ids array<int>")
    got = byte_bpe.decode(half, path=PATH, pattern=PATTERN).collect()
    assert got[0]["decoded_text"].startswith("a") and bytes(got[1]["decoded"]) == b"" and got[2]["decoded"] is None
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([999_999],)], "token_ids array<int>"), path=PATH, pattern=PATTERN).collect()


def test_chat_round_trip(spark):
    from millrace.llm.chat_format import format_chat, read_chat

    rng = random.Random(2)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>", "<<NEXT>>", "<", "[", "\\", " ", "\n", "x", "é😀", "$1", "/", "s>", "INST]"]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 6)):
            rows.append((c if c else None, t, rng.choice(["user", "assistant", "system", "tool<s>", "", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))])))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2), "t": F.lit(3)})
    want = {}
    for c, t, r, x in sorted(rows, key=lambda z: (str(z[0]), z[1], z[2] or "", z[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = read_chat(format_chat(df)).collect()
    assert len(got) == len(want)
    for r in got:
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss_text"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        assert sum(m["n_chars"] for m in r["loss_mask"]) == len(r["formatted"])
    assert format_chat(df.limit(0)).count() == 0


def test_adjacent_turns_merge(spark):
    from millrace.llm.chat_format import format_chat

    df = spark.createDataFrame([(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert format_chat(df).first()["formatted"] == "[INST] a<<NEXT>>b [/INST]<s>c</s>"


@pytest.mark.parametrize("limit", [300, 1000, 10**9])
def test_sharding(spark, odd, none, limit):
    from millrace.llm.sharding import hash_bits, shard

    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 90)) for i in range(400)] + [(7, "same key, other text " + str(k)) for k in range(60)] + [(9, "equal rows")] * 200 + [(500, "y" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(df, limit=limit).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)
    sizes, counts = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(r["text"])
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    assert all(b <= limit or counts[s] == 1 for s, b in sizes.items())
    assert all(r["shard_bytes"] == sizes[r["shard"]] and r["shard_rows"] == counts[r["shard"]] for r in got)
    # A shard is the shortest prefix of its rows' bits that fits: brute force over all prefixes.
    bits = [(b, len(t)) for (_, t), b in zip(rows, [r[0] for r in df.select(hash_bits(F.col("doc_id"), F.col("text"))).collect()], strict=True)]
    own = {}
    for b, _ in bits:
        k = 0
        while k < 120 and (n := sum(s for x, s in bits if x.startswith(b[:k]))) > limit and sum(x.startswith(b[:k]) for x, _ in bits) > 1:
            k += 1
        own[b] = b[:k]
    assert {s.split("+")[0] for s in sizes} == set(own.values())
    assert shard(odd, limit=limit).count() == len(ROWS) and shard(none, limit=limit).count() == 0


def test_shards_are_written(spark, tmp_path):
    from millrace.llm.sharding import write_shards

    df = spark.createDataFrame([(i, "x" * 50) for i in range(50)], "doc_id long, text string")
    write_shards(df, str(tmp_path / "s"), limit=400)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


def test_license_scan(spark, odd, none):
    from millrace.llm import license_scan as ls

    mit = ls.TEMPLATES["MIT-grant"]
    half = mit.index("subject") // 2
    rows = [(1, "first\nReleased under the MIT license!!\nlast"), (2, "intro\n\n" + mit[:half] + "\n" + mit[half:] + "\n\noutro"), (3, "nothing here"), (4, None), (5, ""), (6, "MIT")]
    got = {(r["doc_id"], r["kind"], r["line_no"], r["license_id"]): r["dice"] for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "line", 1, "MIT"] == 1.0 and (2, "paragraph", 2, "MIT-grant") in got
    assert {k[0] for k in got} == {1, 2}
    # Without size bounds: every line and template.
    rng = random.Random(1)
    words = " ".join(ls.TEMPLATES.values()).split()
    lines = []
    for i in range(300):
        w = rng.choice(list(ls.TEMPLATES.values())).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        lines.append((i, " ".join(w[: rng.randint(1, len(w))])))
    want = {}
    for i, t in lines:
        a = set(ls._bigrams(ls._words(t)))
        for k, v in ls.TEMPLATES.items():
            b = set(ls._bigrams(ls._words(v)))
            if a and 2 * len(a & b) >= 0.8 * (len(a) + len(b)):
                want[i, k] = round(2 * len(a & b) / (len(a) + len(b)), 6)
    got = {(r["doc_id"], r["license_id"]): r["dice"] for r in ls.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == want and want
    assert ls.scan(odd).collect() == []
    assert ls.scan(none).count() == 0 and ls.scan(odd, templates={}).count() == 0


def test_warc(spark, tmp_path):
    from millrace.llm import warc

    rows = [(i, f"https://www.h{i % 7}.example.com/p/{i}?q=ü x#f", ["a", "b\r\n\r\nc", "", None, "ü" * 50_000][i % 5] if i % 3 else f"own {i}") for i in range(200)]
    rows += [(500, None, "no url"), (None, "http://x/", "no id"), (501, "http://[bad", "x"), (502, "http://h/\r\nX: y", "z"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    folder = f"file://{tmp_path}/a"
    index_rows = warc.write_archive(warc.mark_revisits(pages), folder)
    directory = warc.build_index(index_rows, folder)
    got = warc.read_archive(warc.read_index(directory, folder), folder).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    by = {r["page_id"]: r for r in got}
    for i, _, h in rows:
        r, p = by[i], (h or "").encode()
        assert r["payload_bytes"] == len(p) and r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i is None or last[h or ""] == i else ("revisit", last[h or ""]))
    found = warc.CaptureIndex(directory, folder).lookup("http://H3.example.com/p/3?q=ü x")
    assert [h["WARC-Record-ID"] for h, _ in found] == ["<urn:page:3>"]
    assert warc.CaptureIndex(directory, folder).lookup("http://nowhere/") == []
    empty = warc.write_archive(warc.mark_revisits(pages.limit(0)), folder)
    assert warc.read_archive(warc.read_index(warc.build_index(empty, folder), folder), folder).count() == 0


def test_index_blocks(spark, tmp_path, monkeypatch):
    from millrace.llm import warc

    pages = spark.createDataFrame([(i, f"http://a.b/{i % 50}", f"p{i}") for i in range(400)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    directory = warc.build_index(warc.write_archive(warc.mark_revisits(pages), folder), folder)
    index = warc.CaptureIndex(directory, folder)
    for k in (0, 7, 49):
        assert sorted(p for _, p in index.lookup(f"http://a.b/{k}")) == sorted(f"p{i}".encode() for i in range(400) if i % 50 == k)


def xx(values, seed=42):
    import xxhash

    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def sketch(text):
    from millrace.llm import fingerprints as fp

    w = [xx([x.encode()]) for x in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    w = [x.to_bytes(8, "little", signed=True) for x in w]
    s = [xx(w[i : i + fp.WORDS]) for i in range(max(1, len(w) - fp.WORDS + 1))] if w else []
    return sorted({h for h in s if h < fp._TOP} | ({min(s)} if s else set()))


def test_fingerprints(spark, odd, none, monkeypatch):
    from millrace.llm import fingerprints as fp

    monkeypatch.setattr(fp, "_RANGE", 7)
    rng = random.Random(9)
    words = [f"w{i}é" for i in range(40)]
    rows = [(rng.randint(-10, 1000), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(100)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    want = sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = sorted((r["_mr_own_id"], r["_mr_text"], r["_mr_next_text"]) for r in fp.with_next(df).collect())
    assert got == want
    for r in fp.fingerprint(df).collect():
        assert r["fingerprint"] == sketch(r["text"] or "")
    for r in fp.with_next(df).collect():
        assert r["_mr_next_fp"] == sketch(r["_mr_next_text"])
    assert fp.fingerprint(odd).count() == len(ROWS) and fp.fingerprint(none).count() == 0 and fp.with_next(none).count() == 0
    ids = [r["_mr_own_id"] for r in fp.with_next(odd).collect()]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in ROWS)


def test_sketches_merge_and_contain(spark):
    from millrace.llm import fingerprints as fp

    long = " ".join(f"a{i}" for i in range(8000))
    df = spark.createDataFrame([(long, long[: len(long) // 10], "other words " * 50)], "a string, b string, c string")
    for c in "abc":
        df = fp.with_sketch(df, F.col(c), f"f{c}")
    r = df.select(fp.containment(F.col("fb"), F.col("fa")).alias("in"), fp.containment(F.col("fa"), F.col("fb")).alias("out"), fp.likeness(F.col("fa"), F.col("fc")).alias("not"), fp.merge(F.col("fa"), F.col("fb")).alias("m"), "fa").first()
    assert r["in"] > 0.98 and 0.05 < r["out"] < 0.15 and r["not"] < 0.01 and set(r["fa"]) <= set(r["m"])


def test_toxicity(spark, odd, none):
    from millrace.llm import toxicity as tx

    rng = random.Random(8)
    words, bad = [f"w{i}" for i in range(200)], ["vile", "rotten", "hateful"]
    rows = []
    for i in range(600):
        w = rng.choices(words, k=rng.randint(20, 120))
        if i % 6 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), holdout=5)
    got = tx.score(df, model, out_col="s").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).where("held").collect()
    assert len(got) > 60 and sum((r["s"] >= 0.5) == bool(r["toxic"]) for r in got) >= 0.97 * len(got)
    scored = tx.score(odd, model)
    assert scored.columns == [c for c in odd.columns if c != "toxicity"] + ["toxicity"]
    assert all(0 <= r["toxicity"] <= 1 for r in scored.collect())
    assert tx.score(none, model).count() == 0 and tx.keep_clean(odd, model).columns == odd.columns
    # No labels, or one class only: every score is the smoothed rate.
    assert tx.train(df, df.limit(0).select("doc_id", "toxic")).score(__import__("numpy").zeros(0, "uint8")) == 0.5
    assert tx.fit(["a", "b"], [1, 1]).bias > 0


def test_toxicity_counts_and_scores_by_hand():
    import random
    from collections import Counter

    import numpy as np

    from millrace.llm import toxicity as tx

    rng = random.Random(3)
    for text in ["", "a", "Ab\tC", "".join(rng.choice("aB é\n") for _ in range(tx._PIECE + 5000))]:
        raw = text.encode()
        padded = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in b" " + raw + b" ") if raw else b""
        grams = Counter(padded[i : i + n] for n in tx.SIZES for i in range(len(padded) - n + 1))

        def bucket(gram: bytes) -> int:
            packed = int.from_bytes(gram, "big") + (len(gram) << 56)
            return (packed * 0x9E3779B97F4A7C15 % (1 << 64)) >> 46

        want = np.zeros(1 << 18, np.int64)
        for gram, k in grams.items():
            want[bucket(gram)] += k
        got = tx._counts(np.frombuffer(raw, np.uint8), 18)
        assert (got == want).all()
        model = tx.ToxicityModel(np.linspace(-1, 1, 1 << 18).astype(np.float32), 0.25, 18)
        z = 0.25 + sum(k * float(model.weights[bucket(g)]) for g, k in grams.items()) / max(1, grams.total()) ** 0.5
        assert abs(model.score(np.frombuffer(raw, np.uint8)) - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_on_rows_held_out(spark):
    from millrace.llm import toxicity as tx

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = tx.op10_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    alarms = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(caught) > 50 and sum(caught) >= 0.9 * len(caught)
    assert sum(alarms) <= 0.02 * len(alarms)


def test_bpe_words_are_forgotten_and_learned_anew(tiktoken_encoding, monkeypatch):
    import random

    import numpy as np

    from millrace.llm import byte_bpe

    rng = random.Random(5)
    signs = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "a", "b", "é", "1", "'", "'s", ".", "#", "字", "👍", "́", "\x00", "the"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(4000)] + [None, "", " ", "a ", " a", "x" * 70 + " y", "q " + "z" * 100 + " r"]
    monkeypatch.setattr(byte_bpe, "_REMEMBERED", 300)
    monkeypatch.setattr(byte_bpe, "_WORDS_GROUP", 5000)
    codec = byte_bpe.Codec(PATH, PATTERN)
    for text, ids in zip(texts, codec.arrays(texts), strict=True):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text or "")
        assert codec.decode(ids.astype(np.int64)) == (text or "").encode()
    assert len(codec.slots) < 3000


def test_bpe_leaves_no_words_in_the_worker(monkeypatch, tiktoken_encoding):
    import pyarrow as pa
    from pyspark.sql import types as T

    from millrace.llm import byte_bpe

    class Rows:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    texts = fuzz(400, 9) + [None, "", "the " * 3000]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(texts[a:b], pa.string())], names=["doc_id", "text"]) for a, b in ((0, 0), (0, 250), (250, len(texts)))]
    monkeypatch.setattr(byte_bpe, "_WORDS_GROUP", 5000)
    back = []
    monkeypatch.setattr("millrace.llm.idle.give_back", lambda: back.append(1))
    for f in (byte_bpe.encode_checked, byte_bpe.digests, byte_bpe.encode):
        made = [r for b in f(Rows(), path=PATH, pattern=PATTERN).run(iter(batches)) for r in b.to_pylist()]
        assert [r["doc_id"] for r in made] == list(range(len(texts)))
        assert [r["n_tokens"] for r in made] == [len(tiktoken_encoding.encode_ordinary(t or "")) for t in texts]
        assert not byte_bpe.codec(PATH, PATTERN).slots and not len(byte_bpe.codec(PATH, PATTERN).kept)
    assert len(back) == 3
    sizes = [sum(len((texts[i] or "").encode()) for i in b.column("doc_id").to_pylist()) for b in byte_bpe.encode_checked(Rows(), path=PATH, pattern=PATTERN).run(iter(batches))]
    assert sizes[-1] == 12_000 and max(sizes[:-1]) <= 5000
