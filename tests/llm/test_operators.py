"""The corpus operators against brute force in plain Python, on the smallest table and hand-made rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veridoc.llm import attention_lm, cotraining, fingerprints, licenses, mixing, near_dedup, packing, quality_rules, sharding, token_counts
from veridoc.llm.queries import ORACLE, QUERIES, tokenizer

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, hash string, key string, id string, size string, a string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"word{i * i % 7919}" for i in range(30_000))
EDGE = [
    (9001, None, "en", "s1"), (9002, "", "en", None), (9003, " \t\n ", None, "s1"), (9004, LONG, "de", "s1"), (9005, LONG + " more", "de", "s2"), (9006, "single", "en", "s2"),
    (9007, BASE + "\n" + BASE + "\n\n" + BASE, "en", "s2"), (9008, BASE, "en", "s2"), (9008, BASE, "en", "s2"), (9009, BASE.upper(), "en", None), (9010, "a<|endoftext|>b <|startoftext|> don't 12  x Kİ", "en", "s1"),
    (9011, "Under the MIT license, UNDER THE MIT LICENSE; cc-by-nc cc by nc", "en", "s1"), (9012, "Licensed under the Apache license, version 2 . 0", "en", "s1"),
    (9013, "this work is (c) licensed under the gnu general public license version 3", "en", "s1"), (9014, "été \U0001f600 你好 " * 40, "fr", "s3"), (9015, "single", "en", "s2"),
]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [(*r, None, "n", "hash", "key", "id", "size", "a") for r in [*map(tuple, real), *EDGE]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, docs, rows):
    out = sharding.shard_documents(docs).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    assert sharding.shard_documents(empty(spark)).count() == 0
    # without overflow a row stays at its first shard; adding a shard moves few rows
    few = lambda n: {r["i"]: r["shard"] for r in sharding.bounded_ring(spark.range(4000).withColumnRenamed("id", "i"), F.xxhash64("i"), F.xxhash64("i"), [F.col("i")], range(n), slack=0.25).collect()}
    a, b = few(8), few(9)
    assert sum(a[i] != b[i] for i in a) < 0.5 * len(a) and max(Counter(a.values()).values()) <= math.ceil(4000 * 1.25 / 8)


def test_one_shard_more_under_the_registered_law(spark, docs):
    """Counts at most one apart force moves along the ring too: more than the ninth that must go, fewer than a fresh deal's 8/9."""
    shards = lambda n: {(r["doc_id"], r["text_crc32"], r["slot"] if r["doc_id"] is None else 0): r["shard"] for r in sharding.shard_documents(docs.where("doc_id is not null"), n).collect()}
    a, b = shards(8), shards(9)
    moved = sum(a[i] != b[i] for i in a) / len(a)
    print("moved", moved)
    assert a.keys() == b.keys() and 1 / 9 <= moved < 0.7


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_against_a_walk(spark, slack):
    """Row by row along the ring: each to its first shard clockwise that isn't full, rounds and cells in order."""
    rows = spark.range(3000).select(F.col("id").alias("i"), F.xxhash64(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700)).alias("h"), F.xxhash64("id").alias("s"))
    got = {r["i"]: (r["home_shard"], r["shard"], r["slot"]) for r in sharding.bounded_ring(rows, F.col("h"), F.col("s"), [F.col("i")], range(7), slack=slack).collect()}
    arcs, prefer = sharding.ring(range(7), 16)
    walk = []
    for r in rows.collect():
        arc = arcs[r["h"] % sharding.POSITIONS]
        cell = ((r["h"] >> 20) % sharding.CHUNKS * len(prefer) + arc) * sharding.SPREAD + r["s"] % sharding.SPREAD
        walk.append((cell, r["h"], r["i"], arc))
    walk.sort()
    room = [3000 // 7 + (k < 3000 % 7) if not slack else math.ceil(3000 * (1 + slack) / 7) for k in range(7)]
    free, want, left = list(room), {}, walk
    for turn in range(7):
        full = []
        for cell, h, i, arc in left:
            shard = prefer[arc][turn]
            if free[shard]:
                want[i] = (prefer[arc][0], shard, room[shard] - free[shard])
                free[shard] -= 1
            else:
                full.append((cell, h, i, arc))
        left = full
    assert not left and got == want


def test_mixing(spark, docs, rows):
    out = mixing.pareto_mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [3, 1, 2] * len(order), strict=False))
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] * 2 >= r["taken"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= biggest[s] for s in order)
    again = mixing.pareto_mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.repeated(docs).columns == docs.columns and mixing.repeated(docs).count() == sum(r["copies"] for r in out)
    assert mixing.pareto_mix(empty(spark)).count() == 0


def test_mixing_inclusion(spark):
    """Documents of each length are taken as often as their inclusion probabilities say, which sum to the sample."""
    lengths = [1, 10, 20, 40, 90]
    text = F.array_join(F.array_repeat(F.lit("w"), F.element_at(F.lit(lengths), (F.col("id") % 5).cast("int") + 1)), " ")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    for share, whole in ((0.3, 0), (1.3, 1)):
        got = {r["size"]: r["taken"] / r["all"] for r in mixing.pareto_mix(docs, share=share).groupBy("size").agg((F.sum("copies") - whole * F.count("*")).alias("taken"), F.count("*").alias("all")).collect()}
        mean = sum(lengths) / 5
        lean = {n: max(0.5, min(2, n / mean)) for n in lengths}
        low, high = 0.0, 2.0
        for _ in range(60):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(1, c * lean[n]) * n for n in lengths) < 0.3 * sum(lengths) else (low, c)
        for n in lengths:
            assert got[n] == pytest.approx(min(1, c * lean[n]), abs=0.03), (share, n)
    # where much is left, long documents are certain
    got = {r["size"]: r["copies"] for r in mixing.pareto_mix(docs, share=0.8).groupBy("size").agg(F.avg("copies").alias("copies")).collect()}
    assert got[90] == 1.0 and got[1] < 0.6


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def shingles(text, n):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, rows, n):
    sets = {}
    for r in rows:
        sets[r["doc_id"]] = shingles(r["text"], n)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    out = near_dedup.near_duplicates(docs, n).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == sorted((r["doc_id"], len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"]) for r in rows)
    kept = near_dedup.keep_one(docs, n)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({r["doc_id"] for r in rows if find(r["doc_id"]) == r["doc_id"]})


def test_near_duplicates_bridged_groups(spark):
    """Chains of edits: a component is longer than any one bucket reaches."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(f"x{i}" if i < 12 * k else w for i, w in enumerate(words))))
    rows.append((None, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert {out[k] for k in range(30)} == {0} and out[None] is None
    assert near_dedup.near_duplicates(empty(spark), 2).count() == 0


def test_near_duplicates_in_chunks(spark, monkeypatch):
    """Buckets of many texts of one site, whose links are few: the same classes whatever the chunks."""
    import random

    pick = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(120):
        own = [f"d{k}w{i}" for i in range(pick.randint(18, 30))] if k % 3 else [f"d{k // 12}v{i}" for i in range(24)] + [f"d{k}"]
        rows.append((k, " ".join(common + own)))
    rows += [(k, t) for k, t in rows[:5]] + [(None, rows[0][1])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: shingles(t, 2) for k, t in rows if k is not None}
    root = {k: k for k in sets}
    for i in sorted(sets):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                p, q = sorted((root[i], root[j]))
                root = {k: p if r == q else r for k, r in root.items()}
    assert 60 < len(set(root.values())) < 100
    for chunk in (7, 1000):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        out = near_dedup.near_duplicates(docs, 2).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in out if r["doc_id"] is not None) == sorted((k, root[k]) for k, _ in rows if k is not None)
    kept = near_dedup.keep_one(docs, 2).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(root.values())) and sum(r["doc_id"] is None for r in kept) == 2


def test_language_model(spark, docs, rows):
    tokens = {id(r): [*WORD.findall(low(r["text"] or "")), "\n"] for r in rows}
    held = {id(r): zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows}
    c = Counter(t for r in rows if not held[id(r)] for t in tokens[id(r)])
    total, distinct = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = tokens[id(r)]
        want.append((r["doc_id"], held[id(r)], len(t), sum(c[x] > 0 for x in t), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in t)))
    out = attention_lm.score_documents(docs, tokenizer("byte_bpe_50k.json")).collect()
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out)
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want)]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in sorted(want)], rel=1e-9)
    assert all(r["score"] < 0 for r in out)
    assert attention_lm.score_documents(empty(spark), tokenizer("byte_bpe_50k.json")).count() == 0


def test_language_model_beats_word_counts(spark):
    """On documents it hasn't learnt from. With a thousand documents or fewer it has too little to learn from and doesn't."""
    unseen = QUERIES["op5_attention_lm"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert unseen[0] > unseen[1]


def test_language_model_trains_on_every_token(spark):
    """Each id of each training text, and its end, is a target of one window, and the symbol before each is the one before."""
    import numpy as np

    texts = [list(range(1, 1 + n)) for n in (0, 1, 31, 32, 33, 64, 500)]
    train = spark.createDataFrame([(k, np.array(t, "<u2").tobytes()) for k, t in enumerate(texts)], "n long, ids binary")
    symbol = np.arange(attention_lm.VOCABULARY).astype(np.int16)
    got = defaultdict(list)
    for r in attention_lm.training_windows(train, symbol).collect():
        w = np.frombuffer(r["w"], "<i2").tolist()
        got[r["n"]] += [(r["place"] + i, x, y) for i, (x, y) in enumerate(zip(w, w[1:], strict=False)) if y >= 0]
    for k, t in enumerate(texts):
        s = [0, *t, 0]
        assert sorted(got[k]) == [(i, x, y) for i, (x, y) in enumerate(zip(s, s[1:], strict=False))]


def test_language_model_deals_equal_windows_apart(spark):
    """Copies of one window go to all partitions, and a partition is read in runs of PART."""
    import numpy as np
    import pyarrow as pa

    part = attention_lm.PART
    same = np.zeros(attention_lm.WINDOW + 1, "<i2").tobytes()
    windows = spark.range(10 * part).select(F.col("id").alias("n"), F.lit(0).cast("long").alias("place"), F.lit(same).alias("w"))
    sizes = [r["count"] for r in attention_lm.dealt(windows, 1, 10 * part).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10 * part and max(sizes) < 4 * part
    batch = pa.RecordBatch.from_arrays([pa.array([same] * (2 * part + 1), pa.binary())], ["w"])
    assert [len(w) for w in attention_lm.runs(iter([batch, batch.slice(0, 0), batch]))] == [2 * part, 2 * part, 2]


def test_language_model_context():
    """A token's score depends on the symbol 12 places before the one before it, where the text has it."""
    import numpy as np

    m, c = attention_lm.M, attention_lm.CLASSES
    rng = np.random.default_rng(0)
    tables = {"symbol": np.arange(attention_lm.VOCABULARY).astype(np.int16), "id_score": np.zeros(attention_lm.VOCABULARY), "prior": np.zeros((m, c), np.float32), "within": np.zeros((m, m), np.float32), "class": np.arange(m) % c}
    score = attention_lm.Scorer(rng.normal(0, 0.3, len(attention_lm.initial())).astype(np.float32), tables)
    text = rng.integers(1, m - 1, 100)
    # the score of a token: that of the text up to it, without that of other tokens, as only it differs
    last = lambda ids, k: [score(np.append(ids[:k], y), np.array([0, k + 1]))[0] for y in (1, 2)]
    for k in range(40, 80):
        other = text.copy()
        other[k - 13] = text[k - 13] % (m - 2) + 1
        (a, b), (c1, d) = last(text, k), last(other, k)
        assert abs((a - b) - (c1 - d)) > 1e-7, k


def test_language_model_scores():
    """The batched score of a text is that of the training model's forward pass, token by token."""
    import numpy as np

    m, c, width = attention_lm.M, attention_lm.CLASSES, attention_lm.WINDOW
    rng = np.random.default_rng(4)
    p = rng.normal(0, 0.3, len(attention_lm.initial())).astype(np.float32)
    prior, within = rng.normal(size=(m, c)).astype(np.float32), rng.normal(size=(m, m)).astype(np.float32)
    symbol = (np.arange(attention_lm.VOCABULARY) % m).astype(np.int16)
    tables = {"symbol": symbol, "id_score": rng.normal(size=attention_lm.VOCABULARY).astype(np.float32), "prior": prior, "within": within, "class": np.arange(m) % c}
    texts = [rng.integers(0, attention_lm.VOCABULARY, n) for n in (0, 1, 19, 20, 21, 90)]
    got = attention_lm.Scorer(p, tables)(np.concatenate(texts).astype(np.int64), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    e, wq, wk, wv, bias, u = attention_lm.unpack(p)
    lead = width - attention_lm.STRIDE
    for k, ids in enumerate(texts):
        s = [0, *symbol[ids].tolist(), 0]
        total = float(tables["id_score"][ids].sum())
        for i in range(len(s) - 1):
            first = i // attention_lm.STRIDE * attention_lm.STRIDE - lead
            keys = list(range(max(first, 0), i + 1))
            w = np.exp([float(e[s[i]] @ wq @ (e[s[j]] @ wk)) / attention_lm.WIDTH**0.5 + bias[i - j] for j in keys])
            o = sum(a * (e[s[j]] @ wv) for a, j in zip(w / w.sum(), keys, strict=True))
            z = prior[s[i]] + o @ u
            total += float(z[(s[i + 1]) % c] - np.log(np.exp(z).sum()) + within[s[i], s[i + 1]])
        assert got[k] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4), k


def test_language_model_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    p = attention_lm.initial().astype(np.float64)
    x, y = rng.integers(0, 50, (3, attention_lm.WINDOW)), rng.integers(0, attention_lm.CLASSES, (3, attention_lm.WINDOW))
    prior = rng.normal(size=(attention_lm.M, attention_lm.CLASSES))
    _, g = attention_lm.gradient(p, x, y, prior)
    for at in [5, 300, attention_lm.M * attention_lm.WIDTH + 7, attention_lm.M * attention_lm.WIDTH + 300, len(p) - 1, len(p) - 520]:
        q, r = p.copy(), p.copy()
        q[at] += 1e-4
        r[at] -= 1e-4
        slope = (attention_lm.gradient(q, x, y, prior)[0] - attention_lm.gradient(r, x, y, prior)[0]) / 2e-4
        assert slope == pytest.approx(float(g[at]), abs=1e-5)


def test_language_model_memory_is_used_again():
    """A step of training asks the system for next to no pages once its arrays were there."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from veridoc.llm import attention_lm as A
if hasattr(A, "keep_freed"):
    A.keep_freed()
rng = np.random.default_rng(0)
x, y, prior = rng.integers(0, A.M, (64, A.WINDOW)), rng.integers(0, A.CLASSES, (64, A.WINDOW)), rng.normal(size=(A.M, A.CLASSES)).astype(np.float32)
faults = []
for _ in range(30):
    A.gradient(A.initial(), x, y, prior)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print((faults[-1] - faults[9]) / 20)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert float(out.stdout) < 100


def test_fingerprints(spark, docs):
    one = docs.dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in one.collect()), key=lambda x: x[0])
    out = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(one).collect()}
    assert len(out) == len(rows)
    apart = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        cased = lambda t: {tuple(w[j : j + 5]) for w in [WORD.findall(t)] for j in range(len(w) - 4)}
        x, y = cased(text), cased(edited)
        if x and y:
            apart.append(abs(len(x & y) / len(x | y) - r["near_edited"]))
        if rows[(k + 1) % len(rows)][1] == text:
            assert r["near_next"] == 1.0
    assert sum(apart) / len(apart) < 0.04 and max(apart) < 0.2
    same = defaultdict(set)
    for i, text in rows:
        same[text].add(out[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0
    again = fingerprints.edited_fingerprints(one, 37)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.values()))


def test_next_rows(spark):
    """Keys of any type, with nulls, ties and repeated rows, in any number of chunks."""
    import random

    pick = random.Random(2)
    keys = [None, None, *[pick.choice(["a", "b", "é", "", *map(str, range(60))]) for _ in range(300)]]
    rows = [(k, pick.randint(0, 3), str(n)) for n, k in enumerate(keys)] + [("zz", 9, "x")] * 3
    df = spark.createDataFrame(rows, "key string, tie long, v string")
    order = sorted(((k is not None, (k or "").encode(), t) for k, t, _ in rows))
    want = Counter(zip(order, order[1:] + order[:1], strict=True))
    for chunks in (1, 2, 16):
        got = Counter(((r["key"] is not None, (r["key"] or "").encode(), r["tie"]), (r["next_key"] is not None, (r["next_key"] or "").encode(), r["next_tie"])) for r in fingerprints.with_next(df, "key", "tie", ["key", "tie"], chunks).collect())
        assert got == want, chunks


def test_fingerprint_values(spark):
    """Bins, minima, densification and packing, step by step in plain Python; the hashes are the engine's own."""
    texts = [" ".join(f"w{k * i % 97}" for i in range(n)) for k, n in ((1, 3), (2, 5), (3, 9), (5, 60), (7, 1200))] + ["", " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    hashed = df.withColumn("w", F.transform(F.array_remove(F.split("text", "[ \n]+"), ""), lambda w: F.xxhash64(w)))
    size = F.size("w")
    shingles_of = F.transform(F.sequence(F.lit(0), size - 5), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get("w", i + j) for j in range(5)]), 1))
    raw = {r["k"]: r["h"] for r in hashed.select("k", F.when(size == 0, F.array().cast("array<long>")).when(size < 5, F.array(F.shiftrightunsigned(F.xxhash64("w"), 1))).otherwise(shingles_of).alias("h")).collect()}
    bins = fingerprints.BINS
    tries = spark.range(bins).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda t: fingerprints.probe(F.col("id").cast("int"), t)).alias("p")).collect()
    probes = {r["id"]: [*r["p"], *[(r["id"] + t * 101) % bins for t in range(1, bins + 1)]] for r in tries}
    for r in fingerprints.fingerprint(df, "text", "fp").select("k", fingerprints.as_hex(F.col("fp")).alias("hex")).collect():
        least = {}
        for h in raw[r["k"]]:
            least[h >> 55] = min(h, least.get(h >> 55, h))
        want = "".join(f"{least[i if i in least else next(b for b in probes[i] if b in least)] & 255:02x}" for i in range(bins)) if least else ""
        assert r["hex"] == want, r["k"]


def test_quality_rules(spark, docs, rows, labels):
    want = []
    for r in rows:
        text = r["text"] or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    out = quality_rules.quality_rules(docs, labels)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = out.collect()
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality_rules.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).count() == len(rows)


def test_held_out_accuracy(spark):
    """Models trained without a quarter of the labels tell that quarter's rows apart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    seen, unseen = labels.where(part > 0), labels.where(part == 0)
    for scored, column, label, least in [
        (quality_rules.quality_rules(docs, seen), "quality", "y", 0.9),
        (cotraining.quality_scores(docs, seen), "score", "y", 0.9),
        (cotraining.quality_scores(docs, seen), "toxic_score", "t", 0.9),
    ]:
        got = scored.join(unseen.select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("t")), "doc_id").select(F.col(column).alias("s"), F.col(label).alias("l")).where("l is not null").toPandas()
        rank, good = got["s"].rank(), got["l"] > 0
        n1, n0 = good.sum(), (~good).sum()
        auc = (rank[good].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
        print(column, len(got), round(auc, 4))
        assert auc > least


def test_cotraining(spark, docs, rows, labels):
    out = cotraining.quality_scores(docs, labels).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in rows)
    assert all(0 <= r[c] <= 1 for r in out for c in ("text_score", "meta_score", "score", "toxic_score"))
    kept = cotraining.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)
    assert cotraining.quality_scores(docs, labels.limit(0)).count() == len(rows)
    assert cotraining.quality_scores(empty(spark), labels).count() == 0


def test_cotraining_exchange():
    """Rows without labels enter the other view's training set."""
    import pyarrow as pa

    rows = []
    for k in range(400):
        good = k % 2 == 0
        text = " ".join(f"{'good' if good else 'bad'}{(k * 7 + i) % 30}" for i in range(40)) + ("" if good else "\n" * 20)
        views = {name: x[0] for name, x in cotraining.features(pa.array([text]), ["en"], ["a" if good else "b"]).items()}
        rows.append({"doc_id": k, "y": good if k < 120 else None, "toxic": None} | views)
    model = cotraining.train(rows)
    assert min(model["given"]) > 50


def test_cotraining_exchange_sees_all_documents(spark, monkeypatch):
    """The only documents that a view can be sure of are few among many, and are given all the same."""
    text = lambda word, k: " ".join(f"{word}{(k * 7 + i) % 30}" for i in range(40)) + ("" if word == "good" else "\n" * 20)
    known = [(k, text("good" if k % 2 else "bad", k), "en", "a" if k % 2 else "b") for k in range(400)]
    plain = [(k, "", None, None) for k in range(1000, 5000)]
    rare = [(k, text("good" if k % 2 else "bad", k), "en", "a" if k % 2 else "b") for k in range(9000, 9060)]
    docs = spark.createDataFrame(known + plain + rare, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got, surest = set(), cotraining.surest

    def spy(*args):
        out = surest(*args)
        got.update((r["doc_id"], r["value"]) for r in out)
        return out

    monkeypatch.setattr(cotraining, "surest", spy)
    cotraining.corpus_model(docs, labels)
    assert {(k, float(k % 2)) for k in range(9000, 9060)} <= got


def test_cotraining_round_in_plain_python(spark, monkeypatch):
    """Each round: what a view gives, from each document's buckets one by one, and whom the other view learns it from."""
    import math

    import numpy as np
    import pyarrow as pa

    def text(k):
        good = k % 2 == 0
        mixed = [f"{'good' if good ^ ((k * 31 + i * 17) % 100 < k % 60) else 'bad'}{(k * 7 + i) % 30}" for i in range(40)]
        return " ".join(mixed) + "\n" * (k % 25 if good else 20)

    rows = [(k, text(k), "en", "ab"[k % 2] if k % 3 else "c") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(150)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(cotraining, "GIVEN", 12)
    asked, fits, surest, fit = [], [], cotraining.surest, cotraining.linear.fit
    monkeypatch.setattr(cotraining, "surest", lambda *a: asked.append((a[2], list(a[3]), out := surest(*a))) or out)
    monkeypatch.setattr(cotraining.linear, "fit", lambda x, y, *a, weight=None, **k: fits.append((y.copy(), weight.copy())) or fit(x, y, *a, weight=weight, **k))
    cotraining.corpus_model(docs, labels)

    buckets = {k: {n: x[0].tolist() for n, x in cotraining.features(pa.array([t]), [lang], [source]).items()} for k, t, lang, source in rows}

    def sure(model, k, view):
        if view == 0:
            value = {b: float(model["idf"][b]) for b in buckets[k]["words"] if model["idf"][b] > 0}
            norm = math.sqrt(sum(x * x for x in value.values())) or 1.0
            z = sum(x / norm * float(model["w"][0][b]) for b, x in value.items())
        else:
            z = sum(float(model["w"][1][b]) / 3 for b in buckets[k]["meta"])
        a, c = model["cal"][view]
        return 1 / (1 + math.exp(-(a * (z + model["b"][view]) + c)))

    assert len(asked) == cotraining.ROUNDS and sum(len(out) for _, _, out in asked) > 60
    learnt = [{}, {}]  # by view: what it was told of documents without labels
    for n, (model, before, out) in enumerate(asked):
        for view in (0, 1):
            for value in (0.0, 1.0):
                p = {k: sure(model, k, view) for k in range(150, 400) if (k, view) not in before}
                p = {k: x if value else 1 - x for k, x in p.items()}
                got = {r["doc_id"] for r in out if (r["view"], r["value"]) == (view, value)}
                can = sorted((x for x in p.values() if x >= cotraining.SURE + 1e-5), reverse=True)
                may = [x for x in p.values() if x >= cotraining.SURE - 1e-5]
                assert min(12, len(can)) <= len(got) <= min(12, len(may)) and all(p[k] >= cotraining.SURE - 1e-5 for k in got)
                assert not got or min(p[k] for k in got) >= max((x for k, x in p.items() if k not in got and len(got) == 12), default=0) - 1e-5
        for r in out:
            learnt[1 - r["view"]].setdefault(r["doc_id"], r["value"])
        for view in (0, 1):
            y, weight = fits[2 * (n + 1) + view]
            told = sorted(zip(y[weight == 0.5].tolist(), weight[weight == 0.5].tolist(), strict=True))
            assert told == sorted((v, 0.5) for v in learnt[view].values())
            # every fourth labelled row is held out for calibration, and none of the others is told anything else
            assert (weight == 1).sum() == 150 - len(range(3, 150, 4)) and np.isin(y[weight == 1], (0, 1)).all()


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(t.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in rows]
    assert sorted(map(tuple, token_counts.token_counts(docs, path).collect())) == sorted(want)
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_packing(spark, docs, rows):
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    out = packing.pack_documents(docs, path).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in out) // 2048) + 2
    assert packing.pack_documents(empty(spark), path).count() == 0


@pytest.mark.parametrize(("kind", "ids"), [("long", [None, 9007199254740993, 5, 5, -(2**63)]), ("string", [None, "9007199254740993", "", "x", "x"])])
def test_packing_keeps_ids(spark, kind, ids):
    """Ids come back as they are: nulls, repeated ones, numbers that a double can't hold, strings."""
    docs = spark.createDataFrame([(i, f"text {k}", k) for k, i in enumerate(ids)], f"doc_id {kind}, text string, length int")
    out = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))
    assert sorted(map(str, [r["doc_id"] for r in out.collect()])) == sorted(map(str, ids))
    assert out.schema["doc_id"].dataType.simpleString() == docs.schema["doc_id"].dataType.simpleString()


def test_completion_against_all_packings():
    """On small groups: as few sequences as the best of all packings, and the bound is one."""
    import random

    import numpy as np

    def fewest(lengths, size):
        best, lengths = len(lengths), sorted(lengths, reverse=True)

        def place(i, used):
            nonlocal best
            if len(used) >= best:
                return
            if i == len(lengths):
                best = len(used)
                return
            for room in {u for u in used if u + lengths[i] <= size}:
                k = used.index(room)
                place(i + 1, [*used[:k], room + lengths[i], *used[k + 1 :]])
            place(i + 1, [*used, lengths[i]])

        place(0, [])
        return best

    pick = random.Random(5)
    for _ in range(120):
        size = pick.choice([10, 20, 37])
        lengths = [pick.randint(1, size - 1) for _ in range(pick.randint(1, 11))]
        number, _ = packing.pack(np.array(lengths), size)
        want = fewest(lengths, size)
        counts = np.bincount(lengths, minlength=size + 1).tolist()
        assert packing.fewest(counts, size) <= want == number.max() + 1
        assert packing.search(counts, size)[1]


@pytest.mark.parametrize(("top", "many"), [(2047, 400), (300, 900), (12, 5000)])
def test_best_fit_by_counts(top, many):
    """As if each length were placed by itself: as much room is left in each sequence; equal rooms tie."""
    import numpy as np

    counts = np.bincount(np.random.default_rng(top).integers(1, top, many), minlength=2049).tolist()
    room: list[int] = []
    for x in range(2048, 0, -1):
        for _ in range(counts[x]):
            k = min((k for k, r in enumerate(room) if r >= x), key=lambda k: room[k], default=None)
            if k is None:
                k = len(room)
                room.append(2048)
            room[k] -= x
    plan = packing.best_fit(counts, 2048)
    assert sorted(room) == sorted(2048 - sum(x * k for x, k in f) for f, times in plan for _ in range(times))
    assert [sum(k * times for f, times in plan for y, k in f if y == x) for x in range(2049)] == counts


def test_packing_has_no_groups():
    """The sequences of a hundred corpora together are no more than a hundred times those of one, at the same cost."""
    import numpy as np

    counts = np.bincount(np.random.default_rng(4).integers(400, 800, 5000), minlength=2049)
    one, _ = packing.search(counts.tolist(), 2048, 300_000)
    many, _ = packing.search((100 * counts).tolist(), 2048, 300_000)
    assert packing.fewest((100 * counts).tolist(), 2048) <= packing.sequences(many) <= 100 * packing.sequences(one)
    assert packing.sequences(one) < packing.sequences(packing.best_fit(counts.tolist(), 2048))
    # where the steps run out at once best fit stands, and isn't called the fewest
    plan, proven = packing.search(counts.tolist(), 2048, 0)
    assert not proven and packing.sequences(plan) == packing.sequences(packing.best_fit(counts.tolist(), 2048))


@pytest.mark.parametrize("salts", [1, 7])
def test_packing_beyond_five_thousand_rests(spark, salts):
    """One packing for all rests, a third of which have one length and are the same row: as few sequences as their sum asks."""
    docs = spark.range(7000).selectExpr("if(id % 3 = 0, -1, id) doc_id", "if(id % 3 = 0, '', repeat('word ', int(id * 7919 % 900))) text")
    out = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), salts=salts).collect()
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(out) == 7000 and len(by) == -(-sum(r["length"] for r in out) // 2048) and all(r["proven"] for r in out)


def test_completion_branches_on_all_fillings():
    """A filling without waste isn't best whatever else there is."""
    import numpy as np

    number, _ = packing.pack(np.array([6, 5, 5, 5, 4, 3, 3, 3, 2]), 12)
    assert number.max() + 1 == 3 and np.bincount(number, [6, 5, 5, 5, 4, 3, 3, 3, 2]).tolist() == [12, 12, 12]


@pytest.mark.parametrize("top", [300, 900, 2048])
def test_completion_against_first_fit(top):
    """Never worse than first-fit decreasing, and with short lengths next to the bound that their sum gives."""
    import numpy as np

    lengths = np.random.default_rng(1).integers(1, top, 3000)
    number, offset = packing.pack(lengths)
    used = np.bincount(number, lengths)
    room: list[int] = []
    for x in sorted(lengths.tolist(), reverse=True):
        k = next((i for i, r in enumerate(room) if r >= x), None)
        if k is None:
            room.append(2048 - x)
        else:
            room[k] -= x
    assert used.max() <= 2048 and len(used) <= len(room)
    assert top == 2048 or len(used) <= -(-int(lengths.sum()) // 2048) + 1


def test_licenses(spark, docs, rows):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    sets = [(label, set(t.split())) for label, texts in licenses.TEMPLATES.items() for t in texts]
    out = sorted(licenses.license_labels(docs).collect(), key=str)
    assert len(out) == len(rows)
    for r in rows:
        w = split.findall(low(r["text"] or ""))
        hits = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = {label for _, label in hits}
        found, best = set(), 0.0
        for k in range(max(0, math.ceil((len(w) - 32) / 32) - 1) + 1):
            block = set(w[32 * k : 32 * k + 64])
            printed = f" {' '.join(w[32 * k : 32 * k + 64])} "
            for label, s in sets:
                named = all(any(f" {phrase} " in printed for phrase in some) for some in licenses.NAMING.get(label, []))
                if named and len(s & block) >= 0.8 * len(s) - 1e-9:
                    found.add(label)
                    best = max(best, len(s & block) / len(s))
        at = [i for i, _ in hits]
        want[r["doc_id"]] = (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best)
    for r in out:
        assert tuple(r)[1:7] == want[r["doc_id"]][:6] and r["score"] == pytest.approx(want[r["doc_id"]][6]), r["doc_id"]
    assert licenses.license_labels(empty(spark)).count() == 0


def test_licenses_are_told_apart(spark):
    """Notices of one family differ in a word, which must be there; a template of any length is found."""
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "Licensed under the GNU Lesser General Public License, version 3.": "lgpl-3",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3", "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3",
        "This work is licensed under the GNU General Public License, version 2.": "", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by-sa",
        "Released under the license.": "", "Mit Dank. This work is licensed under the GNU General Public License, version 3.": "gpl-3", "Released under the MIT License.": "mit", "Licensed under the license, version 2.0": "", "Licensed under the Apache License, Version 2.0.": "apache-2",
        "Subject to the terms of the Eclipse Public License, v. 2.0.": "", "Subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(notices)], "doc_id long, text string")
    assert {k: r["labels"] for k, r in zip(notices, sorted(licenses.license_labels(docs).collect()), strict=True)} == notices
    whole = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(0, " ".join(["x"] * 777 + whole[:250] + ["y"] * 99)), (1, " ".join(whole[:239])), (2, "w1 sa")], "key long, text string")
    found = licenses.matches(docs, "key", {"whole": [" ".join(whole)], "short": ["w1 sa"]}).collect()
    assert {(r["key"], r["label"]) for r in found} == {(0, "whole"), (2, "short")} and max(r["containment"] for r in found if r["key"] == 0) == 250 / 300


def test_labelled_sample_is_of_the_documents(spark):
    """Labels of other documents take no places of the sample."""
    docs = spark.createDataFrame([(k, f"text {k}", "en", "s") for k in range(20)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(2000)], "doc_id long, quality int, toxic int")
    assert [len(quality_rules.labelled_sample(docs, labels, "quality", 20)), len(cotraining.sample(docs, labels, 20))] == [20, 20]


def test_pipeline(spark):
    """The stages' documents are some of those before, and the packed pieces are those of the mixed documents."""
    import corpus_pipeline

    before = docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, DIR))
        assert docs.columns == before.columns and docs.exceptAll(before).count() == 0 if name != "mix" else docs.subtract(before).count() == 0, name
        before = docs
    packed = corpus_pipeline.run(spark, DIR)
    assert packed.where("piece = 0").count() == docs.count() > 0


def test_null_ids(spark, labels):
    """Rows without doc_id, and rows that repeat one, come back one by one with the results that other ids give."""
    texts = ["one two three four five six under the MIT license", "one two three four five six under the MIT license", None, BASE + "\n" + BASE, "single", "cc by nc cc by nc"]
    ids = [None, None, None, 5, 5, 9007199254740993]
    schema = "doc_id long, text string, lang string, source string, label string"
    given = spark.createDataFrame([(i, t, "en", "s", "x") for i, t in zip(ids, texts, strict=True)], schema)
    plain = spark.createDataFrame([(k, t, "en", "s", "x") for k, t in enumerate(texts)], schema)
    path = tokenizer("byte_bpe_50k.json")
    for of in (lambda d: quality_rules.quality_rules(d, labels.limit(0)), lambda d: token_counts.token_counts(d, path), licenses.license_labels, lambda d: cotraining.quality_scores(d, labels.limit(0))):
        got, want = ([tuple(r)[1:] for r in of(d).collect()] for d in (given, plain))
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert sorted(map(str, (r[0] for r in of(given).select("doc_id").collect()))) == sorted(map(str, ids))
    for of in (sharding.shard_documents, mixing.pareto_mix, fingerprints.edited_fingerprints, lambda d: attention_lm.score_documents(d, path), lambda d: near_dedup.near_duplicates(d, 2)):
        assert sorted(map(str, (r["doc_id"] for r in of(given).collect()))) == sorted(map(str, ids))
    named = spark.createDataFrame([(None if i is None else f"id{i}", t, "en", "s", "x") for i, t in zip(ids, texts, strict=True)], schema.replace("doc_id long", "doc_id string"))
    for of in (sharding.shard_documents, mixing.pareto_mix, fingerprints.edited_fingerprints, licenses.license_labels, lambda d: near_dedup.near_duplicates(d, 2), lambda d: attention_lm.score_documents(d, path)):
        assert of(named).count() == len(ids)


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
