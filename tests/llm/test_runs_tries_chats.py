"""Periodic runs, the prefix trie and chat formatting against brute force in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm import chat_format, periodic_runs, prefix_trie
from veridoc.llm.queries import QUERIES
from veridoc.llm.textvec import mix

DIR = "/root/testdata/sf0.001"
CHATS = "conv_id long, turn long, role string, text string, part long, nth long, depth long, print long, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs(w, least, times):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, times * q) and not any(all(s[x] == s[x + d] for x in range(len(s) - d)) for d in range(1, q)):
                out.append((i, len(s), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng, n):
    w = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(n)]
    if n > 5 and rng.random() < 0.5:
        p, a = rng.randint(1, n // 3), rng.randrange(n)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_repetitions():
    rng = random.Random(1)
    for _ in range(300):
        w = random_words(rng, rng.randint(1, 60))
        got = sorted(zip(*(x.tolist() for x in periodic_runs.repetitions(np.array([*w, 99]))), strict=True), key=lambda r: (r[0], r[2]))
        assert got == runs(w, 2, 2)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (8, 4)])
def test_runs_of_many_rows(least, times):
    rng = random.Random(least)
    rows = [random_words(rng, rng.randint(0, 120)) for _ in range(150)]
    flat = np.array([x for w in rows for x in w], np.uint64)
    row = np.repeat(np.arange(len(rows)), [len(w) for w in rows])
    first = np.cumsum([0, *map(len, rows)])
    got = [(row[a], a - first[row[a]], b, c) for a, b, c in zip(*(x.tolist() for x in periodic_runs.runs_of(mix(flat + np.uint64(9)), row, least, times)), strict=True)]
    assert got == [(i, *r) for i, w in enumerate(rows) for r in runs(w, least, times)]


def expected_digests(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w, 24, 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped).decode()
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(kept))


def test_run_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 1200]
    tenth = [i for i in range(20_000, 20_500) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"w{j * j % 97}" for j in range(100 + i % 50))) for i in tenth]
    rows += [(None, "a b " * 30), (None, None), (tenth[0], ""), (tenth[1], " \n "), (tenth[2], "one"), (30_001, "x " * 400), (30_001, "x " * 400), (30_002, "x " * 23), (30_003, "é ü " * 12), (30_004, "A a " * 11 + "A")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, collapsed int").repartition(5)
    got = periodic_runs.run_digests(periodic_runs.collapse_runs(periodic_runs.with_periods(df))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:2], r[-1])
    assert sorted(map(tuple, got), key=key) == sorted((expected_digests(*r) for r in rows), key=key)


def test_long_text_of_runs(spark):
    """A text of several megabytes, longer than what tasks work on at once, with one run far inside."""
    words = [f"v{i}" for i in range(300_000)]
    words[200_000:200_300] = ["p", "q", "r"] * 100
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    r = periodic_runs.collapse_runs(df).first()
    assert r["n_words"] == 300_000 and [tuple(x) for x in r["runs"]] == [(200_000, 300, 3)] and r["collapsed"].count(" ") == 300_000 - 297 - 1


def trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(ends[k])) for k, m in members.items()]


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nulls_last(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("bits", [64, 3])
def test_trie(spark, bits, monkeypatch):
    """With three bits of fingerprint nearly all groups hold different prefixes and are split; blocks of 16 turns make long conversations span them."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(0 if c in (20, 35) else rng.randrange(1, 12)):
            rows.append((c, t or None, None if rng.random() < 0.1 else ["user", "assistant"][t % 2], rng.choice(["a", "b", None]) if c < 50 else f"é{t}"))
    rows += [(c, t, "user", f"w{t % 3}") for c, n in ((70, 300), (75, 250)) for t in range(n)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "d") for r in rows], CHATS).repartition(5)
    assert nulls_last(prefix_trie.prefix_trie(df, bits).select(*NODE).collect()) == nulls_last(trie(rows))


def test_trie_of_one_conversation_over_many_tasks(spark):
    """Nearly all rows are one conversation's, and most others have the same turns."""
    rows = [(5, t, "user", f"t{t}") for t in range(600)] + [(c, t, "user", f"s{t}") for c in range(1000, 1100) for t in range(3)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    assert nulls_last(got.select(*NODE).collect()) == nulls_last(trie(rows))


def test_trie_of_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    # 4's head, 0, is absent and its only turn is among the first h = 5, so it has no turns; repeated rows are turns
    assert zlib.crc32(b"4") % 9 > 0
    for rows in ([(4, 0, "user", "x")], [(10, 1, "a", "x")] * 3 + [(11, 1, "a", "x")] * 2, [(-7, 0, None, None)]):
        if rows[0][0] >= 0:
            assert nulls_last(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).select(*NODE).collect()) == nulls_last(trie(rows))
        else:
            assert prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).count() >= 1


SIGNS = ["#", " ", "\\", ":", "<", "/", "turn>", "### ", "</turn>", "\n", "a", ": ", "é", "</turn>\n### user: "]


def test_template_round_trip():
    t, rng = chat_format.Template(), random.Random(1)
    escape, read = t.escaper(), t.reader()
    text = lambda n: "".join(rng.choice(SIGNS) for _ in range(rng.randrange(n)))
    for _ in range(5000):
        turns = [(text(4), text(9)) for _ in range(rng.randrange(4))]
        written = "".join(t.open + escape(role) + t.after_role + escape(said) + t.close for role, said in turns)
        assert [(role, said) for role, _, _, said in read(written)] == turns


def test_another_template():
    t = chat_format.Template(open="<|", after_role="|>", close="<end>", controls=("<|", "|>", "<end>"), escape="%")
    escape, read = t.escaper(), t.reader()
    said = "100% <|a|> <<end> %<end> é"
    written = t.open + escape("us|>er") + t.after_role + escape(said) + t.close
    assert [(role, text) for role, _, _, text in read(written)] == [("us|>er", said)]


def test_order_of_roles():
    t = chat_format.Template()
    state, fits = chat_format.START, []
    for role in ["system", "user", "assistant", "assistant", "user", "tool", "user", "assistant"]:
        fits.append(t.fits(state, role))
        state = t.state(role)
    assert fits == [True, True, True, False, True, False, False, True] and state in t.ends


def read_by_hand(rows):
    by = defaultdict(list)
    for c, turn, role, text, tie in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", tie, text or ""))
    out = []
    for c, v in by.items():
        v = sorted(v)
        said = "".join(x[4] for x in v if x[2] == "assistant")
        out.append((c, len(v), sha("".join(f"{x[2]}\n{x[4]}\n" for x in v)), len(said), sha(said)))
    return sorted(out)


@pytest.mark.parametrize("piece", [100, 1 << 13])
def test_chats(spark, monkeypatch, piece):
    monkeypatch.setattr(chat_format, "PIECE", piece)
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "".join(rng.choice(SIGNS) for _ in range(60))])
    rows = [(rng.choice([1, 2, 3, 3, 3, None, 4]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", None, "a: b"]), text()) for _ in range(400)]
    rows += [(9, t, ["user", "assistant"][t % 2], "x" * 300) for t in range(20)] + [(10, 0, "user", "y" * 200_000)]
    df = chat_format.with_tricky(spark.createDataFrame([(*r, 1, 2, 3, 4, "d") for r in rows], CHATS).repartition(4))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert sorted(tuple(r)[:5] for r in got.values()) == read_by_hand(df.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    assert (got[9]["n_out_of_order"], got[9]["complete"]) == (0, True) and (got[10]["n_out_of_order"], got[10]["complete"]) == (0, False) and got[3]["n_out_of_order"] > 0
    assert got[-7]["loss_chars"] == len(chat_format.TRICKY) and got[-7]["formatted_chars"] > 2 * len(chat_format.TRICKY)
    pieces = chat_format.format_chats(df)
    assert pieces.agg(F.sum("n_turns")).first()[0] == df.where("conv_id is not null").count()
    assert pieces.select(F.explode("segments").alias("s"), "formatted").where("s.loss and s.start + s.length > length(formatted)").count() == 0


def test_no_chats(spark):
    assert chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], CHATS))).collect() == []


def test_queries_of_conversations(spark):
    rows = spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert nulls_last(QUERIES["op12_prefix_trie"](spark, DIR).select(*NODE).collect()) == nulls_last(trie(map(tuple, rows)))
    got = QUERIES["op13_chat_format"](spark, DIR).collect()
    tricky = [(-7, 0, "user", chat_format.TRICKY, 0), (-7, 1, "assistant", chat_format.TRICKY, 0)]
    assert sorted(tuple(r)[:5] for r in got) == read_by_hand([*[(*r, 0) for r in rows], *tricky])
