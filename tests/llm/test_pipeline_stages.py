"""Each stage of the pipeline on the rows that its predecessor kept, against plain Python, verdicts of models against the operators' own scores; and texts longer than a slice."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veridoc.llm import cotraining, near_dedup, quality_rules, textvec, token_counts
from veridoc.llm.queries import tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def stages(spark):
    """Of each stage the rows before and after it, and all as they are stored."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, DIR))
        out[name] = (docs, after)
        docs = after
    return out


def ids_of(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def repeated_words(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_rules_reject_what_the_limits_name_and_what_the_model_does(spark, stages):
    before, after = stages["quality_rules"]
    kept = set(ids_of(after))
    for r in before.collect():
        words = WORD.findall(r["text"] or "")
        if len(words) < 50 or 100 * repeated_words(words) > 50 * len(words):
            assert r["doc_id"] not in kept
    verdicts = quality_rules.quality_rules(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert kept == {r["doc_id"] for r in verdicts.where("kept").collect()}


def test_classifier_keeps_by_both_scores(spark, stages):
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = cotraining.corpus_model(before, labels, stages["quality_rules"][0])
    rows = before.collect()
    batch = pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], pa.string()) for c in cotraining.COLUMNS})
    got = cotraining.scores(batch, model)
    want = [r["doc_id"] for r, s, t in zip(rows, got["score"], got["toxic_score"], strict=True) if s >= cotraining.KEEP_AT and t < cotraining.TOXIC_AT]
    assert ids_of(after) == sorted(want)
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()} & set(ids_of(before))
    assert good and len(good & set(want)) >= 0.9 * len(good)


def test_near_duplicates_leave_the_least_of_each_group(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = WORD.findall(low(r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert ids_of(after) == [i for i in ids if find(i) == i]


def test_mix_comes_near_each_target(stages):
    before, after = stages["mix"]
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in before.collect()}
    of, have, largest = {}, defaultdict(int), defaultdict(int)
    for r in before.collect():
        of[r["doc_id"]] = r["source"]
        have[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    order = sorted(have, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [3, 1, 2] * len(order), strict=False))
    budget, target, free = 1.5 * sum(have.values()), {}, set(order)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * have[s]}
        target |= {s: 2.0 * have[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    copies, taken = Counter(ids_of(after)), defaultdict(int)
    for i, n in copies.items():
        assert n <= 2
        taken[of[i]] += n * size[i]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)


def test_pack_holds_every_token_once(stages):
    before, after = stages["pack"]
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = Counter()
    for r in before.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.update((r["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    out = after.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def test_texts_longer_than_a_slice(spark):
    """Texts of twice a slice beside short ones: counts, links and tokens of whole texts."""
    words = [f"w{i}" for i in range(300_000)]
    texts = {1: " ".join(words), 2: "a b", 3: " ".join([*words, "more"]), 4: " ".join(reversed(words)), 5: " ".join(words[:100] * 2000)}
    assert len(texts[1]) > 2 * textvec.SLICE_BYTES > len(texts[5]) > textvec.SLICE_BYTES / 2
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string").coalesce(1)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert near == {1: (299_999, 1), 2: (1, 2), 3: (300_000, 1), 4: (299_999, 4), 5: (100, 5)}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").limit(0)
    rules = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_rules(docs, labels).collect()}
    chars = {k: len(t) - t.count(" ") for k, t in texts.items()}
    assert rules == {1: (300_000, chars[1], 0, False), 2: (2, 2, 0, True), 3: (300_001, chars[3], 0, False), 4: (300_000, chars[4], 0, False), 5: (200_000, chars[5], 200_000, True)}
    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()} == {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in texts.items()}
    assert ids_of(cotraining.quality_scores(docs, labels)) == [1, 2, 3, 4, 5]
