"""Quality rules: a calibrated logistic regression on hashed word and character n-grams, and counts with fixed thresholds.

The model is trained on labelled rows, SAMPLE of them at most, chosen by a hash of doc_id. A text's features are the
shares of its hashed words, word pairs and runs of four bytes, each kind summing to one, so a score needs one weight
lookup per n-gram and no sorting. A quarter of the sample is held out to calibrate the probability. Scoring goes over
whole texts in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .textvec import Texts, give_back, mix, over

SAMPLE = 3000
#: Buckets of each kind of n-gram, a power of two.
BUCKETS = 1 << 16
KEEP_AT = 0.4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def ngrams(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows of the words, word pairs and 4-byte runs of texts."""
    h = t.hashes()
    same = t.row[1:] == t.row[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    b = t.raw.astype(np.uint32)
    run = (b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)) if len(b) > 3 else np.zeros(0, np.uint32)
    run = (run * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    many = np.diff(t.at)
    inside = np.maximum(many - 3, 0)
    at = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside) + np.repeat(t.at[:-1], inside)
    return [((h >> top).astype(np.int64), t.row), ((pair >> top).astype(np.int64), t.row[:-1][same]), (run[at].astype(np.int64), np.repeat(np.arange(t.n), inside))]


def features(t: Texts) -> linear.Sparse:
    """For training: distinct buckets and their shares."""
    index, row, value = [], [], []
    for kind, (bucket, of) in enumerate(ngrams(t)):
        key, count = np.unique(of * BUCKETS + bucket, return_counts=True)
        r = key // BUCKETS
        index.append(key % BUCKETS + kind * BUCKETS)
        row.append(r)
        value.append(count / np.bincount(of, minlength=t.n)[r])
    index, row, value = map(np.concatenate, (index, row, value))
    order = np.argsort(row, kind="stable")
    return linear.Sparse(index[order], value[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=t.n)))))


def logits(t: Texts, w: np.ndarray, b: float) -> np.ndarray:
    z = np.full(t.n, b)
    for kind, (bucket, of) in enumerate(ngrams(t)):
        many = np.bincount(of, minlength=t.n)
        z += np.bincount(of, w[kind * BUCKETS : (kind + 1) * BUCKETS][bucket], t.n) / np.maximum(many, 1)
    return z


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> pa.Table:
    """At most `most` rows (doc_id, y, index, value) with a label, the first by a hash of doc_id.

    Tasks make the features of whole texts; no text comes to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `most` rows at most
    texts = rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = features(Texts(batch.column(2))).packed()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1))], ["doc_id", "y", "index", "value"])

    got = texts.mapInArrow(over(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, index binary, value binary")
    # as Arrow, so that neither the JVM nor Python makes rows of it
    found = got.toArrow()
    ids = [str(x) for x in found.column("doc_id").to_pylist()]
    order = pa.array(sorted(range(len(ids)), key=ids.__getitem__), pa.int64())
    columns = found.columns
    names = found.column_names
    del found
    for k in range(len(columns)):  # one at a time, so that two copies of all don't stand in memory together
        columns[k] = columns[k].take(order)
    return pa.table(columns, names)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """Weights, bias and calibration. Without labelled rows every text gets probability 0.5."""
    rows = labelled_sample(docs, labels, label, sample)
    y = rows.column("y").to_numpy()
    x = linear.Sparse.unpacked(rows.column("index"), rows.column("value"))
    del rows
    held = np.arange(len(y)) % 4 == 3
    w, b = linear.fit(x, y, 3 * BUCKETS, l2=1e-7, weight=np.where(held, 0.0, 1.0))
    a, c = linear.calibrate((x.dot(w) + b)[held], y[held])
    del x
    give_back()  # the sample was most of the driver's memory
    return {"w": w.astype(np.float32), "b": b, "a": a, "c": c}


def counts(t: Texts) -> dict[str, np.ndarray]:
    """Per row: words, code points in words, symbols, repeated lines and words in repeated three-word windows."""
    n = t.n

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[t.at[1:]] - total[t.at[:-1]]

    in_word = np.zeros(len(t.raw) + 1, np.int8)
    np.add.at(in_word, t.starts, 1)
    np.add.at(in_word, t.ends, -1)
    solid = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": t.words, "word_chars": per_row(solid & (t.raw & 0xC0 != 0x80)), "n_symbols": per_row(SYMBOLS[t.raw])}
    # lines: from the start of a row or after \n to \n or the end of the row
    breaks = np.flatnonzero(t.raw == 10)
    full = np.flatnonzero(np.diff(t.at) > 0)
    starts = np.sort(np.concatenate((t.at[full], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, t.at[full + 1])))
    of = np.searchsorted(t.at, np.minimum(starts, len(t.raw) - 1), "right") - 1 if len(starts) else starts
    # a \n that ends a row begins an empty line there, which has no word
    before = np.concatenate(([0], np.cumsum(solid)))
    wordy = before[np.maximum(ends, starts)] > before[starts]
    of, lines = of[wordy], t.hashes(starts[wordy], ends[wordy])
    distinct = np.unique(np.stack([of.astype(np.uint64), lines]), axis=1)[0].astype(np.int64) if len(of) else of
    out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(distinct, minlength=n)
    h = t.hashes()
    if len(h) >= 3:
        same = t.row[2:] == t.row[:-2]
        window = mix(mix(h[:-2] + t.row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(5) + mix(h[1:-1]) * np.uint64(3) + h[2:])[same]
        _, which, many = np.unique(window, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(same)[many[which] > 1]
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[twice + k] = True
        out["n_repeat_words"] = np.bincount(t.row[hit], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def judge(t: Texts, model: dict) -> dict[str, np.ndarray]:
    out = counts(t)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["quality"] = linear.sigmoid(model["a"] * logits(t, model["w"], model["b"]) + model["c"])
    out["kept"] = ~out["base_failed"] & (out["quality"] >= KEEP_AT)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    Null and empty texts have no words and fail; texts of any length count whole. Repeated rows are judged one by one,
    whatever their doc_id, null too. Of labels that differ for one doc_id the greater holds. An empty table gives an empty
    result; other columns of docs are not looked at.
    """
    model = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = judge(Texts(batch.column(1)), model)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k]) for k in names]], ["doc_id", *names])

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
    return docs.select("doc_id", "text").mapInArrow(over(work), schema)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge(Texts(batch.column(at)), model)["kept"]))

    return docs.mapInArrow(over(work), docs.schema)
