"""Quality classifier by co-training.

Two views of a document: its text content (hashed words) and its page metadata (language, source, length, line and
character layout). A classifier per view is trained on labelled rows; for some rounds each scores all documents without labels, in
tasks, and gives those of which it is surest, with its pseudo-labels, to the other's training set. At the end both are
calibrated on held-out labelled rows, and a small regression on the two calibrated log odds gives one probability.

Toxic documents are not kept either. Metadata can't tell them, so they are no matter for exchange: a second classifier
of the text view finds them by the presence of the words and word beginnings that set labelled toxic rows apart.

Training takes at most SAMPLE labelled rows, the first by a hash of doc_id, and what is given: GIVEN documents of each
kind, view and round at most, so that what a view is sure of doesn't outweigh the labels. Tasks read the texts; the driver
gets hashed features of those rows. Scoring goes over whole texts of all documents in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import stored
from .textvec import Texts, give_back, over

SAMPLE = 4000
ROUNDS = 3
#: Documents of each kind that a view gives per round at most, and the probability from which it is sure.
GIVEN, SURE = 200, 0.97
#: Words and beginnings that the toxic classifier looks at, at most, and the steps that fit it.
TELLING, STEPS = 256, 150
WORDS = 1 << 18
PREFIX = 4
MIN_DOCS = 4
META = 1 << 10
KEEP_AT = 0.3
TOXIC_AT = 0.5
COLUMNS = ("text", "lang", "source")


def presence(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs."""
    key = np.unique(row * WORDS + (hashes >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64))
    return key // WORDS, key % WORDS


def text_view(row: np.ndarray, bucket: np.ndarray, n: int, idf: np.ndarray) -> linear.Sparse:
    """Presence of words times idf, rows of length one; words with idf 0 are left out."""
    value = idf[bucket]
    row, bucket, value = row[value > 0], bucket[value > 0], value[value > 0]
    norm = np.sqrt(np.bincount(row, value * value, n))
    return linear.Sparse(bucket, value / norm[row], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))))


def beginnings(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of lower-case words and of their first PREFIX bytes; t is lower-cased."""
    begin = t.hashes(t.starts, np.minimum(t.starts + PREFIX, t.ends)) * np.uint64(0x9E3779B97F4A7C15)
    return presence(np.concatenate((t.row, t.row)), np.concatenate((t.hashes(), begin)))


def toxic_view(row: np.ndarray, bucket: np.ndarray, n: int, use: np.ndarray) -> linear.Sparse:
    """Which of the telling words and beginnings a text has."""
    on = use[bucket]
    row, bucket = row[on], bucket[on]
    return linear.Sparse(bucket, np.ones(len(row)), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))))


def pairs(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the rows' buckets."""
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    return row, np.concatenate([np.zeros(0, np.int32), *lists])


def train_toxic(rows: list[dict]) -> dict:
    """The TELLING buckets that are most significantly more frequent in toxic rows, and a calibrated regression on them."""
    rows = [r for r in rows if r["toxic"] is not None]
    y = np.array([float(r["toxic"]) for r in rows])
    held = np.arange(len(y)) % 4 == 3
    n1, n0 = ((y > 0) & ~held).sum(), ((y == 0) & ~held).sum()
    use, none = np.zeros(WORDS, bool), {"use": np.zeros(WORDS, bool), "w": np.zeros(WORDS, np.float32), "b": -30.0, "cal": (1.0, 0.0)}
    if not n1 or not n0:
        return none
    every = pairs([r["begin"] for r in rows])
    row, bucket = every[0][~held[every[0]]], every[1][~held[every[0]]]
    of1, of0 = np.bincount(bucket[y[row] > 0], minlength=WORDS), np.bincount(bucket[y[row] == 0], minlength=WORDS)
    share = (of1 + of0) / (n1 + n0)
    z = (of1 / n1 - of0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    best = np.argsort(-z, kind="stable")[:TELLING]
    use[best[(z[best] > 3) & ((of1 + of0)[best] >= MIN_DOCS)]] = True
    x = toxic_view(*every, len(y), use)
    w, b = linear.fit(x, y, WORDS, 1e-5, STEPS, 0.1, weight=np.where(held, 0.0, 1.0))
    return {"use": use, "w": w.astype(np.float32), "b": b, "cal": linear.calibrate((x.dot(w) + b)[held], y[held])}


def _bucket(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={value}".encode()) % META


def meta_view(t: Texts, langs: list, sources: list) -> linear.Sparse:
    """One bucket for each of some properties of the page."""

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[t.at[1:]] - total[t.at[:-1]]

    size = np.maximum(np.diff(t.at), 1)
    upper, digits = per_row((t.raw >= 65) & (t.raw <= 90)) / size, per_row((t.raw >= 48) & (t.raw <= 57)) / size
    marks = per_row((t.raw < 127) & (t.raw > 32) & ~((t.raw | 32 >= 97) & (t.raw | 32 <= 122))) / size
    lines = per_row(t.raw == 10) + 1
    level = lambda x: np.minimum(np.floor(x * 40), 20).astype(int).tolist()
    columns = {
        "lang": langs, "source": sources, "length": np.log2(size).astype(int).tolist(), "lines": np.log2(lines).astype(int).tolist(), "upper": level(upper), "digits": level(digits), "marks": level(marks),
        "line": np.log2(size / lines).astype(int).tolist(), "word": np.minimum(size / np.maximum(t.words, 1), 15).astype(int).tolist(),
    }
    seen: dict = {}
    index = np.empty((t.n, len(columns)), np.int64)
    for k, (name, values) in enumerate(columns.items()):
        index[:, k] = [seen[name, v] if (name, v) in seen else seen.setdefault((name, v), _bucket(name, v)) for v in values]
    return linear.Sparse(index.ravel(), np.full(index.size, 1 / 3), np.arange(t.n + 1) * len(columns))


def featured(rows: DataFrame, names: list[str]) -> list[dict]:
    """Rows (names, text, lang, source) with text, layout and beginnings as buckets: words, meta, begin. Tasks read the texts."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", words binary, meta binary, begin binary"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        got = features(get("text"), get("lang").to_pylist(), get("source").to_pylist())
        return pa.RecordBatch.from_arrays([*map(get, names), *(pa.array([x.tobytes() for x in got[k]], pa.binary()) for k in got)], [*names, *got])

    found = rows.select(*names, *COLUMNS).mapInArrow(over(work), schema).toArrow()  # no rows of it in the JVM nor in Python
    buckets = {k: np.split(all_, at[1:-1]) if len(at) > 1 else [] for k in ("words", "meta", "begin") for all_, at in [linear.joined(found.column(k), np.int32)]}
    return [dict(zip([*names, *buckets], r, strict=True)) for r in zip(*(found.column(c).to_pylist() for c in names), *buckets.values(), strict=True)]


def features(texts: pa.Array, langs: list, sources: list) -> dict[str, list[np.ndarray]]:
    """Of each row its distinct buckets of words, of the page's properties and of beginnings."""
    t, low = Texts(texts), Texts(texts, lower=True)
    split = lambda row, bucket: np.split(bucket.astype(np.int32), np.cumsum(np.bincount(row, minlength=t.n))[:-1])
    meta = meta_view(t, langs, sources)
    return {"words": split(*presence(t.row, t.hashes())), "meta": split(meta.row, meta.index), "begin": split(*beginnings(low))}


def sample(docs: DataFrame, labels: DataFrame, most: int) -> list[dict]:
    """At most `most` rows (doc_id, y, toxic, words, meta, begin) with a label, the first by a hash of doc_id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("y"), (F.max("toxic") > 0).alias("toxic"))
    first = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", *COLUMNS).join(F.broadcast(first), "doc_id")  # `most` rows at most
    one = rows.groupBy("doc_id", "y", "toxic").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "source")).alias("r"))
    return sorted(featured(one.select("doc_id", "y", "toxic", "r.*"), ["doc_id", "y", "toxic"]), key=lambda r: str(r["doc_id"]))


def surest(docs: DataFrame, known: DataFrame, model: dict, given: list) -> list:
    """Of all documents without a label: GIVEN of each view and kind at most, of those the view is sure of, the surest first.

    given: (doc_id, view) that a view has given before. Rows (doc_id, view, value, words, meta, begin).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        t = Texts(get("text"))
        out = []
        for v, x in enumerate(view_rows(t, get("lang").to_pylist(), get("source").to_pylist(), model["idf"])):
            a, c = model["cal"][v]
            p = linear.sigmoid(a * (x.dot(model["w"][v]) + model["b"][v]) + c)
            out += [(np.flatnonzero(sure >= SURE), v, value, sure) for sure, value in ((p, 1.0), (1 - p, 0.0))]
        at = np.concatenate([o[0] for o in out])
        many = [len(o[0]) for o in out]
        columns = [batch.column(0).take(pa.array(at)), pa.array(np.repeat([o[1] for o in out], many).astype(np.int32)), pa.array(np.repeat([o[2] for o in out], many)), pa.array(np.concatenate([o[3][o[0]] for o in out]))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "view", "value", "sure"])

    rows = docs.select("doc_id", *COLUMNS).where("doc_id is not null")
    sure = rows.mapInArrow(over(work), f"doc_id {kind}, view int, value double, sure double").join(known.select("doc_id"), "doc_id", "left_anti")
    if given:
        sure = sure.join(F.broadcast(docs.sparkSession.createDataFrame(given, f"doc_id {kind}, view int")), ["doc_id", "view"], "left_anti")
    sure = stored(sure.groupBy("doc_id", "view", "value").agg(F.max("sure").alias("sure")))
    best = [sure.where((F.col("view") == v) & (F.col("value") == value)).orderBy(F.col("sure").desc(), F.xxhash64("doc_id"), "doc_id").limit(GIVEN) for v in range(2) for value in (0.0, 1.0)]
    chosen = stored(reduce(DataFrame.unionByName, best).drop("sure"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # 4 * GIVEN rows at most, but for repeated doc_ids
    one = rows.groupBy("doc_id", "view", "value").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "source")).alias("r"))
    return sorted(featured(one.select("doc_id", "view", "value", "r.*"), ["doc_id", "view", "value"]), key=lambda r: (str(r["doc_id"]), r["view"], r["value"]))


def view_rows(t: Texts, langs: list, sources: list, idf: np.ndarray) -> list[linear.Sparse]:
    return [text_view(*presence(t.row, t.hashes()), t.n, idf), meta_view(t, langs, sources)]


def train(rows: list[dict], rounds: int = ROUNDS, ask: Callable[[dict, list], list] | None = None) -> dict:
    """ask: from a model and what has been given, the rows that its views give; without it they give of the rows without y."""
    rows = list(rows)
    idf, views = np.zeros(WORDS), []

    def add_views() -> None:
        nonlocal idf, views
        words, meta = pairs([r["words"] for r in rows]), pairs([r["meta"] for r in rows])
        seen = np.bincount(words[1], minlength=WORDS)
        idf = np.where(seen >= MIN_DOCS, np.log((1 + len(rows)) / (1 + seen)), 0.0).clip(0)
        at = np.concatenate(([0], np.cumsum([len(r["meta"]) for r in rows]))).astype(np.int64)
        views = [text_view(*words, len(rows), idf), linear.Sparse(meta[1], np.full(len(meta[1]), 1 / 3), at)]

    add_views()
    sizes, l2 = (WORDS, META), (1e-6, 1e-5)
    y = np.array([float("nan") if r["y"] is None else float(r["y"]) for r in rows])
    labelled = np.flatnonzero(~np.isnan(y))
    held = labelled[3::4]
    pool = np.flatnonzero(np.isnan(y))
    guess = [y.copy(), y.copy()]  # what each view's training set says
    first, given, place = rows, [], {}
    models = []
    for k in range(rounds + 1):
        models = []
        for v in range(2):
            trust = np.where(np.isnan(guess[v]), 0.0, np.where(np.isnan(y), 0.5, 1.0))
            trust[held] = 0
            models.append(linear.fit(views[v], guess[v], sizes[v], l2[v], weight=trust))
        if k == rounds or not (len(pool) or ask) or not len(held):
            break
        if ask:
            model = {"idf": idf.astype(np.float32), "w": [w.astype(np.float32) for w, _ in models], "b": [b for _, b in models]}
            model["cal"] = [linear.calibrate((views[v].dot(models[v][0]) + models[v][1])[held], y[held]) for v in range(2)]
            got = ask(model, given)
            given = given + [(r["doc_id"], r["view"]) for r in got]
            fresh = {r["doc_id"]: r for r in got if r["doc_id"] not in place}
            place |= {i: len(rows) + n for n, i in enumerate(fresh)}
            rows = rows + [*fresh.values()]
            y, *guess = (np.concatenate((a, np.full(len(fresh), np.nan))) for a in (y, *guess))
            pool = np.flatnonzero(np.isnan(y))
            for r in got:
                other = guess[1 - r["view"]]
                if np.isnan(other[place[r["doc_id"]]]):
                    other[place[r["doc_id"]]] = r["value"]
            add_views()
            continue
        for v in range(2):
            z = views[v].dot(models[v][0]) + models[v][1]
            a, c = linear.calibrate(z[held], y[held])
            p = linear.sigmoid(a * z + c)
            other = guess[1 - v]
            free = pool[np.isnan(other[pool])]
            for sure, value in ((p[free], 1.0), (1 - p[free], 0.0)):
                order = np.argsort(-sure, kind="stable")[:GIVEN]
                other[free[order[sure[order] >= SURE]]] = value
    z = np.stack([views[v].dot(models[v][0]) + models[v][1] for v in range(2)], 1)
    cal = [linear.calibrate(z[held, v], y[held]) for v in range(2)]
    both = np.stack([cal[0][0] * z[held, 0] + cal[0][1], cal[1][0] * z[held, 1] + cal[1][1], np.ones(len(held))], 1)
    mixed = linear.newton(both, y[held], np.array([0.5, 0.5, 0.0]), ridge=1.0) if len(held) and y[held].min() != y[held].max() else np.array([0.5, 0.5, 0.0])
    return {"idf": idf.astype(np.float32), "toxic": train_toxic(first), "w": [models[0][0].astype(np.float32), models[1][0].astype(np.float32)], "b": [models[0][1], models[1][1]], "cal": cal, "mix": mixed, "given": [int((~np.isnan(g[pool])).sum()) for g in guess]}


def scores(batch: pa.RecordBatch, model: dict) -> dict[str, np.ndarray]:
    """Calibrated probabilities of good quality by the text view, the metadata view and both, of being toxic, and the verdict."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    t = Texts(get("text"))
    views = view_rows(t, get("lang").to_pylist(), get("source").to_pylist(), model["idf"])
    z = [model["cal"][v][0] * (views[v].dot(model["w"][v]) + model["b"][v]) + model["cal"][v][1] for v in range(2)]
    m = model["mix"]
    toxic = model["toxic"]
    bad = toxic_view(*beginnings(Texts(get("text"), lower=True)), t.n, toxic["use"]).dot(toxic["w"]) + toxic["b"]
    out = {"text_score": linear.sigmoid(z[0]), "meta_score": linear.sigmoid(z[1]), "score": linear.sigmoid(m[0] * z[0] + m[1] * z[1] + m[2]), "toxic_score": linear.sigmoid(toxic["cal"][0] * bad + toxic["cal"][1])}
    return out | {"kept": (out["score"] >= KEEP_AT) & (out["toxic_score"] < TOXIC_AT)}


RESULT = {"text_score": "double", "meta_score": "double", "score": "double", "toxic_score": "double", "kept": "boolean"}


def corpus_model(docs: DataFrame, labels: DataFrame, originals: DataFrame | None = None) -> dict:
    """Trained on labelled rows, of originals if given, and what the views give of all docs without labels."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()
    model = train(sample(docs if originals is None else originals, labels, SAMPLE), ask=lambda model, given: surest(docs, known, model, given))
    give_back()  # the training rows were most of the driver's memory
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each document: doc_id, text_score, meta_score, score, toxic_score, kept (score at least KEEP_AT and not toxic).

    Nulls in text, language or source are values like others; texts of any length count whole. Without labelled rows of
    both kinds the scores are the smoothed share of good rows and nothing is toxic. Repeated rows are scored one by one, and
    rows with a null doc_id too, which have no label and give none. Of labels that differ for one doc_id the greater holds.
    An empty table gives an empty result; other columns of docs are not looked at.
    """
    model = corpus_model(docs, labels)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = scores(batch, model)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k]) for k in RESULT]], ["doc_id", *RESULT])

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *[f"{k} {t}" for k, t in RESULT.items()]])
    return docs.select("doc_id", *COLUMNS).mapInArrow(over(work), schema)


def keep_good(docs: DataFrame, labels: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier keeps, with all their columns. The labelled rows are those of originals if given."""
    model = corpus_model(docs, labels, originals)
    return docs.mapInArrow(over(lambda batch: batch.filter(pa.array(scores(batch, model)["kept"]))), docs.schema)
