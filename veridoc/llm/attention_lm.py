"""Scores of texts by a causal self-attention model on subword ids, trained in numpy, and by word counts.

Model. Ids are mapped to M symbols: 0 the document's edge, the most frequent ids one each, all others the last one.
Symbols fall into CLASSES classes by the symbols that follow and precede them. The probability of an id is

    P(class | context) * P(symbol | class, symbol before) * P(id | symbol).

The first factor is the attention model's: softmax of log P(class | symbol before) plus the output of one causal
self-attention layer over the symbols of the window. The others are smoothed corpus counts. A text is its ids and then
the edge. In windows of WINDOW inputs, of which each scores its last STRIDE, every token is scored once, with at least
WINDOW - STRIDE symbols of context where the text has them.

Corpus. Ids, pairs of symbols and words are counted over all training documents. Attention trains on consecutive
windows of each of them, so every token is a target once. The windows are dealt to ROUNDS rounds by a hash of their
place; in a round, parts of its windows are trained apart from the same start and their parameters averaged. What
reaches the driver is bounded: tables of M symbols, the parameters, and the HEAD most frequent words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SpacedWords, WordIds
from .common import stored
from .textvec import Texts, give_back, keep_freed, over, slices

VOCABULARY = 50_257
M = 2048
CLASSES = 32
WIDTH = 16
WINDOW = 32
STRIDE = 20
#: Documents whose ids are handled at once, and windows that are made of them at once.
ROWS, WINDOWS = 200, 4096
ROUNDS = 2
#: Windows in a part, windows in a step, and the steps that a small part is repeated to.
PART, BATCH, STEPS = 4000, 64, 60
#: Words whose counts are broadcast (16 bytes each); the others are joined.
HEAD = 1_000_000
SMOOTH = 3.0


# ---- the model -------------------------------------------------------------------------------------------------


def shapes() -> list[tuple[int, ...]]:
    """Embeddings, query, key and value maps, distance bias, output map."""
    return [(M, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WINDOW,), (WIDTH, CLASSES)]


def unpack(p: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes():
        n = int(np.prod(shape))
        out.append(p[at : at + n].reshape(shape))
        at += n
    return out


def initial(seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    e, q, k, v, bias, u = (rng.normal(0, 0.3 / (1 if s[0] == M else np.sqrt(WIDTH)) if len(s) > 1 else 0, s) for s in shapes())
    return np.concatenate([x.ravel() for x in (e, q, k, v, bias, u * 0.1)]).astype(np.float32)


_DISTANCE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None]
_CAUSAL = np.where(_DISTANCE >= 0, 0, -1e9).astype(np.float32)


_ONES = {n: np.ones((n, 1), np.float32) for n in (WINDOW, CLASSES, WIDTH)}
#: Logits are held below this, in training and in scoring, so that no row's greatest must be sought first.
TOP = 30


def gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss over windows of symbols x (with -1: no input) and classes y (-1: no target), and its gradient."""
    e_, wq, wk, wv, bias, u = unpack(p)
    shape = (len(x), WINDOW, WIDTH)
    some = np.maximum(x, 0).ravel()
    e = e_.take(some, 0)
    root = np.float32(np.sqrt(WIDTH))
    q, k, v = (e @ (wq / root)).reshape(shape), (e @ wk).reshape(shape), (e @ wv).reshape(shape)
    a = q @ k.transpose(0, 2, 1)
    a += bias[np.maximum(_DISTANCE, 0)] + _CAUSAL
    np.minimum(a, TOP, out=a)
    np.exp(a, out=a)
    # weights stay as they are: what comes of them, half as wide, is divided by their sums instead
    sums = a.reshape(-1, WINDOW) @ _ONES[WINDOW]
    o = (a @ v).reshape(-1, WIDTH)
    o /= sums
    z = prior.take(some, 0)
    z += o @ u
    np.minimum(z, TOP, out=z)
    np.exp(z, out=z)
    goal = y.ravel()
    on = goal >= 0
    n = max(int(on.sum()), 1)
    at = np.arange(0, len(goal) * CLASSES, CLASSES) + np.maximum(goal, 0)
    flat = z.reshape(-1)
    total = (z @ _ONES[CLASSES])[:, 0]
    loss = -float(np.log(flat[at] / total + 1e-12) @ on) / n
    part = (on / np.float32(n)).astype(z.dtype)
    z *= (part / total)[:, None]
    flat[at] -= part
    du = o.T @ z
    do = z @ u.T
    do /= sums
    # the mean of a row of ds under its weights is that of do and o
    mean = (do * o) @ _ONES[WIDTH]
    do = do.reshape(shape)
    dv = a.transpose(0, 2, 1) @ do
    ds = do @ v.transpose(0, 2, 1)
    ds -= mean.reshape(len(x), WINDOW, 1)
    ds *= a
    dbias = np.bincount(np.maximum(_DISTANCE, 0).ravel(), ((np.ones(len(x), ds.dtype) @ ds.reshape(len(x), -1)).reshape(WINDOW, WINDOW) * (_DISTANCE >= 0)).ravel(), WINDOW)
    dq, dk, dv = ((ds @ k).reshape(-1, WIDTH), (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH), dv.reshape(-1, WIDTH))
    dwq, dwk, dwv = e.T @ dq / root, e.T @ dk, e.T @ dv
    de = dq @ (wq.T / root)
    de += dk @ wk.T
    de += dv @ wv.T
    cell = (some[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    dE = np.bincount(cell, de.ravel(), e_.size)
    return loss, np.concatenate([g.ravel() for g in (dE, dwq, dwk, dwv, dbias, du)]).astype(np.float32)


def train_part(p: np.ndarray, windows: np.ndarray, classes: np.ndarray, prior: np.ndarray, rate: float = 0.01) -> np.ndarray:
    """Adam over windows of WINDOW + 1 symbols (-1 after the text's end)."""
    p = p.copy()
    m, v, step = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    steps = -(-len(windows) // BATCH)
    for t in range(max(steps, min(STEPS, 20 * steps))):
        w = windows[(t % steps) * BATCH : (t % steps + 1) * BATCH]
        y = np.where(w[:, 1:] >= 0, classes[np.maximum(w[:, 1:], 0)], -1)
        _, g = gradient(p, w[:, :-1], y, prior)
        m *= np.float32(0.9)
        v *= np.float32(0.99)
        np.multiply(g, np.float32(0.1), out=step)
        m += step
        g *= step
        g *= np.float32(0.1)
        v += g
        np.multiply(v, np.float32(1 / (1 - 0.99 ** (t + 1))), out=step)
        np.sqrt(step, out=step)
        step += np.float32(1e-8)
        np.divide(m, step, out=step)
        step *= np.float32(rate / (1 - 0.9 ** (t + 1)))
        p -= step
    return p


class Scorer:
    """log10 probabilities of texts given as ids; the layer's maps are applied to the embeddings once."""

    def __init__(self, p: np.ndarray, tables: dict):
        e, wq, wk, wv, bias, u = unpack(p)
        self.tables, self.u = tables, u
        # a key that stands for no input is symbol M: its value has no weight
        self.q = e @ wq / np.float32(np.sqrt(WIDTH))
        self.k = np.concatenate([e @ wk, np.zeros((1, WIDTH), np.float32)])
        # one more dimension of the values, all ones, gives the sum of the weights
        self.v = np.concatenate([np.concatenate([e @ wv, np.ones((M, 1), np.float32)], 1), np.zeros((1, WIDTH + 1), np.float32)])
        lead = WINDOW - STRIDE
        self.bias = (bias[np.maximum(_DISTANCE, 0)] + _CAUSAL)[lead:]
        self.within = tables["within"].ravel()

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of texts whose ids begin at `at`.

        Texts stand one after the other, each from a multiple of STRIDE on with STRIDE places of no input before it, so
        that windows are views of one row of places, and their keys and values are looked up once a place.
        """
        tables, lead = self.tables, WINDOW - STRIDE
        many = np.diff(at) + 1  # tokens to score, the edge included
        n = len(many)
        total = np.zeros(n)
        if not n:
            return total
        if len(ids):
            total += np.bincount(np.repeat(np.arange(n), many - 1), tables["id_score"][ids], n)
        blocks = -(-many // STRIDE) + 1  # of STRIDE places, the one before the text included
        begin = (np.cumsum(blocks) - blocks + 1) * STRIDE  # the edge before the text; its i-th id is i places further
        key = np.full(int(blocks.sum()) * STRIDE + 1, M, np.int64)
        symbol = np.zeros(len(key), np.int64)  # as inputs and targets, places after the text's end are its edge
        if len(ids):
            of_ids = np.arange(len(ids)) + np.repeat(begin + 1 - at[:-1], many - 1)
            key[of_ids] = symbol[of_ids] = tables["symbol"][ids]
        key[begin] = 0
        row = np.repeat(np.arange(n), blocks)
        last = (begin + many)[row]  # scored are the places before this one
        for k in range(1, len(row), 256):
            r = row[k : k + 256]
            first, end = k * STRIDE, (k + len(r)) * STRIDE
            near = key[first - lead : end]
            keys, values = (np.ascontiguousarray(t.take(near, 0)) for t in (self.k, self.v))
            view = lambda t: np.lib.stride_tricks.as_strided(t, (len(r), WINDOW, t.shape[1]), (STRIDE * t.strides[0], *t.strides), writeable=False)  # noqa: B023, E731
            x, y = symbol[first:end], symbol[first + 1 : end + 1]
            a = self.q.take(x, 0).reshape(len(r), STRIDE, WIDTH) @ view(keys).transpose(0, 2, 1)
            a += self.bias
            np.minimum(a, TOP, out=a)
            np.exp(a, out=a)
            o = (a @ view(values)).reshape(-1, WIDTH + 1)
            z = tables["prior"].take(x, 0)
            z += (o[:, :WIDTH] / np.maximum(o[:, WIDTH:], np.float32(1e-37))) @ self.u
            np.minimum(z, TOP, out=z)
            got = z.ravel()[np.arange(0, len(x) * CLASSES, CLASSES) + tables["class"][y]]
            np.exp(z, out=z)
            score = got - np.log((z @ _ONES[CLASSES])[:, 0]) + self.within[x * M + y]
            place = np.arange(first, end).reshape(len(r), STRIDE)
            scored = (place >= begin[r, None]) & (place < last[k : k + 256, None])
            total += np.bincount(r, np.where(scored, score.reshape(place.shape), 0).sum(-1), n)
        return total / np.log(10)


# ---- counts and tables -----------------------------------------------------------------------------------------


def symbol_tables(id_counts: np.ndarray, documents: int) -> dict:
    """symbol of each id, and log P(id | symbol)."""
    order = np.argsort(-id_counts, kind="stable")[: M - 2]
    order = order[id_counts[order] > 0]
    symbol = np.full(VOCABULARY, M - 1, np.int16)
    symbol[order] = np.arange(1, len(order) + 1)
    rare = symbol == M - 1
    score = np.zeros(VOCABULARY, np.float32)
    score[rare] = np.log((id_counts[rare] + 0.1) / (id_counts[rare].sum() + 0.1 * rare.sum()))
    return {"symbol": symbol, "id_score": score, "documents": documents}


def class_tables(pairs: np.ndarray) -> dict:
    """From counts of (symbol, next symbol): classes, log P(class | symbol before) and log P(symbol | class, symbol before)."""
    # rows by what follows and precedes, in a few dimensions, then k-means
    often = np.argsort(-pairs.sum(0), kind="stable")[:256]
    sides = [np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1)) for m in (pairs[:, often], pairs[often].T)]
    x = np.concatenate(sides, 1)
    weight = np.sqrt(pairs.sum(0) + pairs.sum(1))
    _, vectors = np.linalg.eigh((x * weight[:, None]).T @ (x * weight[:, None]))
    x = x @ vectors[:, -24:]
    centre = x[np.argsort(-weight, kind="stable")[:CLASSES]].copy()
    for _ in range(25):
        of = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, 1)
        for c in range(CLASSES):
            if weight[of == c].sum() > 0:
                centre[c] = np.average(x[of == c], axis=0, weights=weight[of == c])
    follows = pairs.sum(0) + 0.1
    in_class = np.bincount(of, follows, CLASSES) + 1e-9
    member = np.zeros((M, CLASSES))
    member[np.arange(M), of] = 1
    by_class = pairs @ member
    prior = np.log((by_class + SMOOTH * in_class / in_class.sum()) / (by_class.sum(1, keepdims=True) + SMOOTH))
    within = np.log((pairs + SMOOTH * follows / in_class[of]) / (by_class[:, of] + SMOOTH))
    return {"class": of.astype(np.int64), "prior": prior.astype(np.float32), "within": within.astype(np.float32)}


def lookup(hashes: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the wanted hashes, -1 for those not in the sorted hashes."""
    if not len(hashes):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, counts[at], -1)


def arrow(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def word_counts(rows: DataFrame) -> DataFrame:
    """Of training rows (text): word hash, count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            parts = [np.unique(Texts(b.column(0), lower=True).hashes(), return_counts=True) for b in slices(batch)]
            if parts:
                h, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield arrow("hash count", h.view(np.int64), np.bincount(which, np.concatenate([p[1] for p in parts])).astype(np.int64))
            give_back()

    return rows.mapInArrow(work, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))


def encoded(rows: DataFrame, path: str, head: tuple[np.ndarray, np.ndarray], ends: int, base: tuple[int, int]) -> DataFrame:
    """Of each row (n, doc_id, held_out, text): its words, ids, base score of the words in head, and the other words' hashes.

    base: N and V of the base model; ends: training documents.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(head)
    total = np.log10(base[0] + 0.1 * (base[1] + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        hashes, counts = shared.value
        words = WordIds(SpacedWords(path))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            t = Texts(batch.column(3), lower=True)
            ids, at = words.of(t)
            distinct, which = words.distinct, words.which
            c = lookup(hashes, counts, distinct)[which]
            score = np.bincount(t.row, np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.1) - total, 0), t.n) + np.log10(ends + 0.1) - total
            known = np.bincount(t.row, c > 0, t.n).astype(np.int64) + (ends > 0)
            rest = np.flatnonzero(c < 0)
            rest_at = np.concatenate(([0], np.cumsum(np.bincount(t.row[rest], minlength=t.n)))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(rest_at), pa.array(distinct[which[rest]].view(np.int64)))
            ids = ids.astype("<u2")
            coded = pa.array([ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            return arrow("n doc_id held_out n_tokens head_score head_known rest ids", batch.column(0), batch.column(1), batch.column(2), t.words + 1, score, known, rest, coded)

        yield from over(one)(batches)

    return rows.mapInArrow(work, f"n long, doc_id {kind}, held_out boolean, n_tokens long, head_score double, head_known long, rest array<long>, ids binary")


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(x.as_buffer(), "<u2") for x in column]
    return (np.concatenate(raw) if raw else np.zeros(0, "<u2")), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of ROWS rows, so that memory is that of some documents."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def table_of_ids(train: DataFrame) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for part in few(batches):
            total += np.bincount(ids_of(part.column(0))[0], minlength=VOCABULARY)
        yield arrow("id count", np.flatnonzero(total), total[total > 0])

    out = np.zeros(VOCABULARY, np.int64)
    # a row for each id of the vocabulary at most
    for r in train.select("ids").mapInArrow(work, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toLocalIterator():
        out[r["id"]] = r["count"]
    return out


def table_of_pairs(train: DataFrame, symbol: np.ndarray) -> np.ndarray:
    """Counts of pairs of neighbouring symbols over all training texts, edges included: M * M numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total = np.zeros(M * M, np.int32)
        for part in few(batches):
            ids, at = ids_of(part.column(0))
            s = np.zeros(len(ids) + len(at), np.int64)
            s[np.arange(len(ids)) + np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1] = symbol[ids]
            key, many = np.unique(s[:-1] * M + s[1:], return_counts=True)
            total[key] += many.astype(np.int32)
        on = np.flatnonzero(total)
        yield arrow("pair count", on.astype(np.int32), total[on])
        del total
        give_back()

    sums = train.select("ids").mapInArrow(work, "pair int, count int").groupBy("pair").agg(F.sum("count").alias("count"))
    got = sums.select("pair", F.col("count").cast("double").alias("count")).toArrow()  # M * M rows at most
    out = np.zeros(M * M)
    out[got.column("pair").to_numpy()] = got.column("count").to_numpy()
    return out.reshape(M, M)


def training_windows(train: DataFrame, symbol: np.ndarray) -> DataFrame:
    """Consecutive windows of each text: w, WINDOW + 1 symbols, -1 after the end, of which the first is the one before.

    Every token, the edge at the end included, is a target of one window. n: row number; place: where the window begins.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few(batches):
            ids, at = ids_of(part.column(1))
            many = np.diff(at) + 1  # targets
            windows = -(-many // WINDOW)
            row = np.repeat(np.arange(len(many)), windows)
            first = (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
            for k in range(0, len(row), WINDOWS):
                r, f = row[k : k + WINDOWS], first[k : k + WINDOWS]
                place = f[:, None] + np.arange(WINDOW + 1)
                inside = (place >= 1) & (place < many[r, None])
                w = np.where(place <= many[r, None], 0, -1).astype("<i2")
                w[inside] = symbol[ids[(at[r, None] + place - 1)[inside]]]
                offsets = np.arange(len(w) + 1, dtype=np.int32) * (2 * (WINDOW + 1))
                yield arrow("n place w", part.column(0).take(pa.array(r)), f, pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(w))]))

    return train.select("n", "ids").mapInArrow(work, "n long, place long, w binary")


def averaged(parts: DataFrame) -> np.ndarray | None:
    """The weighted mean of parameters (weight, p), summed over ever fewer tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, None
        for batch in batches:
            for w, p in zip(batch.column(0), batch.column(1), strict=True):
                p = np.frombuffer(p.as_buffer(), np.float64)
                weight, total = weight + w.as_py(), p if total is None else total + p
        if total is not None:
            yield arrow("weight p", np.array([weight]), pa.array([total.tobytes()], pa.binary()))

    for tasks in (256, 8):
        parts = parts.repartition(tasks).mapInArrow(add, "weight double, p binary")
    rows = parts.collect()  # 8 rows at most
    return sum(np.frombuffer(r["p"], np.float64) for r in rows) / sum(r["weight"] for r in rows) if rows else None


def dealt(windows: DataFrame, rounds: int, many: int) -> DataFrame:
    """Windows (n, place, w) with the turn they are trained in, in partitions of some PART windows of each turn.

    Turn, partition and order come from the window's place, not its content, so equal windows are apart.
    """
    salt = F.xxhash64("n", "place")
    rows = windows.select("w", salt.alias("salt"), F.pmod(F.xxhash64(F.lit("turn"), "n", "place"), F.lit(rounds)).alias("turn"))
    return rows.repartition(max(1, -(-many // (rounds * PART))), "salt").sortWithinPartitions("salt")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The windows in runs of 2 * PART rows at most; a partition of dealt windows, some PART rows, is mostly one run."""
    have: list[np.ndarray] = []
    many = 0
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        own = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i2").reshape(len(column), WINDOW + 1) if len(column) else np.zeros((0, WINDOW + 1), "<i2")
        while len(own):
            own, more = own[: 2 * PART - many], own[2 * PART - many :]
            have.append(own.astype(np.int64))
            many += len(own)
            own = more
            if many == 2 * PART:
                yield np.concatenate(have)
                have, many = [], 0
    if many:
        yield np.concatenate(have)


def trained(train: DataFrame, tables: dict, rounds: int = ROUNDS) -> np.ndarray:
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((tables["class"], tables["prior"]))
    many = train.agg(F.sum(F.ceil((F.octet_length("ids") / 2 + 1) / WINDOW))).first()[0] or 0
    parts = stored(dealt(training_windows(train, tables["symbol"]), rounds, many))
    p = initial()
    for k in range(rounds):
        start = spark.sparkContext.broadcast(p)

        def work(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            keep_freed()
            for w in runs(batches):
                out = train_part(start.value, w, *shared.value)
                yield arrow("weight p", np.array([float(len(w))]), pa.array([(out.astype(np.float64) * len(w)).tobytes()], pa.binary()))
            give_back()

        mean = averaged(parts.where(F.col("turn") == k).select("w").mapInArrow(work, "weight double, p binary"))
        p = p if mean is None else mean.astype(np.float32)
    return p


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """Of each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty and has one token, its end. A null doc_id counts as an empty string. Without training documents
    the base score is that of no counts and the model's tables are uniform. Repeated rows are scored one by one.
    """
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    rows = docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", held.alias("held_out"), "text")
    counts = stored(word_counts(rows.where("not held_out").select("text")))
    ends = rows.where("not held_out").count()
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    # the least power of two that HEAD words at most reach
    levels = {r["level"]: r["n"] for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    level = max(levels, default=0) + 1
    while level > 0 and sum(n for k, n in levels.items() if k >= level - 1) <= HEAD:
        level -= 1
    top = counts.where(F.col("count") >= 2**level).toArrow()  # HEAD rows at most
    hashes = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    head = (hashes[order], top.column("count").to_numpy()[order])
    coded = stored(encoded(rows, path, head, ends, (total, distinct)))
    train = coded.where("not held_out")
    tables = symbol_tables(table_of_ids(train), ends)
    pairs = table_of_pairs(train, tables["symbol"])
    tables |= class_tables(pairs)
    p = trained(train, tables)
    shared = spark.sparkContext.broadcast((p, tables))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        model = Scorer(*shared.value)
        for part in few(batches):
            yield arrow("n score", part.column(0), model(*ids_of(part.column(1))))
        del model
        give_back()

    scores = coded.select("n", "ids").mapInArrow(score, "n long, score double")
    # words outside the head: joined with their counts
    log = float(np.log10(total + 0.1 * (distinct + 1)))
    rest = coded.select("n", F.explode("rest").alias("hash")).groupBy("n", "hash").agg(F.count(F.lit(1)).alias("many")).join(counts, "hash", "left")
    c = F.coalesce("count", F.lit(0))
    rest = rest.groupBy("n").agg(F.sum(F.col("many") * (F.log10(c + F.lit(0.1)) - F.lit(log))).alias("rest_score"), F.sum(F.when(c > 0, F.col("many")).otherwise(0)).alias("rest_known"))
    out = coded.drop("ids", "rest").join(scores, "n").join(rest, "n", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rest_score", F.lit(0.0))).alias("base_score"), "score",
    )
