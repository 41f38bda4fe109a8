"""Periodic runs of words, by Gusfield and Stoye's linear method for tandem repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends, of at least LEAST words and TIMES periods. A stretch like that is made of overlapping squares (a root of q
words twice), so the method finds squares first:

1. LZ blocks. A square that occurs first at some place has its centre in a block and reaches no further than the next
   one. For each block and each root length, one look ahead and one look back from the block's borders tell whether
   there is such a square. The squares found cover all others leftmost: each other one is a rotation of one of them.
2. Vocabulary. From the place of a found square in the suffix tree, its suffix link and one step down by the word that
   was left behind lead to the square rotated by a word. Walks go on until they leave the tree or meet a square that is
   known; then all distinct squares are known.
3. Runs. The leaves below a square's place are its occurrences. Occurrences of squares of one primitive root length that
   start at consecutive words are one run.

The suffix tree is a suffix array with the lengths of common prefixes of neighbours: a place in the tree is the interval
of the suffixes below it, a suffix link the interval around the suffix that starts one word later. All of it works on
whole numpy arrays, for a slice of texts at a time.

Only stretches of words that recur take part: in a run, any LEAST / TIMES words recur q words on or back, so words that
lie in no such recurring passage of their text are in no run, and the stretches between them can be looked at alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words
from .textvec import Texts, mix, over

LEAST = 24
TIMES = 3


class SuffixTree:
    """Of a sequence of numbers that ends in one found nowhere else.

    order: suffixes sorted; rank: place of each suffix; common: words that a suffix shares with the one sorted before it.
    """

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        self.s = s
        #: names[k][i]: equal for equal passages of 2**k words; passages over the end differ from all others
        self.names = [np.unique(s, return_inverse=True)[1].astype(np.int32)]
        while True:
            name, width = self.names[-1], 1 << (len(self.names) - 1)
            if name.max() == n - 1:
                break
            key = name.astype(np.int64) * (n + 1)
            key[: n - width] += name[width:] + 1
            at = np.argsort(key, kind="stable")
            fresh = np.diff(key[at], prepend=-1) != 0
            new = np.empty(n, np.int32)
            new[at] = np.cumsum(fresh) - 1
            self.names.append(new)
        self.rank = self.names[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        common = np.zeros(n, np.int32)
        common[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.least = [common]
        while 2 << (len(self.least) - 1) <= n:
            last, width = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-width], last[width:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j share from their start, i and j being different."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            out += (self.names[k][i + out] == self.names[k][j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words shared by what ends in i and what ends in j, looking back; nothing before the start."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            same = (a >= 0) & (b >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            out += same.astype(np.int64) << k
        return out

    def place(self, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffixes that share the first depth words of the suffix of that rank."""
        low, high = rank.astype(np.int64), rank.astype(np.int64)
        for k in range(len(self.least) - 1, -1, -1):
            least, width = self.least[k], 1 << k
            to = low - width
            low = np.where((to >= 0) & (least[np.maximum(to + 1, 0)] >= depth), to, low)
            to = high + width
            high = np.where((to < self.n) & (least[np.minimum(high + 1, len(least) - 1)] >= depth), to, high)
        return low, high

    def step(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """First suffix of the interval whose word after depth words isn't below word."""
        high = high + 1
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high) // 2
            less = open_ & (self.s[np.minimum(self.order[np.minimum(middle, self.n - 1)] + depth, self.n - 1)] < word)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)

    def blocks(self) -> np.ndarray:
        """Starts of the LZ blocks: each is the longest passage that also starts earlier, or one new word."""
        order = self.order.tolist()
        before, after = [-1] * self.n, [-1] * self.n
        stack: list[int] = []
        for i in order:
            while stack and stack[-1] > i:
                after[stack.pop()] = i
            before[i] = stack[-1] if stack else -1
            stack.append(i)
        here, length = np.arange(self.n), np.zeros(self.n, np.int64)
        for near in (np.array(before), np.array(after)):
            has = near >= 0
            length[has] = np.maximum(length[has], self.ahead(here[has], near[has]))
        step, out, i = np.maximum(length, 1).tolist(), [], 0
        while i < self.n:
            out.append(i)
            i += step[i]
        return np.array(out)


def _up_to(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n its index, repeated, and the numbers 1 to n."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(1, len(of) + 1) - (np.cumsum(n) - n)[of]


def leftmost(t: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """Squares that cover all others leftmost: starts and root lengths."""
    start = t.blocks()
    end = np.append(start[1:], t.n)
    length = end - start
    found = []
    # squares whose right half reaches into the next block
    of, k = _up_to(length[:-1])
    border = end[of]
    may = t.s[border] == t.s[border - k]
    border, k = border[may], k[may]
    left = border - k
    ahead, behind = t.ahead(border, left), t.behind(border - 1, left - 1)
    good = ahead + behind >= k
    found.append((np.maximum(left - behind, left - k + 1)[good], k[good]))
    # squares that start before the block
    of, k = _up_to(length + np.append(length[1:], 0))
    border, stop = start[of], end[of]
    may = (border > 0) & (border + k < t.n)
    border, k, stop = border[may], k[may], stop[may]
    may = (t.s[border] == t.s[border + k]) & (t.s[border - 1] == t.s[border + k - 1])
    border, k, stop = border[may], k[may], stop[may]
    ahead, behind = t.ahead(border, border + k), t.behind(border - 1, border + k - 1)
    first = np.maximum(border - behind, border - k + 1)
    good = (ahead + behind >= k) & (first + k <= stop)
    found.append((first[good], k[good]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def primitive(t: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the root of the square at start is no repetition of a shorter one."""
    out, rest, p = np.ones(len(k), bool), k.copy(), 2
    while len(rest) and rest.max() > 1:
        # the primes up to the root of the largest rest, and then each rest itself, which is a prime
        small = p * p <= rest.max()
        by = np.full(len(k), p) if small else rest
        hit = np.flatnonzero((by > 1) & (rest % by == 0))
        shift = k[hit] // by[hit]
        out[hit] &= t.ahead(start[hit], start[hit] + shift) < 2 * k[hit] - shift
        if not small:
            break
        while len(hit):
            rest[hit] //= p
            hit = hit[rest[hit] % p == 0]
        p += 1
    return out


def vocabulary(t: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """All distinct squares with primitive roots: the first suffix that starts with each, and root lengths."""
    start, k = leftmost(t)
    keep = primitive(t, start, k)
    start, k = start[keep], k[keep]
    seen: set[int] = set()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        # along its own text a square turns as long as the period goes on; all these turns are taken at once
        turns = np.minimum(t.ahead(start, start + k) - k, k - 1) + 1
        of, nth = _up_to(turns)
        at, size = start[of] + nth - 1, k[of]
        low, _ = t.place(t.rank[at], 2 * size)
        new = np.zeros(len(at), bool)
        for i, key in enumerate((low * (t.n + 1) + size).tolist()):
            if key not in seen:
                seen.add(key)
                new[i] = True
        found.append((low[new], size[new]))
        # where the period ends there, the suffix link and a step down by the word left behind lead to another text
        last = np.cumsum(turns) - 1
        last = last[new[last] & (turns < k)]
        at, k = at[last], size[last]
        under, to = t.place(t.rank[at + 1], 2 * k - 1)
        next_ = t.step(under, to, 2 * k - 1, t.s[at])
        there = next_ <= to
        there[there] = t.s[t.order[next_[there]] + 2 * k[there] - 1] == t.s[at[there]]
        start, k = t.order[next_[there]], k[there]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def repetitions(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least two periods in s, whose last number is found nowhere else: starts, lengths, periods."""
    t = SuffixTree(s)
    low, k = vocabulary(t)
    _, high = t.place(low, 2 * k)
    of, nth = _up_to(high - low + 1)
    key = np.sort(k[of] * t.n + t.order[low[of] + nth - 1])
    first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    many = np.diff(np.append(first, len(key)))
    period, start = np.divmod(key[first], t.n)
    return start, many - 1 + 2 * period, period


def recurring(h: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a passage of size words that occurs again in their row; h: a hash of each word, row: its text."""
    n, inside = len(h), np.zeros(len(h) + 1, np.int64)
    if n >= size:
        value = mix(row[: n - size + 1].astype(np.uint64))
        for k in range(size):
            value = mix(value + h[k : n - size + 1 + k])
        at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
        at = at[np.argsort(value[at], kind="stable")]
        same = value[at[1:]] == value[at[:-1]]
        at = np.unique(np.concatenate((at[1:][same], at[:-1][same])))
        inside[at] += 1
        inside[at + size] -= 1
    return np.cumsum(inside)[:-1] > 0


def runs_of(h: np.ndarray, row: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """Runs in rows of words, given a hash of each word and its row: first word (of all words), length and period, by first word and period."""
    at = np.flatnonzero(recurring(h, row, least // times))
    cut = np.flatnonzero((np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])) + 1
    edges = np.concatenate(([0], cut, [len(at)]))
    long = np.diff(edges) >= least
    at = at[np.repeat(long, np.diff(edges))]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    size = np.diff(edges)[long]
    # each stretch ends in a number of its own; place: words of all words, -1 at those numbers
    ends = np.cumsum(size)
    place = np.insert(at, ends, -1)
    s = np.insert(np.unique(h[at], return_inverse=True)[1].astype(np.int64), ends, len(at) + np.arange(len(size)))
    start, length, period = repetitions(s)
    keep = length >= np.maximum(least, times * period)
    start, length, period = place[start[keep]], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Of each document: doc_id, n_words, runs (start, length, period, by start and period), collapsed: its words joined by one space without those that a run has after its first period.

    Words are what stands between ASCII white space. Null, empty and blank texts have no words, no runs and an empty
    collapsed text; repeated rows and null ids give a row each; an empty table gives an empty result; other columns of
    docs aren't looked at. A text is looked at whole, whatever its length, in one task: memory is some 300 bytes for
    each of its words that recur.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(batch.column(1))
        start, length, period = runs_of(t.hashes(), t.row, least, times) if len(t.starts) else (np.zeros(0, np.int64),) * 3
        of = t.row[start]
        dropped = np.zeros(len(t.starts) + 1, np.int64)
        np.add.at(dropped, start + period, 1)
        np.add.at(dropped, start + length, -1)
        kept = np.cumsum(dropped)[:-1] == 0
        partly = np.unique(of)
        texts = []
        for i in range(t.n):
            have = t.raw[t.at[i] : t.at[i + 1]].tobytes().split()
            texts.append(b" ".join(have))
        for i in partly.tolist():
            have = t.raw[t.at[i] : t.at[i + 1]].tobytes().split()
            texts[i] = b" ".join([have[j] for j in np.flatnonzero(kept[t.first[i] : t.first[i + 1]]).tolist()])
        found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - t.first[of], length, period)], fields=list(run))
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=t.n)))), pa.int32()), found)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(t.words, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(over(work), f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by doc_id, repeat a passage to their end: doc_id, text.

    With h the CRC-32 of doc_id and g a tenth of it, rounded down: where h ends in 0 and the text has words, each word
    from a = g % n on becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8). Documents without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), words(F.col("text"))))
    g = F.floor(F.col("_h") / 10)
    n = F.greatest(F.size("_w"), F.lit(1))
    a = (g % n).cast("int")
    p = F.floor((n - a) / (g % 8 + 3)).cast("int") + 1
    rows = rows.withColumn("_a", a).withColumn("_p", p)
    again = F.transform(F.sequence("_a", F.size("_w") - 1), lambda i: F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    text = F.when(F.col("_w").isNotNull() & (F.size("_w") > 0), F.array_join(F.concat(F.slice("_w", 1, F.col("_a")), again), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of the rows of collapse_runs: doc_id, n_runs, the run of the greatest length by period (ties: first start, then period) or nulls, and digests of all runs and of the collapsed text."""

    def greater(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)

    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.get(F.array_sort("runs", greater), 0)
    rows = found.withColumn("_best", best)
    top = {c: F.col("_best")[c] for c in ("start", "length", "period")}
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[v.alias(k) for k, v in top.items()], F.floor(top["length"] * 1000 / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
