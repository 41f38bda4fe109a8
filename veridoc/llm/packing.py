"""Best-fit packing of documents into token sequences, by bin completion with branch-and-bound.

Only documents longer than a sequence are cut, into whole sequences and a rest. For packing the rests only the number of
each length matters, and there are fewer lengths than a sequence has tokens, so one search packs all rests of a corpus of
any size: it counts in fillings and how often each is used. Best fit, the longest first, gives the incumbent. If it has
more sequences than the lower bound, a depth-first search over fillings looks for a packing with fewer: a sequence is
filled around the longest rest that is left, by the undominated fillings (nothing left fits in, and no longer length
could take the place of a chosen one), and a filling is used as often as what is left allows, on the way back once less
each time. Fillings are enumerated as far as they are asked for: in runs of NODES nodes, of each run the least waste
first, and on the way back from a branch the next ones. A branch ends when its waste exceeds what a packing better than
the incumbent can have; the first that ends is completed by best fit, which may be a better incumbent. Only the steps of
the search are bounded: where they don't run out the packing has the fewest sequences (column proven), and where they do
the incumbent stays.

Rests of a length are numbered, those of a hash value after those of the values before, so that no task numbers all of a
length, and each takes the place of its number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LowerWords, WordIds
from .common import stored
from .textvec import Texts, over

SIZE = 2048
#: Parts of a length's rests that are numbered apart.
SALTS = 1024
#: Nodes in a run of the enumeration of one sequence's fillings, and of all searches of a packing.
NODES, STEPS = 300, 2_000_000
END = 0
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")

#: Sequences: each filling, as (length, how often) in order, and how many sequences have it.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def document_pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Every piece: n (row number), doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work() -> Callable:
        words = WordIds(LowerWords(path))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            t = Texts(batch.column(2))
            ids, at = words.of(t)
            ids = ids.astype("<u4")
            end = np.array([END], "<u4")
            row, piece, length, crc = [], [], [], []
            for k in range(t.n):
                own = np.concatenate((ids[at[k] : at[k + 1]], end))
                for p, s in enumerate(range(0, len(own), size)):
                    part = own[s : s + size]
                    row.append(k)
                    piece.append(p)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            take = pa.array(row, pa.int64())
            piece = np.array(piece, np.int32)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece), pa.array(piece.astype(np.int64) * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["n", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from over(work())(batches)

    rows = docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text")
    return rows.mapInArrow(run, f"n long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Left:
    """The lengths that are left, with their counts."""

    def __init__(self, counts: list[int]) -> None:
        self.counts = list(counts)
        self.distinct = [x for x, c in enumerate(counts) if c]

    def take(self, x: int, many: int) -> None:
        self.counts[x] -= many
        if not self.counts[x]:
            del self.distinct[bisect_left(self.distinct, x)]

    def give(self, x: int, many: int) -> None:
        if not self.counts[x]:
            insort(self.distinct, x)
        self.counts[x] += many


def sequences(plan: Plan) -> int:
    return sum(times for _, times in plan)


def best_fit(counts: list[int], size: int) -> Plan:
    """Each length, the longest first, goes where the least room is left over.

    The least room that a length fits in stays the least while copies of it go there, so a sequence takes as many of them
    as fit before the next one gets any, and sequences with one filling are filled together.
    """
    full: Plan = []
    rooms: list[int] = []  # distinct rooms, ascending
    at: dict[int, Plan] = {}  # fillings with such a room

    def put(room: int, filling: tuple, times: int) -> None:
        if not times:
            return
        if not room:
            full.append((filling, times))
            return
        if room not in at:
            at[room] = []
            insort(rooms, room)
        at[room].append((filling, times))

    for x in range(len(counts) - 1, 0, -1):
        many = counts[x]
        while many:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                room, filling, times = size, (), -(-many // (size // x))  # new sequences
            else:
                room = rooms[i]
                filling, times = at[room].pop()
                if not at[room]:
                    del rooms[i], at[room]
            k = room // x
            whole = min(times, many // k)
            rest = many - whole * k if whole < times else 0  # fewer than k, in one more sequence
            put(room - k * x, (*filling, (x, k)), whole)
            if rest:
                put(room - rest * x, (*filling, (x, rest)), 1)
            put(room, filling, times - whole - (rest > 0))
            many -= whole * k + rest
    return full + [part for room in rooms for part in at[room]]


def fewest(counts: list[int], size: int) -> int:
    """A lower bound on the sequences: for every k, lengths above half a sequence stand alone and those from k to half
    of one fill at most the room beside them, where lengths above size - k leave none."""
    n = np.asarray(counts, np.int64)
    x = np.arange(len(n))
    best = -(-int((n * x).sum()) // size)
    half = size // 2
    many, total = np.cumsum(n[::-1])[::-1], np.cumsum((n * x)[::-1])[::-1]  # of lengths from x on
    upto = lambda of, k: int(of[k]) if k < len(of) else 0
    for k in range(1, half + 1):
        big = upto(many, size - k + 1)
        middle = upto(many, half + 1) - big
        room = middle * size - (upto(total, half + 1) - upto(total, size - k + 1))
        small = upto(total, k) - upto(total, half + 1)
        best = max(best, big + middle + max(0, -(-(small - room) // size)))
    return best


class Steps:
    """Nodes that a search may still visit."""

    def __init__(self, left: int) -> None:
        self.left = left


def fillings(left: Left, size: int, most: int, steps: Steps) -> Iterator[tuple[int, list[int]]]:
    """(waste, lengths) of all undominated fillings around the longest length that waste at most `most`.

    Lengths are chosen in descending order, the longest first, so the first filling is the greedy one. A run ends after
    NODES nodes, or early at a filling without waste, and gives its fillings, the least waste first; the next run goes
    on from there. When the next filling is asked for, left must be as it was. A single length that fills the room
    dominates all other fillings.
    """
    counts, distinct = left.counts, left.distinct
    longest = distinct[-1]
    taken = {longest: 1}
    spare = lambda x: counts[x] > taken.get(x, 0)
    room = size - longest
    if 0 < room < len(counts) and spare(room):
        yield 0, [longest, room]
        return

    def dominated(waste: int) -> bool:
        """Something left fits in, or a longer length fits in the place of a chosen one."""
        for x in {0, *chosen}:
            for i in range(bisect_right(distinct, x), bisect_right(distinct, x + waste)):
                if spare(distinct[i]):
                    return True
        return False

    chosen = [longest]
    # of each depth: the next index to try, and whether nothing fitted so far
    at, leaf = [bisect_right(distinct, room) - 1], [True]
    found: list[tuple[int, list[int]]] = []
    nodes = 0
    while at and steps.left > 0:
        i = at[-1]
        while i >= 0 and not spare(distinct[i]):
            i -= 1
        if i >= 0:
            x = distinct[i]
            at[-1], leaf[-1] = i - 1, False
            taken[x] = taken.get(x, 0) + 1
            chosen.append(x)
            room -= x
            nodes += 1
            steps.left -= 1
            at.append(bisect_right(distinct, room, 0, i + 1) - 1)
            leaf.append(True)
            continue
        full = False
        if leaf[-1] and room <= most and not (room and dominated(room)):
            insort(found, (room, list(chosen)))
            full = room == 0
        at.pop()
        leaf.pop()
        if at:
            x = chosen.pop()
            taken[x] -= 1
            room += x
        if full or nodes >= NODES:
            yield from found
            found, nodes = [], 0
    yield from found


def bin_completion(counts: list[int], size: int, most: int, steps: Steps) -> Plan | None:
    """A packing into at most `most` sequences; None where there is none or the steps ran out."""
    left = Left(counts)
    waste_left = most * size - sum(x * c for x, c in enumerate(counts))
    path: list[tuple[list[int], int, Iterator[tuple[int, list[int]]]]] = []
    runs = lambda chosen: tuple((x, len([*same])) for x, same in groupby(chosen))
    plan = lambda: [(runs(chosen), times) for chosen, times, _ in path]
    options = fillings(left, size, waste_left, steps)
    ended = False
    while left.distinct:
        option = next(options, None)
        if option is None:
            if not ended:
                ended = True
                completed = plan() + best_fit(left.counts, size)
                if sequences(completed) <= most:
                    return completed
            if not path or steps.left <= 0:
                return None
            steps.left -= 1
            chosen, times, before = path.pop()
            waste_left += size - sum(chosen)
            for x, k in runs(chosen):
                left.give(x, k)
            options = before
            if times > 1:  # once less, and then something else
                path.append((chosen, times - 1, before))
                options = _without(chosen, fillings(left, size, waste_left, steps))
            continue
        waste, chosen = option
        times = min(left.counts[x] // k for x, k in runs(chosen))
        if waste:
            times = min(times, waste_left // waste)
        for x, k in runs(chosen):
            left.take(x, k * times)
        waste_left -= waste * times
        path.append((chosen, times, options))
        if left.distinct:
            options = fillings(left, size, waste_left, steps)
    return plan()


def _without(chosen: list[int], options: Iterator[tuple[int, list[int]]]) -> Iterator[tuple[int, list[int]]]:
    return (o for o in options if o[1] != chosen)


def search(counts: list[int], size: int, steps: int = STEPS) -> tuple[Plan, bool]:
    """A packing, and whether it is known to have the fewest sequences."""
    best, bound, budget = best_fit(counts, size), fewest(counts, size), Steps(steps)
    while sequences(best) > bound:
        better = bin_completion(counts, size, sequences(best) - 1, budget)
        if better is None:
            return best, budget.left > 0
        best = better
    return best, True


class Places:
    """Where the rests go that are numbered by length and then among those of one length."""

    def __init__(self, plan: Plan) -> None:
        parts, sequence = [], 0
        for filling, times in plan:
            offset = 0
            for x, k in filling:
                parts.append((x, k * times, sequence, k, offset))
                offset += x * k
            sequence += times
        parts.sort(key=lambda part: part[0])
        self.length, many, self.sequence, self.each, self.offset = np.array(parts, np.int64).reshape(-1, 5).T
        self.first = np.cumsum(many) - many

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        i = np.searchsorted(self.first, number, "right") - 1
        nth = number - self.first[i]
        return self.sequence[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * self.length[i]


def pack(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in as few sequences as bin completion finds."""
    plan, _ = search(np.bincount(lengths, minlength=size + 1).tolist(), size)
    number = np.empty(len(lengths), np.int64)
    number[np.argsort(lengths, kind="stable")] = np.arange(len(lengths))
    return Places(plan).of(number)


def numbered(rests: DataFrame, salts: int = SALTS) -> DataFrame:
    """rests with nth, which counts those of each length from 0. No task has all rests of a length."""
    rests = rests.withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32", "n"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = rests.groupBy("length", "salt").agg(F.count("*").alias("many"))
    parts = parts.select("length", "salt", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    among = Window.partitionBy("length", "salt").orderBy("doc_id", "ids_crc32", "n")
    rests = rests.withColumn("nth", F.row_number().over(among) - 1)
    return rests.join(parts, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("before")).drop("salt", "before")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, salts: int = SALTS) -> DataFrame:
    """Every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, proven.

    Null and empty texts are one token, the end. Repeated rows are packed one by one, rows with a null doc_id too; doc_id
    keeps its type and value, whatever it is. A text of any length is cut into whole sequences and a rest. Pieces of one
    length tie and may change places. An empty table gives an empty result; other columns of docs are not looked at.
    Sequence numbers are unique, not gapless. proven: whether no packing can have fewer sequences.
    """
    pieces = stored(document_pieces(docs, path, size))
    rests = pieces.where(F.col("length") < size)
    counts = np.zeros(size + 1, np.int64)
    for r in rests.groupBy("length").agg(F.count("*").alias("many")).collect():  # a row for each length
        counts[r["length"]] = r["many"]
    plan, proven = search(counts.tolist(), size)
    places, below = Places(plan), np.cumsum(counts) - counts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(below[batch.column(3).to_numpy()] + batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*COLUMNS, "sequence_id", "offset"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = numbered(rests, salts).select(*COLUMNS, "nth").mapInArrow(place, schema)
    # whole sequences take negative numbers
    whole = pieces.where(F.col("length") == size).select(*COLUMNS, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole).withColumn("proven", F.lit(proven))
