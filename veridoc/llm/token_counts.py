"""Token counts without token ids: pieces are counted once per distinct pre-token.

A byte-level tokenizer first splits a text into pre-tokens, and merges never cross them. So each distinct pre-token of
the corpus is encoded once, and a document's count is the sum of its pre-tokens' counts. The library's special string
inside a text is one token and parts the text around it, as is the library's default.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import stored

#: The split of byte-level BPE vocabularies, white space being what has the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The most frequent pre-tokens, so many at most, are broadcast (a hash and a count each, 16 bytes); the others' join shuffles.
HEAD = 1_000_000
#: Entries of the map from pre-token to hash that a Python worker keeps.
KEPT = 300_000
LIMIT = 1024


def splitter(path: str):
    """A function from a text to its pre-tokens and special strings."""
    with open(path) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    find = regex.compile(PATTERN).findall
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def split(text: str) -> list[str]:
        if cut is None or not cut.search(text):
            return find(text)
        out: list[str] = []
        end = 0
        for m in cut.finditer(text):
            out += find(text[end : m.start()])
            out.append(m[0])
            end = m.end()
        return out + find(text[end:])

    return split


def hash_of(token: str) -> tuple[int, int]:
    """96 bits as a long and an int: among 10^11 pre-tokens two with one hash are not to be expected."""
    h = xxhash.xxh3_128_intdigest(token.encode("utf-8", "surrogatepass"))
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64 & (1 << 32) - 1) - (1 << 31)


def hash_columns(hashes: Iterable[tuple[int, int] | None]) -> list[pa.Array]:
    pairs = [h or (None, None) for h in hashes]
    return [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int32())]


class Hashes(dict):
    """Pre-token to hash, emptied when it is full."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= KEPT:
            self.clear()
        value = self[token] = hash_of(token)
        return value


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Distinct pre-tokens of the corpus: hash, check, pieces, many (how often the corpus has it)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(path), Counter()

        def out() -> pa.RecordBatch:
            names = list(seen)
            return pa.RecordBatch.from_arrays([*hash_columns(map(hash_of, names)), pa.array(names, pa.string()), pa.array(seen.values(), pa.int64())], ["hash", "check", "token", "many"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    seen.update(split(text))
                if len(seen) >= KEPT:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        merge, special = t.model.tokenize, {x.content for x in t.get_added_tokens_decoder().values()}
        for batch in batches:
            many = [1 if x in special else len(merge(byte_letters(x))) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(many, pa.int64()), batch.column(3)], ["hash", "check", "pieces", "many"])

    found = docs.select("text").mapInArrow(tokens, "hash long, check int, token string, many long")
    distinct = found.groupBy("hash", "check").agg(F.first("token").alias("token"), F.sum("many").alias("many"))
    return distinct.mapInArrow(count, "hash long, check int, pieces long, many long")


def frequencies(rows: DataFrame, path: str) -> DataFrame:
    """Of rows (n, doc_id, text): n, doc_id, n_bytes, hash, check, many for each distinct pre-token of each row; hash null for a row without any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, hashes = splitter(path), Hashes()
        for batch in batches:
            take: list[int] = []
            size: list[int] = []
            hashed: list[tuple[int, int] | None] = []
            many: list[int] = []

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:  # noqa: B008
                at = pa.array(take, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(size, pa.int64()), *hash_columns(hashed), pa.array(many, pa.int64())], ["n", "doc_id", "n_bytes", "hash", "check", "many"])

            for k, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                found = Counter(split(text))
                take += [k] * max(len(found), 1)
                size += [len(text.encode())] * max(len(found), 1)
                hashed += [hashes[t] for t in found] or [None]
                many += list(found.values()) or [0]
                if len(take) > 100_000:
                    yield out()
                    for x in (take, size, hashed, many):
                        x.clear()
            if take:
                yield out()

    return rows.mapInArrow(work, f"n long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, hash long, check int, many long")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Of each document: doc_id, n_bytes, n_tokens, over_limit.

    Null text is empty and has no tokens; a text of any length counts whole. An empty table gives an empty result; other
    columns of docs are not looked at. Repeated rows, and rows with a null doc_id, are counted one by one: rows carry a number of their own, which
    need not be the same in a rerun. Rows of one document leave a task together, so the sum shuffles a row per document.
    """
    known = stored(pieces(docs, path))
    # the least power of two that HEAD pre-tokens at most reach in frequency
    levels = {r["level"]: r["n"] for r in known.groupBy(F.floor(F.log2("many")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    level = max(levels, default=0) + 1
    while level > 0 and sum(n for k, n in levels.items() if k >= level - 1) <= HEAD:
        level -= 1
    often = F.col("many") >= 2**level
    head = known.where(often).select("hash", "check", F.col("pieces").cast("int").alias("pieces"))
    tail = known.where(~often).select(F.col("hash").alias("tail"), F.col("check").alias("tail_check"), F.col("pieces").alias("tail_pieces"))
    found = frequencies(docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text"), path)
    met = found.join(F.broadcast(head), ["hash", "check"], "left")  # HEAD rows at most
    row = ["n", "doc_id", "n_bytes"]
    # what the head knows becomes one row per document in the task that read it; the rest keeps a row per pre-token
    unmet = F.col("pieces").isNull()
    summed = met.groupBy(*row, F.when(unmet, F.col("hash")).alias("rest"), F.when(unmet, F.col("check")).alias("rest_check")).agg(F.sum(F.coalesce(F.col("many") * F.col("pieces"), F.lit(0))).alias("tokens"), F.sum("many").alias("many"))
    # rows without a rest get keys of their own, or they would all meet in one task
    joined = summed.withColumn("key", F.coalesce("rest", F.xxhash64("n"))).join(tail, (F.col("key") == F.col("tail")) & (F.col("rest_check") == F.col("tail_check")), "left")
    total = joined.groupBy(*row).agg(F.sum(F.col("tokens") + F.coalesce(F.col("many") * F.col("tail_pieces"), F.lit(0))).cast("long").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
