"""Payloads of codes as rows, for SQL: a table function that takes a readable value apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

ATTRIBUTE = re.compile(r'([A-Za-z_][\w-]*)="([^"]*)"')
#: A key ends at the first colon that doesn't stand between digits.
COLON = re.compile(r"(?<![0-9]):|:(?![0-9])")


def entries(value: str | None) -> Iterator[tuple[str, str]]:
    """Keys in normal form and their values: attributes of XML, or lines, else parts between bars, else between commas; of one key the first value with text."""
    if value is None:
        return
    if value.lstrip().startswith("<"):
        pairs = ATTRIBUTE.findall(value)
    else:
        parts = re.split(r"[\r\n]+", value) if re.search(r"[\r\n]", value) else value.split("|" if "|" in value else ",")
        pairs = [tuple(COLON.split(p, maxsplit=1)) for p in parts if COLON.search(p)]
    seen = set()
    for name, text in pairs:
        key, text = re.sub("[^a-z0-9]", "", name.lower()), text.strip(" ")
        if key and text and key not in seen:
            seen.add(key)
            yield key, text


@udtf(returnType="place int, key string, value string")
class PayloadEntries:
    """FROM codes, LATERAL payload_entries(value): the place of an entry from 0, its key and its value."""

    def eval(self, value: str) -> Iterator[tuple[int, str, str]]:
        yield from ((i, k, v) for i, (k, v) in enumerate(entries(value)))


def register(spark: SparkSession) -> None:
    spark.udtf.register("payload_entries", PayloadEntries)
