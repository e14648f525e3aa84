"""Who hands in a motion: names after set phrases, and the block of signatures at its end."""

from __future__ import annotations

import re
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that names follow, and forms of address before a name.
PHRASES = r"(?i)(?:ingediend|ondertekend|mede.?ondertekend)\s+door[:\s]+(.+?)(?:\.\s|\n|$)"
CALLED = r"(?i)^(?:de heer|mevrouw|wethouder|raadslid|burgemeester)\s+"
#: Characters at the end of a text where signatures stand; a longer line isn't one.
BLOCK, LINE = 500, 60
PARTY = re.compile(r"\s*\([^)]*\)\s*$")


def is_name(line: str) -> bool:
    return len(line) < LINE and "A" <= line[0] <= "Z"


def signed(text: str) -> list[str]:
    """The lines at a text's end that look like names, from the last one up to the first line that doesn't; empty lines don't count."""
    upwards = filter(None, map(str.strip, reversed(text[-BLOCK:].split("\n"))))
    return [name for name in (PARTY.sub("", line).strip() for line in takewhile(is_name, upwards)) if name]


def raw_names(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, raw: every name that a text gives, in order: those after phrases, then the signatures from the last one up."""
    phrased = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PHRASES), F.lit(1))

    def tails(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[key], b["_told"], pa.array([signed(x) for x in b["_tail"].to_pylist()], pa.list_(pa.string()))], [key, "_told", "_signed"])

    kind = texts.schema[key].dataType.simpleString()
    tail = F.right(F.coalesce(F.col(text), F.lit("")), F.lit(BLOCK))
    rows = texts.select(key, phrased.alias("_told"), tail.alias("_tail")).mapInArrow(tails, f"`{key}` {kind}, _told array<string>, _signed array<string>")
    split = lambda x: F.split(F.regexp_replace(x, r"\s+en\s+", ", "), ",")
    names = F.flatten(F.transform(F.concat("_told", "_signed"), split))
    cleaned = F.transform(names, lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))
    return rows.select(key, F.posexplode(F.filter(cleaned, lambda x: F.length(x) > 1)).alias("at", "raw"))


def submitters(texts: DataFrame, key: str, text: str, registry: DataFrame) -> DataFrame:
    """key, place (from 1), name: the submitters of each text, each once. registry: term (lower case), name; a name is known by all of it, else by its
    last word; one that isn't known stays as it is, without form of address and party."""
    raw = raw_names(texts, key, text)
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace("raw", CALLED, "")), r"\s*\([^)]*\)\s*$", ""))
    rows = raw.withColumn("_plain", plain).withColumn("_low", F.lower("_plain"))
    last = F.when(F.size(F.split("_low", r"\s+")) > 1, F.regexp_extract("_low", r"(\S+)$", 1))
    known = registry.groupBy(F.lower("term").alias("_term")).agg(F.min("name").alias("_name"))
    whole = rows.withColumn("_last", last).join(known.withColumnsRenamed({"_term": "_low", "_name": "_whole"}), "_low", "left")
    found = whole.join(known.withColumnsRenamed({"_term": "_last", "_name": "_part"}), "_last", "left")
    named = found.select(key, "at", F.coalesce("_whole", "_part", F.when(F.col("_plain") != "", F.col("_plain")), F.trim("raw")).alias("name")).filter(F.length("name") > 1)
    first = named.groupBy(key, F.lower("name").alias("_low")).agg(F.min(F.struct("at", "name")).alias("x"))
    each = first.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("all"))  # the submitters of one text
    return each.select(key, F.posexplode("all").alias("p", "x")).select(key, (F.col("p") + 1).cast("long").alias("place"), "x.name")
