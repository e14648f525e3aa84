"""Entities of texts out of dictionaries of any size: n-grams meet a table by equality."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.relops import distinct_on

#: Words of a dictionary's longest entries.
LONGEST = 3


def word_array(text: Column) -> Column:
    """Lowered words: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(rows: DataFrame, words: Column, longest: int = LONGEST) -> DataFrame:
    """rows with n, at, gram: every run of 1 to longest words of a row."""
    rows = rows.withColumn("_words", words)
    one = lambda n: F.transform(F.sequence(F.lit(0), F.size("_words") - n), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.array_join(F.slice("_words", i + 1, n), " ").alias("gram")))
    none = F.array().cast("array<struct<n:int,at:int,gram:string>>")
    grams = F.concat(*[F.when(F.size("_words") >= n, one(n)).otherwise(none) for n in range(1, longest + 1)])
    return rows.withColumn("_g", F.explode(grams)).select(*[c for c in rows.columns if c != "_words"], "_g.*")


def dictionary_hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """key, n, at, name of every place where an entry of dictionary (term, name) stands in a text."""
    entries = dictionary.select(F.array_join(word_array(F.col("term")), " ").alias("gram"), "name").filter("gram != ''")
    entries = entries.groupBy("gram").agg(F.min("name").alias("name"))
    return ngrams(texts.select(key, F.col(text).alias("_text")), word_array(F.col("_text")), longest).join(entries, "gram").select(key, "n", "at", "name")


def names_in_order(hits: DataFrame, key: str) -> DataFrame:
    """key, place (from 1), name: each name of a text once, the longest entries first, then as they stand in the text."""
    first = distinct_on(hits, [key, "name"], [F.desc("n"), F.col("at")])
    each = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "name"))).alias("all"))
    return each.select(key, F.posexplode("all").alias("p", "x")).select(key, (F.col("p") + 1).alias("place"), "x.name")


def apart(hits: DataFrame, key: str) -> DataFrame:
    """Of hits, those that share no word: the longest entries are taken first, then as they stand in the text. A text's hits are one small array."""
    each = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "at", "name"))).alias("all"))
    each = each.select(key, *[F.col("all").getField(c).alias(c) for c in ("less", "at", "name")])

    def taken(batches):
        for batch in batches:
            own, out = [], []
            for i, columns in enumerate(zip(batch["less"], batch["at"], batch["name"], strict=True)):
                words: set[int] = set()
                for less, at, name in zip(*(c.as_py() for c in columns), strict=True):
                    mine = range(at, at - less)
                    if words.isdisjoint(mine):
                        words.update(mine)
                        own.append(i)
                        out.append((-less, at, name))
            left = batch[key].take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([left, *[pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [(), (), ()], (pa.int32(), pa.int32(), pa.string()), strict=True)]], [key, "n", "at", "name"])

    return each.mapInArrow(taken, f"`{key}` {hits.schema[key].dataType.simpleString()}, n int, at int, name string")


def query_entities(questions: DataFrame, key: str, text: str, registry: DataFrame, gazetteer: DataFrame, nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """key, name, node, kind, confidence, origin of the entities that a question names.

    Persons of the registry (term, name; terms of three characters at least) come before names of the gazetteer (term, name); a name counts once,
    by its first origin. nodes (node, kind, name) gives what stands for a name in the graph: a Person before others for the registry's, the
    least node on ties; without one it stays, as Unknown if it is no person."""
    found = [
        dictionary_hits(questions, key, text, source, longest).select(key, "name").distinct().withColumns({"confidence": F.lit(conf), "origin": F.lit(origin), "_order": F.lit(i)})
        for i, (source, conf, origin) in enumerate([(registry.filter(F.length("term") >= 3), 1.0, "politician_registry"), (gazetteer, 0.9, "gazetteer")])
    ]
    once = distinct_on(found[0].unionByName(found[1]).withColumn("_low", F.lower("name")), [key, "_low"], [F.col("_order"), F.col("name")])
    known = nodes.groupBy(F.lower("name").alias("_low")).agg(
        F.min(F.struct((F.col("kind") != "Person").alias("x"), "node", "kind")).alias("person"), F.min(F.struct("node", "kind")).alias("any")
    )
    rows = once.join(known, "_low", "left").withColumn("of", F.when(F.col("_order") == 0, F.struct("person.node", "person.kind")).otherwise(F.struct("any.node", "any.kind")))
    kind = F.coalesce(F.when(F.col("_order") == 0, F.lit("Person")), F.col("of.kind"), F.lit("Unknown"))
    return rows.select(key, "name", F.col("of.node").alias("node"), kind.alias("kind"), "confidence", "origin")
