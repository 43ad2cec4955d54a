"""Dictionary segmentation of ideographic text, synonyms, short-token merging and weighted query terms."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.weights import term_weight
from docloom.runtime import small


def segment(text: str, words: dict[str, float], longest: int = 8) -> list[str]:
    """Most likely words of a run by their frequencies; characters outside the dictionary stand alone.

    One dynamic program over all cuts (a longest match in either direction is one of them), with the logarithm of
    the relative frequency as score and a fixed one for unknown characters.
    """
    total = sum(words.values()) or 1.0
    unknown = math.log(0.5 / total)
    n = len(text)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            w = text[i:j]
            score = math.log(words[w] / total) if w in words else unknown if j - i == 1 else None
            if score is not None and best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, i
    out, j = [], n
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


def segmented(df: DataFrame, text: str, words: dict[str, float], out: str = "words") -> DataFrame:
    """Add the words of a text: ideographic runs segmented, the rest split at blanks. Null texts give none."""
    import re

    cast = df.schema
    names = df.columns

    def run(batches):
        for b in batches:
            got = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                parts = re.findall(r"[一-龥]+|[^一-龥\s]+", t or "")
                got.append([w for p in parts for w in (segment(p, words) if "一" <= p[0] <= "龥" else [p.lower()])])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.string()))], names=[*names, out])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*cast.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def with_synonyms(terms: DataFrame, synonyms: DataFrame, most: int = 8, share: float = 0.25) -> DataFrame:
    """Query terms with their synonyms at a quarter of the weight. synonyms: term, syn (array); at most ``most`` per term."""
    extra = terms.join(small(synonyms.select("term", F.explode(F.slice("syn", 1, most)).alias("_s"))), "term").where("_s <> term").select("query_id", F.col("_s").alias("term"), (F.col("weight") * share).alias("weight"))
    return terms.select("query_id", "term", "weight").unionByName(extra).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def merged_short(words: Column) -> Column:
    """Runs of words of one or two characters joined: up to four as one, longer ones in pairs."""
    short = lambda w: F.length(w) <= 2
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    flush = lambda s: F.concat(s["out"], F.when(F.size(s["run"]) == 0, F.array().cast("array<string>")).when(F.size(s["run"]) <= 4, F.array(F.array_join(s["run"], " "))).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(s["run"]) - 1) / 2).cast("int")), lambda i: F.array_join(F.slice(s["run"], i * 2 + 1, F.lit(2)), " "))))
    return F.aggregate(words, start, lambda s, w: F.when(short(w), F.struct(s["out"].alias("out"), F.array_append(s["run"], w).alias("run"))).otherwise(F.struct(F.array_append(flush(s), w).alias("out"), F.array().cast("array<string>").alias("run"))), lambda s: flush(s))


def phrases(words: Column) -> Column:
    """(first, second, boost) of adjacent terms: twice the larger weight."""
    n = F.size(words)
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("second"), (2 * F.greatest(term_weight(a), term_weight(b))).alias("boost"))
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), pair))


def with_frequency(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add frequency and class (term, frequency, tag) of a dictionary's words: 0 and '' for words it does not have."""
    known = dictionary.select("term", F.col("frequency").alias("_f"), F.col("tag").alias("_t"))
    return terms.join(small(known), "term", "left").withColumn("frequency", F.coalesce("_f", F.lit(0))).withColumn("tag", F.coalesce("_t", F.lit(""))).drop("_f", "_t")
