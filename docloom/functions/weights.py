"""Term weights and similarities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Boost of each searched field.
FIELD_BOOSTS = {"title": 10.0, "title_fine": 5.0, "keywords": 30.0, "keyword_tokens": 20.0, "questions": 20.0, "content": 2.0, "content_fine": 1.0}


def _idf(s: float, n: float) -> float:
    return math.log10(10 + (n - s + 0.5) / (s + 0.5))


def _raw(kind: float, freq: float, df: float) -> float:
    return (0.3 * _idf(freq, 1e7) + 0.7 * _idf(df, 1e9)) * kind


#: (pattern, weight) by class of token, first match wins; the closed form with empty dictionaries.
TERM_CLASSES = [
    (r"^[a-z]{1,2}$", _raw(0.01, 300, 300)),
    (r"^[a-z. -]+$", _raw(1, 300, 300)),
    (r"^(?:[0-9]+[0-9.]+|[0-9.]{2,})$", _raw(2, 3, 5)),
    (r"^[0-9. -]{2,}$", _raw(1, 3, 5)),
    (r"^[0-9,.]{2,}$", _raw(2, 10, 3)),
]
TERM_DEFAULT = _raw(1, 10, 3)


def term_weight(term: Column | str) -> Column:
    """Weight of a token before it is normalised over its query."""
    t = F.col(term) if isinstance(term, str) else term
    out = F.lit(None).cast("double")
    for pattern, w in TERM_CLASSES:
        out = F.when(t.rlike(pattern), F.lit(w)) if pattern == TERM_CLASSES[0][0] else out.when(t.rlike(pattern), F.lit(w))
    return out.otherwise(F.lit(TERM_DEFAULT))


def term_weight_sql(t: str) -> str:
    return "case " + " ".join(f"when regexp_matches({t}, '{p}') then {w!r}" for p, w in TERM_CLASSES) + f" else {TERM_DEFAULT!r} end"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is the zero vector, null where either is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def bm25(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def flat_similarity(df: Column, n: Column) -> Column:
    """Similarity without length norm or term frequency: ln(1+(N-df+.5)/(df+.5)) over its largest value."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5)) / F.ln(1 + (n - 0.5) / 1.5)


def rank_features(query: Column, doc: Column, pagerank: Column) -> Column:
    """10 * cosine of two sparse maps + pagerank; an empty query gives the pagerank alone."""
    dot = F.aggregate(F.map_entries(query), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(doc, e["key"]), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    size = norm(query) * norm(doc)
    return F.coalesce(F.when(size > 0, 10 * dot / size), F.lit(0.0)) + F.coalesce(pagerank, F.lit(0.0))


def hybrid(text: Column, vector: Column, text_weight: float = 0.3, vector_weight: float = 0.7) -> Column:
    """Weighted sum of both similarities; missing ones count 0."""
    return text_weight * F.coalesce(text, F.lit(0.0)) + vector_weight * F.coalesce(vector, F.lit(0.0))


def normalised(df: DataFrame, weight: str, over: str) -> DataFrame:
    """Divide weights by their sum per ``over``, through a partial aggregate and a join back."""
    total = df.groupBy(over).agg(F.sum(weight).alias("_total"))
    return df.join(total, over).withColumn(weight, F.col(weight) / F.nullif("_total", F.lit(0.0))).drop("_total")
