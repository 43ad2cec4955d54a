"""Questions to weighted terms and phrases: interrogatives dropped, terms boosted, neighbours as phrases, long ideographic runs in finer pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.functions.weights import term_weight

#: Interrogatives and function words of questions, and what takes their place, in order.
INTERROGATIVES = [
    (r"是*(什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*", ""),
    (r"(^| )(what|who|how|which|where|why)('re|'s)? ", " "),
    (
        r"(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) ",
        " ",
    ),
]
#: Boosts of a question's parts: a phrase of neighbours over its heavier term, finer pieces as a phrase and near each other, synonyms.
PHRASE, PIECES, NEAR, SYNONYM = 2.0, 1.0, 0.5, 0.25
MOST_TERMS, MOST_KEYWORDS = 256, 32


def without_interrogatives(text: Column | str) -> Column:
    """Drop interrogatives and function words; a text of nothing else stays as it is."""
    t = out = L.c(text)
    for pattern, put in INTERROGATIVES:
        out = F.regexp_replace(out, f"(?i){pattern}", put)
    return F.when(out == "", t).otherwise(out)


def pre_tokens(text: Column | str, numbers: bool = False, stop: list[str] = L.STOP) -> Column:
    """Tokens without stop words and, unless ``numbers``, single digits."""
    words = F.filter(L.tokens(text), lambda w: ~w.isin(stop))
    return words if numbers else F.filter(words, lambda w: ~w.rlike("^[0-9]$"))


def fine_pieces(words: Column) -> Column:
    """Runs of four and more ideographs in pieces of two, the last of two or three; other words as they are, cut at slashes."""

    def cut(w: Column) -> Column:
        n = F.length(w)
        pieces = F.transform(F.sequence(F.lit(1), n - 1, F.lit(2)), lambda i: F.substring(w, i, F.when(i + 3 > n, F.lit(3)).otherwise(F.lit(2))))
        return F.when((n > 3) & w.rlike("^[一-鿿]+$"), pieces).otherwise(F.split(w, "/"))

    return F.flatten(F.transform(words, cut))


def expanded_keywords(words: Column) -> Column:
    """Words and their finer pieces of two and more characters, for highlighting."""
    return F.array_union(words, F.filter(fine_pieces(words), lambda p: F.length(p) >= 2))


def weighted_terms(queries: DataFrame, query_id: str, text: str, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, pos, term, boost): the first ``most`` terms of each question, interrogatives and single letters or digits dropped; boosts sum to 1."""
    words = F.filter(L.tokens(without_interrogatives(without_interrogatives(F.lower(F.col(text))))), lambda w: ~w.rlike("^[a-z0-9]$"))
    rows = queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.slice(words, 1, most)).alias("pos", "term")).withColumn("_w", term_weight("term"))
    return rows.withColumn("boost", F.col("_w") / F.sum("_w").over(Window.partitionBy("query_id"))).drop("_w")


def neighbour_phrases(terms: DataFrame) -> DataFrame:
    """(query_id, first, second, boost): neighbouring terms as phrases, with twice the heavier boost."""
    w = Window.partitionBy("query_id").orderBy("pos")
    ahead = terms.withColumn("_n", F.lead(F.struct("term", "boost")).over(w)).where("_n is not null")
    return ahead.select("query_id", F.col("term").alias("first"), F.col("_n.term").alias("second"), (PHRASE * F.greatest("boost", "_n.boost")).alias("boost"))


def ideographic_query(queries: DataFrame, query_id: str, text: str, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, pos, kind, text, boost): a question in ideographs as alternatives.

    Its words, in order, are each a 'term'; a word with finer pieces is also a 'phrase' of these and, at half the boost, 'near': the pieces
    within two places of each other. Alternatives of one ``pos`` are joined by OR.
    """
    spaced = L.spaced_scripts(without_interrogatives(F.lower(F.col(text))))
    rows = queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.slice(L.tokens(spaced), 1, most)).alias("pos", "term")).withColumn("_w", term_weight("term"))
    rows = rows.withColumn("boost", F.col("_w") / F.sum("_w").over(Window.partitionBy("query_id"))).withColumn("_p", fine_pieces(F.array("term")))
    pieces = F.array_join("_p", " ")
    made = lambda kind, body, share: F.struct(F.lit(kind).alias("kind"), body.alias("text"), (F.col("boost") * share).alias("boost"))
    several = F.array(made("term", F.col("term"), 1.0), made("phrase", pieces, PIECES), made("near", pieces, NEAR))
    return rows.select("query_id", "pos", F.inline(F.when(F.size("_p") > 1, several).otherwise(F.array(made("term", F.col("term"), 1.0)))))


def keywords(queries: DataFrame, query_id: str, text: str, most: int = MOST_KEYWORDS) -> DataFrame:
    """(query_id, keywords): words of a question and their finer pieces, each once, the first ``most``."""
    words = L.tokens(L.spaced_scripts(without_interrogatives(F.lower(F.col(text)))))
    return queries.select(F.col(query_id).alias("query_id"), F.slice(F.array_distinct(expanded_keywords(words)), 1, most).alias("keywords"))


_VOWELS = "aeiou"


def _measure(stem: str) -> int:
    """Number of vowel-consonant turns."""
    kinds = ["v" if _vowel(stem, i) else "c" for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if a == "v" and b == "c")


def _vowel(word: str, i: int) -> bool:
    return word[i] in _VOWELS or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _voiced(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    return n > 2 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


#: The suffix rules of Porter's published algorithm, steps 2 to 4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    """Porter stem of a word in lower case; words of other than a-z, and of up to two letters, stay as they are."""
    w = word
    if len(w) <= 2 or not (w.isascii() and w.isalpha() and w.islower()):
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _voiced(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _voiced(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if _doubled(cut) and cut[-1] not in "lsz" else cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if w.endswith("y") and _voiced(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        found = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not _short_end(w[:-1])) else w
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem): each distinct word once; join it back to what holds the words. Nulls are dropped."""

    @F.pandas_udf("string")
    def stems(values: pd.Series) -> pd.Series:
        return values.map(stem)

    return words.select(F.col(word).alias("word")).where("word is not null").distinct().withColumn("stem", stems("word"))
