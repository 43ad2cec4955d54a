"""Queries of the question builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import queries as Q
from docloom.functions.lexical import HALF, FULL, STOP, tokens
from docloom.functions.weights import term_weight_sql
from docloom.runtime import table


def _items(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", "text")


def interrogatives_stripped(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", Q.without_interrogatives(F.lower(F.col("text"))).alias("kept"))


def pre_tokens(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", F.array_join(Q.pre_tokens("text"), " ").alias("words"))


def query_terms_english(spark, sf_dir):
    return Q.weighted_terms(_items(spark, sf_dir), "item_id", "text").select("query_id", "pos", "term", F.round("boost", 9).alias("boost"))


def query_phrases_english(spark, sf_dir):
    out = Q.neighbour_phrases(Q.weighted_terms(_items(spark, sf_dir), "item_id", "text"))
    return out.groupBy("query_id", "first", "second").agg(F.round(F.sum("boost"), 9).alias("boost"))


def query_ideographic(spark, sf_dir):
    return Q.ideographic_query(_items(spark, sf_dir), "item_id", "text").select("query_id", "pos", "kind", "text", F.round("boost", 9).alias("boost"))


def query_keywords(spark, sf_dir):
    return Q.keywords(_items(spark, sf_dir), "item_id", "text").select("query_id", F.array_join("keywords", " ").alias("keywords"))


def english_stems(spark, sf_dir):
    """Distinct stems of the corpus, with the words and occurrences behind each."""
    words = table(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("word")).where("word rlike '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("n"))
    return words.join(Q.stemmed(words), "word").groupBy("stem").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (interrogatives_stripped, pre_tokens, query_terms_english, query_phrases_english, query_ideographic, query_keywords, english_stems)}


def _tokens(x: str) -> str:
    half = f"translate({x}, '{FULL}', '{HALF.replace(chr(39), chr(39) * 2)}')"
    return rf"list_filter(string_split(trim(regexp_replace(lower({half}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '')"


def _stripped(x: str) -> str:
    out = x
    for pattern, put in Q.INTERROGATIVES:
        out = f"regexp_replace({out}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return f"case when {out} = '' then {x} else {out} end"


_S1 = f"s1 as (select item_id, {_stripped('t')} as t from (select item_id, lower(text) as t from eval_items))"
_S2 = f"{_S1}, s2 as (select item_id, {_stripped('t')} as t from s1)"
_EN = f"{_S2}, w as (select item_id, list_filter({_tokens('t')}, lambda x: not regexp_matches(x, '^[a-z0-9]$'))[1:256] as a from s2), u as (select item_id, unnest(range(0, len(a)))::int as pos, unnest(a) as term from w), x as (select *, {term_weight_sql('term')} as v from u), tm as (select item_id as query_id, pos, term, v / sum(v) over (partition by item_id) as boost from x)"
_SP = "regexp_replace(regexp_replace(t, '([A-Za-z0-9])([一-龥])', '\\1 \\2', 'g'), '([一-龥])([A-Za-z0-9])', '\\1 \\2', 'g')"
_HW = f"{_S1}, h0 as (select item_id, {_SP} as t from s1), h as (select item_id, {_tokens('t')} as a from h0)"
_FINE = "case when length(w) > 3 and regexp_matches(w, '^[一-鿿]+$') then list_transform(range(1, length(w), 2), lambda i: substr(w, i, case when i + 3 > length(w) then 3 else 2 end)) else [w] end"
SQL = {
    "interrogatives_stripped": f"with {_S1} select item_id, t as kept from s1",
    "pre_tokens": "select item_id, array_to_string(list_filter({t}, lambda w: w not in ({s}) and not regexp_matches(w, '^[0-9]$')), ' ') as words from eval_items".format(t=_tokens("text"), s=", ".join(f"'{w}'" for w in STOP)),
    "query_terms_english": f"with {_EN} select query_id, pos, term, round(boost, 9) as boost from tm",
    "query_phrases_english": f"with {_EN}, n as (select query_id, term as first, lead(term) over v as second, 2 * greatest(boost, lead(boost) over v) as b from tm window v as (partition by query_id order by pos)) select query_id, first, second, round(sum(b), 9) as boost from n where second is not null group by 1, 2, 3",
    "query_ideographic": f"with {_HW}, u as (select item_id, unnest(range(0, len(a)))::int as pos, unnest(a) as w from (select item_id, a[1:256] as a from h)), x as (select *, {term_weight_sql('w')} as v, {_FINE} as p from u), y as (select *, v / sum(v) over (partition by item_id) as b from x) select item_id as query_id, pos, 'term' as kind, w as text, round(b, 9) as boost from y union all select item_id, pos, 'phrase', array_to_string(p, ' '), round(b, 9) from y where len(p) > 1 union all select item_id, pos, 'near', array_to_string(p, ' '), round(b * 0.5, 9) from y where len(p) > 1",
    "query_keywords": f"with {_HW}, u as (select item_id, 0 as part, i, 0 as j, a[i] as k from (select item_id, a, unnest(range(1, len(a) + 1)) as i from h) union all select item_id, 1, i, j, p[j] from (select item_id, i, p, unnest(range(1, len(p) + 1)) as j from (select item_id, i, {_FINE} as p from (select item_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as w from h))) where length(p[j]) >= 2), f as (select item_id, k, min((part, i, j)) as o from u group by 1, 2), r as (select *, row_number() over (partition by item_id order by o) as rn from f) select h.item_id as query_id, coalesce(k, '') as keywords from h left join (select item_id, string_agg(k, ' ' order by rn) as k from r where rn <= 32 group by 1) r using (item_id)",
}
