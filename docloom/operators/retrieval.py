"""Search and ranking: postings, lexical scores, vectors, fusion, re-ranking, facets, pages, highlights, citations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import lexical as L
from docloom.functions.weights import TERM_DEFAULT, bm25, flat_similarity, term_weight  # noqa: F401
from docloom.runtime import materialize, small


@dataclass(frozen=True)
class Retrieve:
    """Parameters of a retrieval, with their usual defaults."""

    threshold: float = 0.2
    vector_weight: float = 0.3
    top: int = 1024
    page: int = 1
    page_size: int = 30
    min_match: float = 0.3
    relaxed_match: float = 0.1
    relaxed_threshold: float = 0.17


def _once(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(name, words): tokens behind a generator, so that what is derived from them beside an explode is not
    evaluated again for every exploded row."""
    return df.select(F.col(key).alias(name), F.inline(F.array(F.struct(L.tokens(text).alias("words")))))


def postings(docs: DataFrame, doc_id: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, length): the inverted index as rows, of the terms in ``only`` (column term) where given. Documents without a token
    have none. Terms are picked before anything is shuffled, so a question moves its own postings only."""
    rows = _once(docs, doc_id, text, "doc_id").select("doc_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    if only is not None:
        rows = rows.join(small(only.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def indexed(docs: DataFrame, doc_id: str, text: str, only: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the terms in ``only``, (n_docs, mean_length) of all documents), both from one pass over the texts."""
    seen = Observation()
    n = F.size("words")
    words = _once(docs, doc_id, text, "doc_id").observe(seen, F.count_if(n > 0).alias("n_docs"), F.sum(n).alias("total"))
    rows = words.select("doc_id", n.alias("length"), F.explode("words").alias("term")).join(small(only.select("term").distinct()), "term", "left_semi")
    index = materialize(rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")))
    got = seen.get
    mean = got["total"] / got["n_docs"] if got["n_docs"] else 0.0
    return index, docs.sparkSession.createDataFrame([(got["n_docs"], float(mean))], "n_docs bigint, mean_length double")


def save_postings(docs: DataFrame, doc_id: str, text: str, path: str, buckets: int = 256) -> None:
    """Write the index once for many questions: Parquet in ``buckets`` folders by hash of the term, sorted by term inside, so that a question
    reads the folders and row groups of its own terms; and the lengths of all documents beside it."""
    index = postings(docs, doc_id, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    index.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths = _once(docs, doc_id, text, "doc_id").select(F.size("words").alias("length")).where("length > 0")
    lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/lengths")


def load_postings(spark: SparkSession, path: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``indexed`` gives, from a written index."""
    n = spark.read.parquet(f"{path}/lengths")
    wanted = materialize(terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(n.first()["buckets"])).cast("int")))
    index = spark.read.parquet(f"{path}/postings").join(small(wanted), ["bucket", "term"], "left_semi").drop("bucket")
    return index, n.select("n_docs", "mean_length")


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, weight, n_terms): weights accumulate over repeats and sum to 1 per query."""
    rows = _once(queries, query_id, text, "query_id").select("query_id", F.explode("words").alias("term"))
    per = rows.groupBy("query_id", "term").agg(F.sum(term_weight("term")).alias("weight"))
    total = per.groupBy("query_id").agg(F.sum("weight").alias("_all"), F.count("*").cast("int").alias("n_terms"))
    return per.join(total, "query_id").select("query_id", "term", (F.col("weight") / F.col("_all")).alias("weight"), "n_terms")


def matches(terms: DataFrame, index: DataFrame) -> DataFrame:
    """Query terms joined to their postings; the query side is broadcast while it is small."""
    return index.join(small(terms), "term")


def token_similarity(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id, similarity, n_hits): weight of the query's terms that a document has, over all its weight."""
    return matches(terms, index).groupBy("query_id", "doc_id").agg(((F.sum("weight") + 1e-9) / (1 + 1e-9)).alias("similarity"), F.count("*").alias("n_hits"), F.first("n_terms").alias("n_terms"))


def token_similarity_from(terms: DataFrame, index: DataFrame, least: float, k: int | None = None, most_queries: int = 128, most_terms: int = 20_000) -> DataFrame:
    """(query_id, doc_id, similarity): ``token_similarity`` from ``least`` (above 0) on, exact, for queries of many terms; integer ids.

    Where queries are whole texts nearly every pair meets in some term. Here pairs meet as blocks: a block of queries is a matrix of
    weights by term, multiplied with the commoner terms of a block of documents and summed over the rarer ones, in single precision; what that
    lets through is summed again in double. Only what reaches ``least`` leaves the task; with ``k`` only what can be among a query's k best of the
    task's documents so far, also where scores are rounded to 5e-5 first.
    """
    vocabulary = materialize(terms.select("term").distinct().withColumn("_t", F.monotonically_increasing_id()))

    def gather(df: DataFrame, key: str, *values: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).join(small(vocabulary), "term")
        per = rows.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.collect_list(F.struct("_t", *values)).alias("a"))
        return per.select("id", *[F.col(f"a.{c}").alias(c) for c in ("_t", *values)])

    def pack(df: DataFrame, name: str, rows: int, most: int) -> DataFrame:
        names = [f"{name}{k}" for k in range(len(df.columns) + 1)]

        def run(batches):
            for b in batches:
                ids, n = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()
                lists = [b.column(k).flatten().to_numpy() for k in range(1, b.num_columns)]
                end = np.cumsum(n)
                i = 0
                while i < len(ids):
                    low = end[i] - n[i]
                    j = max(i + 1, min(i + rows, int(np.searchsorted(end, low + most, "right"))))
                    got = (ids[i:j], n[i:j].astype(np.int64), *[x[low : end[j - 1]] for x in lists])
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in got], names=names)
                    i = j

        return df.mapInArrow(run, ", ".join(f"{n} binary" for n in names))

    pairs = pack(gather(index, "doc_id"), "d", 2048, 1 << 18).crossJoin(small(materialize(pack(gather(terms, "query_id", "weight"), "q", most_queries, most_terms))))
    memory = 64 << 20  # bytes of best scores that a task remembers

    def score(batches):
        best, held, last, docs = {}, 0, None, None
        for b in batches:
            for r in range(b.num_rows):
                d_ids, d_n, d_t, q_ids, q_n, q_t, q_w = (b.column(i)[r].as_buffer() for i in range(7))
                if d_ids.to_pybytes() != last:
                    # a block of documents comes with one block of queries after the other
                    ids, n, t = np.frombuffer(d_ids, np.int64), np.frombuffer(d_n, np.int64), np.frombuffer(d_t, np.int64)
                    names, row_of = np.unique(t, return_inverse=True)
                    count = np.bincount(row_of)
                    common = np.argsort(-count, kind="stable")[:256]
                    place = np.full(len(names), -1)
                    place[common] = np.arange(len(common))
                    owner = np.repeat(np.arange(len(ids)), n)
                    dense = place[row_of] >= 0
                    has = np.zeros((len(ids), len(common)), np.float32)
                    has[owner[dense], place[row_of[dense]]] = 1
                    last, docs = ids.tobytes(), (ids.copy(), np.append(0, np.cumsum(n)), row_of, names, common, has, owner[~dense], row_of[~dense])
                ids, bounds, row_of, names, common, has, owner, rare = docs
                q, t = np.frombuffer(q_ids, np.int64), np.frombuffer(q_t, np.int64)
                q_n = np.frombuffer(q_n, np.int64)
                at = np.minimum(np.searchsorted(names, t), len(names) - 1)
                hit = names[at] == t
                used, at = np.unique(at[hit], return_inverse=True)
                # a row of weights per term that both have; the last, of zeros, for all others
                local = np.full(len(names), len(used))
                local[used] = np.arange(len(used))
                weights = np.zeros((len(used) + 1, len(q)))
                weights[at, np.repeat(np.arange(len(q)), q_n)[hit]] = np.frombuffer(q_w)[hit]
                single = weights.astype(np.float32)
                slack = 1e-6 + 1.2e-7 * int(q_n.max())
                s = has @ single[local[common]]
                row = local[rare]
                sel = row < len(used)
                row, doc = row[sel], owner[sel]
                start = np.flatnonzero(np.diff(doc, prepend=-1))
                end = np.append(start[1:], len(doc))
                i = 0
                while i < len(start):
                    j = max(i + 1, int(np.searchsorted(end, start[i] + most_terms, "right")))
                    s[doc[start[i:j]]] += np.add.reduceat(single[row[start[i] : end[j - 1]]], start[i:j] - start[i], axis=0)
                    i = j
                s = np.ascontiguousarray(s.T)
                edge = np.full(len(q), least - slack, np.float32)
                if k is not None:
                    key = int(q[0])
                    seen = best.get(key)
                    top = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k :] if k < len(ids) else s
                    if seen is not None:
                        top = np.concatenate([seen, top], axis=1)
                        top = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :] if k < top.shape[1] else top
                    if seen is not None or held + top.nbytes <= memory:
                        held += top.nbytes - (0 if seen is None else seen.nbytes)
                        best[key] = top
                    if top.shape[1] == k:
                        edge = np.maximum(edge, top.min(axis=1) - (5e-5 + 2 * slack))
                x, y = np.nonzero(s >= edge[:, None])
                exact = np.zeros(len(x))
                for i in range(0, len(x), 2048):
                    u, v = x[i : i + 2048], y[i : i + 2048]
                    size = bounds[v + 1] - bounds[v]
                    first = np.cumsum(size) - size
                    place = np.arange(size.sum()) - np.repeat(first - bounds[v], size)
                    exact[i : i + 2048] = np.add.reduceat(weights[local[row_of[place]], np.repeat(u, size)], first)
                exact = (exact + 1e-9) / (1 + 1e-9)
                ok = exact >= least
                yield pa.RecordBatch.from_arrays([pa.array(q[x[ok]]), pa.array(ids[y[ok]]), pa.array(exact[ok])], names=["query_id", "doc_id", "similarity"])

    return pairs.mapInArrow(score, "query_id bigint, doc_id bigint, similarity double")


def token_similarity_of(pairs: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id, similarity) of given pairs; those without a common term are left out."""
    rows = pairs.select("query_id", "doc_id").join(terms.select("query_id", "term", "weight"), "query_id").join(index.select("doc_id", "term"), ["doc_id", "term"])
    return rows.groupBy("query_id", "doc_id").agg(((F.sum("weight") + 1e-9) / (1 + 1e-9)).alias("similarity"))


def at_least(scored: DataFrame, share: float) -> DataFrame:
    """Keep matches with at least ``share`` of the query's distinct terms (rounded down, one at least)."""
    return scored.where(F.col("n_hits") >= F.greatest(F.lit(1), F.floor(F.col("n_terms") * share)))


def statistics(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and the single row (n_docs, mean_length)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    per = index.groupBy("doc_id").agg(F.first("length").alias("length"))
    return df, per.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))


def bm25_scores(terms: DataFrame, index: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): BM25 of each match. ``n`` (n_docs, mean_length), where the index has the queries' terms only."""
    df, own = statistics(index)
    rows = matches(terms.join(df, "term"), index).crossJoin(F.broadcast(own if n is None else n))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("length"), F.col("mean_length"))).alias("score"))


def flat_scores(terms: DataFrame, index: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): the similarity without length norm or term frequency; ``n`` as in ``bm25_scores``."""
    df, own = statistics(index)
    rows = matches(terms.join(df, "term"), index).crossJoin(F.broadcast(own if n is None else n))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(flat_similarity(F.col("df"), F.col("n_docs"))).alias("score"))


def top_k(scored: DataFrame, k: int, by: str, *partition: str, tie: str = "doc_id") -> DataFrame:
    """The k best rows per partition, ranked from 1; ties by ``tie``. Catalyst prunes to k before its shuffle."""
    w = Window.partitionBy(*partition).orderBy(F.col(by).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


VECTOR_BLOCK = 4096
QUERY_BLOCK = 512


def knn(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding", vectors_in: str | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact cosine neighbours. The vectors may stand in another column, ``vectors_in``.

    Both sides are packed into blocks of bounded size; each pair of blocks is one matrix product that returns
    at most k rows per query, so what is shuffled does not grow with the vectors. Null and zero vectors never match.
    """

    def pack(df: DataFrame, key: str, size: int, name: str, vector: str = vector) -> DataFrame:
        def run(batches):
            for b in batches:
                ids, vecs = b.column(0).to_pylist(), b.column(1).to_pylist()
                for i in range(0, len(ids), size):
                    m = np.array(vecs[i : i + size], np.float64)
                    norm = np.linalg.norm(m, axis=1)
                    keep = norm > 0
                    m = m[keep] / norm[keep, None]
                    yield pa.RecordBatch.from_arrays([pa.array([np.array(ids[i : i + size], np.int64)[keep].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_m"])

        return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint"), vector).mapInArrow(run, f"{name}_ids binary, {name}_m binary")

    pairs = pack(vectors, vec_id, VECTOR_BLOCK, "v", vectors_in or vector).crossJoin(small(materialize(pack(queries, query_id, QUERY_BLOCK, "q"))))

    def score(batches):
        for b in batches:
            for v_ids, v_m, q_ids, q_m in zip(*[b.column(i).to_pylist() for i in range(4)]):
                v, q = np.frombuffer(v_ids, np.int64), np.frombuffer(q_ids, np.int64)
                if not len(v) or not len(q):
                    continue
                s = np.frombuffer(q_m).reshape(len(q), -1) @ np.frombuffer(v_m).reshape(len(v), -1).T
                n = min(k, len(v))
                # ties at the edge of the k best are all passed on; the window settles them
                edge = np.partition(s, len(v) - n, axis=1)[:, len(v) - n]
                i, j = np.nonzero((s >= edge[:, None] - 1e-12) & (s >= least))
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(v[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "similarity"])

    found = pairs.mapInArrow(score, "query_id bigint, vec_id bigint, similarity double")
    return top_k(found.withColumn("similarity", F.round("similarity", 9)), k, "similarity", "query_id", tie="vec_id")


class CellIndex:
    """Vectors dealt into cells around centres, to be searched by a few cells per query instead of all vectors.

    Centres are fitted by k-means on a hash sample of about ``sample`` vectors, a documented bound on fitting; every vector is indexed, in the cell of its
    nearest centre. Centres are at most ``cells``, so they fit on the driver at any number of vectors. Null and zero vectors are left out.
    """

    def __init__(self, vectors: DataFrame, cells: int = 256, sample: int = 50_000, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 5):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
        unit = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), norm.alias("n")).where("n > 0")
        unit = materialize(unit.select("vec_id", F.transform("v", lambda x: (x.cast("double") / F.col("n"))).alias("v")))
        n = unit.count()
        share = int((1 << 30) * min(1.0, sample / max(1, n)))
        fit = unit.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share)
        k = max(1, min(cells, int(n**0.5)))
        self.centres = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(fit.select(array_to_vector("v").alias("features"))).clusterCenters() if n > 1 else [unit.first().v] if n else np.zeros((0, 0)))
        self.vectors = materialize(self._nearest(unit, "vec_id", 1).repartition("cell"))

    def _nearest(self, df: DataFrame, key: str, probes: int) -> DataFrame:
        """(key, v, cell): each vector with its ``probes`` nearest centres."""
        # to the nearest centre by distance when indexing, to the most similar ones by cosine when asking
        length = np.linalg.norm(self.centres, axis=1)
        aim, half = (self.centres, length**2 / 2) if probes == 1 else (self.centres / np.maximum(length, 1e-12)[:, None], np.zeros(len(length)))

        def run(batches):
            for b in batches:
                if not b.num_rows or not len(aim):
                    continue
                m = np.array(b.column(1).to_pylist(), np.float64)
                near = m @ aim.T - half
                p = min(probes, near.shape[1])
                cell = np.argpartition(-near, p - 1, axis=1)[:, :p]
                at = np.repeat(np.arange(len(m)), p)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(cell.ravel().astype(np.int32))], names=[key, "v", "cell"])

        return df.select(key, "v").mapInArrow(run, f"{key} bigint, v array<double>, cell int")

    def probes_for(self, queries: DataFrame, k: int, least: float = 0.95, query_id: str = "query_id", vector: str = "embedding") -> int:
        """Cells to ask so that at least ``least`` of the k exact neighbours of some (tens of) questions are found, measured against ``knn``."""
        exact = materialize(knn(queries, self.vectors, k, query_id=query_id, vec_id="vec_id", vector=vector, vectors_in="v").select("query_id", "vec_id"))
        n, probes = exact.count(), 1
        while probes < len(self.centres):
            found = self.search(queries, k, probes, query_id, vector).select("query_id", "vec_id")
            if exact.join(found, ["query_id", "vec_id"], "left_semi").count() >= least * n:
                return probes
            probes *= 2
        return len(self.centres)

    def search(self, queries: DataFrame, k: int, probes: int = 16, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, vec_id, similarity, rank): the k nearest by cosine among the vectors of each query's ``probes`` cells."""
        norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
        unit = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).alias("v"), norm.alias("n")).where("n > 0").select("query_id", F.transform("v", lambda x: x.cast("double") / F.col("n")).alias("v"))
        asked = materialize(self._nearest(unit, "query_id", probes))

        def pack(df: DataFrame, key: str, size: int) -> DataFrame:
            """Blocks of at most ``size`` vectors of one cell."""
            rows = df.withColumn("_b", F.floor(F.monotonically_increasing_id() / size)).groupBy("cell", "_b").agg(F.collect_list(F.struct(key, "v")).alias("_r"))
            return rows.select("cell", F.col(f"_r.{key}").alias(f"{key}s"), F.flatten("_r.v").alias(f"{key}_m"))

        pairs = pack(self.vectors, "vec_id", VECTOR_BLOCK).join(small(materialize(pack(asked, "query_id", QUERY_BLOCK))), "cell")

        def score(batches):
            for b in batches:
                for r in range(b.num_rows):
                    v, q = np.array(b.column(0)[r].values), np.array(b.column(2)[r].values)
                    s = np.array(b.column(3)[r].values).reshape(len(q), -1) @ np.array(b.column(1)[r].values).reshape(len(v), -1).T
                    n = min(k, len(v))
                    i, j = np.nonzero(s >= np.partition(s, len(v) - n, axis=1)[:, len(v) - n][:, None] - 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(v[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "similarity"])

        found = pairs.select("vec_ids", "vec_id_m", "query_ids", "query_id_m").mapInArrow(score, "query_id bigint, vec_id bigint, similarity double")
        return top_k(found.withColumn("similarity", F.round("similarity", 9)), k, "similarity", "query_id", tie="vec_id")


def fuse(text: DataFrame, vector: DataFrame, text_weight: float = 0.05, vector_weight: float = 0.95) -> DataFrame:
    """(query_id, doc_id, score): weighted sum over the union of both result sets."""
    a = text.select("query_id", "doc_id", F.col("score").alias("_t"))
    b = vector.select("query_id", "doc_id", F.col("score").alias("_v"))
    return a.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", (text_weight * F.coalesce("_t", F.lit(0.0)) + vector_weight * F.coalesce("_v", F.lit(0.0))).alias("score"))


def rerank(rows: DataFrame, vector_weight: float = 0.3) -> DataFrame:
    """Add ``score``: hybrid of tokensim and cosine; where a query has no cosine at all, the token similarity alone."""
    some = F.sum(F.abs(F.coalesce("cosine", F.lit(0.0)))).over(Window.partitionBy("query_id"))
    mixed = vector_weight * F.coalesce("cosine", F.lit(0.0)) + (1 - vector_weight) * F.coalesce("tokensim", F.lit(0.0))
    return rows.withColumn("score", F.when(some == 0, F.coalesce("tokensim", F.lit(0.0))).otherwise(mixed) + F.coalesce("feature", F.lit(0.0)))


def window_size(page_size: int, window: int = 64) -> int:
    """Re-rank window: a multiple of the page size near ``window``; 1 for pages of one."""
    return 1 if page_size <= 1 else -(-window // page_size) * page_size


def page_of(ranked: DataFrame, spec: Retrieve) -> DataFrame:
    """The rows of one page of a globally ranked result."""
    first = (spec.page - 1) * spec.page_size
    return ranked.where((F.col("rank") > first) & (F.col("rank") <= first + spec.page_size))


def with_fallback(strict: DataFrame, relaxed: DataFrame) -> DataFrame:
    """Per query the strict result, or the relaxed one where the strict is empty; one plan, no driver branch."""
    return strict.unionByName(relaxed.join(strict.select("query_id").distinct(), "query_id", "left_anti"))


def facet(rows: DataFrame, *keys: str) -> DataFrame:
    """Bucket counts; array columns count per element."""
    for k in keys:
        if rows.schema[k].dataType.typeName() == "array":
            rows = rows.withColumn(k, F.explode(k))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def highlight(text: Column | str, words: list[str]) -> Column:
    """Sentences that hold a word, the words wrapped in <em>, joined by '...'; null where none does."""
    marked = lambda s: F.regexp_replace(s, r"(?i)(^|[ .,;:!?()])(" + "|".join(words) + r")($|[ .,;:!?()])", "$1<em>$2</em>$3")
    parts = F.filter(F.transform(F.split(L.c(text), r"[.?!;\n]"), marked), lambda s: s.contains("<em>"))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda s: F.trim(s)), "..."))


def packed(ranked: DataFrame, size: str, budget: int, share: float = 0.97, *partition: str, order: str = "rank") -> DataFrame:
    """Rows in order while their running size stays within ``share`` of the budget."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= share * budget)


def citations(sentences: DataFrame, chunks: DataFrame, cutoff: float = 0.63, least: float = 0.3, decay: float = 0.8, most: int = 4, at_once: int = 1 << 17) -> DataFrame:
    """(answer_id, sentence_no, chunk_id, similarity): chunks to cite per sentence.

    ``sentences``: answer_id, sentence_no, terms. ``chunks``: answer_id, chunk_id, terms. The numbers are integers. The cutoff is lowered by
    ``decay`` until some sentence of the answer reaches it, not below ``least``. A sentence cites up to ``most`` chunks within 99 % of its best;
    each chunk is cited by its best sentence only. The terms of one answer are held by the task that cites it; ``at_once`` bounds the terms,
    and the meetings of a term of a sentence with a chunk, that it handles at a time beyond those of one answer or one sentence.
    """
    one = lambda df, no, cites: df.where(F.col("answer_id").isNotNull() & F.col(no).isNotNull() & F.col("terms").isNotNull()).select("answer_id", F.struct(F.col(no).cast("bigint").alias("no"), F.col("terms").alias("terms"), F.lit(cites).alias("cites")).alias("_u"))
    rows = one(sentences, "sentence_no", True).unionByName(one(chunks, "chunk_id", False)).groupBy("answer_id").agg(F.collect_list("_u").alias("_u"))

    def units(column):
        ends, u = column.offsets.to_numpy(), column.values
        terms = u.field("terms")
        at, no, cites = terms.offsets.to_numpy(), u.field("no").to_numpy(), u.field("cites").to_numpy(zero_copy_only=False)
        for i, j in _runs(at[ends], at_once):
            low, high = ends[i], ends[j]
            words = terms.values.slice(at[low], at[high] - at[low]).dictionary_encode(null_encoding="encode")
            code, names = words.indices.to_numpy(), words.dictionary
            owner, unit, s = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), np.repeat(np.arange(high - low), np.diff(at[low : high + 1])), cites[low:high]
            real = ~names.is_null().to_numpy(zero_copy_only=False)[code]  # a null counts as a term and is met nowhere
            sides = [(owner[x], no[low:high][x], (np.cumsum(x) - 1)[unit[t]], code[t]) for x, t in ((s, s[unit]), (~s, ~s[unit] & real))]
            yield i, *sides, len(names)

    numbers = [f.dataType.simpleString() for f in (sentences.schema["sentence_no"], chunks.schema["chunk_id"])]
    return _cited(rows, units, numbers, cutoff, least, decay, most, at_once)


def text_citations(texts: DataFrame, answer_id: str, text: str, shortest: int = 5, cutoff: float = 0.63, least: float = 0.3, decay: float = 0.8, most: int = 4, at_once: int = 1 << 17) -> DataFrame:
    """``citations`` of texts whose own paragraphs are the chunks: sentences end at '. ' and count from ``shortest`` characters on, chunks end at an empty line.

    Both are made of the same pieces, since neither mark is part of a word: a text is analysed once and only texts are shuffled.
    """
    words = lambda s: F.transform(F.split(s, "\n\n"), lambda p: L.squeezed(L.halfwidth(p)))
    pieces = lambda t: F.transform(F.split(t, r"\. "), lambda s: F.struct((F.length(s) >= shortest).alias("cites"), words(s).alias("words")))
    known = texts.where(F.col(answer_id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(answer_id).alias("answer_id")).agg(F.collect_list(text).alias("_t"))

    def units(column):
        doc_at, text_at, s = column.offsets.to_numpy(), column.values.offsets.to_numpy(), column.values.values
        cites, at, piece = s.field("cites").to_numpy(zero_copy_only=False), s.field("words").offsets.to_numpy(), s.field("words").values
        size = np.append(0, np.cumsum(pc.binary_length(piece).to_numpy(), dtype=np.int64))
        for i, j in _runs(size[at[text_at[doc_at]]] // 6, at_once):
            owner = np.repeat(np.arange(j - i), np.diff(doc_at[i : j + 1]))
            in_text = text_at[doc_at[i] : doc_at[j] + 1]
            sentences, in_sentence = np.diff(in_text), at[in_text[0] : in_text[-1] + 1]
            pieces, low = np.diff(in_sentence), at[in_text[0]]
            sentence_text = np.repeat(np.arange(len(owner)), sentences)
            sentence_no = np.arange(len(pieces)) - (in_text[:-1] - in_text[0])[sentence_text]
            piece_sentence = np.repeat(np.arange(len(pieces)), pieces)
            piece_text = sentence_text[piece_sentence]
            first = at[in_text[:-1]] - low
            # of two pieces of a text the second begins a sentence or else a chunk
            piece_chunk = np.arange(len(piece_sentence)) - first[piece_text] - sentence_no[piece_sentence]
            chunks = at[in_text[1:]] - at[in_text[:-1]] - sentences + 1
            chunk_text = np.repeat(np.arange(len(owner)), chunks)
            chunk_first = np.cumsum(chunks) - chunks
            lists = pc.split_pattern(piece.slice(low, len(piece_sentence)), " ")
            encoded = lists.flatten().dictionary_encode()
            code, blank = encoded.indices.to_numpy(), pc.index(encoded.dictionary, "").as_py()
            of = np.repeat(np.arange(len(piece_sentence)), lists.value_lengths().to_numpy())
            of, code = of[code != blank], code[code != blank]
            said = cites[in_text[0] : in_text[-1]][piece_sentence[of]]
            sides = (owner[sentence_text], sentence_no, piece_sentence[of][said], code[said]), (owner[chunk_text], np.arange(len(chunk_text)) - chunk_first[chunk_text], (piece_chunk + chunk_first[piece_text])[of], code)
            yield i, *sides, len(encoded.dictionary)

    return _cited(known.select("answer_id", F.transform("_t", pieces).alias("_u")), units, ["int", "int"], cutoff, least, decay, most, at_once)


def _runs(at: np.ndarray, at_once: int):
    """(i, j): neighbours whose sizes, the steps of ``at``, are ``at_once`` at most together, or one alone."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, int(at[i]) + at_once, "right")) - 1)
        yield i, j
        i = j


def _cited(rows: DataFrame, units, numbers: list[str], cutoff: float, least: float, decay: float, most: int, at_once: int) -> DataFrame:
    """Citations of ``rows``, one per answer, whose second column ``units`` turns into (first answer, sentences, chunks, number of codes), both sides as
    (answer of each unit, number of each unit, unit of each term, code of each term). No join, so no size that is only estimated, and no row per term."""
    steps = []
    at = cutoff
    while at >= least:
        steps.append(at)
        at *= decay

    def merged(owner, no, unit, code, codes):
        """Answer, number and count of terms per sentence or chunk; its place and the code of each distinct term."""
        both = np.sort(unit.astype(np.int64) * codes + code)  # np.unique hashes, which takes several times as long
        unit, code = np.divmod(both[np.flatnonzero(np.diff(both, prepend=-1))], codes)
        count = np.bincount(unit, minlength=len(owner))
        used = np.flatnonzero(count)
        numbers, place = np.unique(no[used], return_inverse=True)
        key, first, mine = np.unique(owner[used].astype(np.int64) * max(1, len(numbers)) + place, return_index=True, return_inverse=True)
        to = np.zeros(len(owner), np.int64)
        to[used] = mine
        return owner[used][first], no[used][first], count[used][first], to[unit], code

    def run(batches):
        for b in batches:
            for first, sentences, chunks, codes in units(b.column(1)) if b.num_rows else ():
                s_owner, s_no, s_count, s, s_code = merged(*sentences, codes)
                c_owner, c_no, _, c, c_code = merged(*chunks, codes)
                if not len(s) or not len(c):
                    continue
                if (np.diff(s) < 0).any():
                    order = np.argsort(s, kind="stable")
                    s, s_code = s[order], s_code[order]
                key = c_owner[c] * np.int64(codes) + c_code
                order = np.argsort(key, kind="stable")
                key, c = key[order], c[order]
                start = np.flatnonzero(np.diff(key, prepend=-1))
                key, size = key[start], np.diff(np.append(start, len(key)))
                want = s_owner[s] * np.int64(codes) + s_code
                meet = np.minimum(np.searchsorted(key, want), len(key) - 1)
                hit = key[meet] == want
                s, meet = s[hit], meet[hit]
                start, size = start[meet], size[meet]
                low, high = (np.searchsorted(c_owner, s_owner, side) for side in ("left", "right"))
                begin = np.append(np.flatnonzero(np.diff(s, prepend=-1)), len(s))
                found = []
                for i, j in _runs(np.append(0, np.cumsum(size))[begin], at_once):
                    part = slice(begin[i], begin[j])
                    mine, n = s[part], size[part]
                    all_ = slice(mine[0], mine[-1] + 1)
                    bound = np.append(0, np.cumsum(high[all_] - low[all_]))
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[part], n)
                    pair = np.repeat(bound[mine - mine[0]] - low[mine], n) + c[place]
                    if bound[-1] <= 4 * at_once:
                        shared = np.bincount(pair)
                        pair = np.flatnonzero(shared)
                        shared = shared[pair]
                    else:
                        pair, shared = np.unique(pair, return_counts=True)
                    x = np.searchsorted(bound, pair, "right") - 1
                    y = pair - bound[x] + low[x + mine[0]]
                    x += mine[0]
                    similarity = shared / s_count[x]
                    edge = np.flatnonzero(np.diff(x, prepend=-1))
                    best = np.repeat(np.maximum.reduceat(similarity, edge), np.diff(np.append(edge, len(x))))
                    near = similarity >= 0.99 * best
                    x, y, similarity = x[near], y[near], similarity[near]
                    order = np.lexsort((y, -similarity, x))
                    x, y, similarity = x[order], y[order], similarity[order]
                    edge = np.flatnonzero(np.diff(x, prepend=-1))
                    kept = np.arange(len(x)) - np.repeat(edge, np.diff(np.append(edge, len(x)))) < most
                    found.append((x[kept], y[kept], similarity[kept]))
                if not found:
                    continue
                x, y, similarity = (np.concatenate(v) for v in zip(*found))
                owner = s_owner[x]
                top = np.zeros(owner.max() + 1)
                np.maximum.at(top, owner, similarity)
                cut = np.full(len(top), np.inf)
                for step in reversed(steps):
                    cut[top >= step] = step
                ok = similarity >= cut[owner]
                x, y, similarity, owner = x[ok], y[ok], similarity[ok], owner[ok]
                order = np.lexsort((x, -similarity, y))
                order = order[np.flatnonzero(np.diff(y[order], prepend=-1))]
                x, y = x[order], y[order]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + owner[order])), pa.array(s_no[x].astype(np.int64)), pa.array(c_no[y].astype(np.int64)), pa.array(similarity[order])], names=["answer_id", "sentence_no", "chunk_id", "similarity"])

    out = rows.mapInArrow(run, f"answer_id {rows.schema['answer_id'].dataType.simpleString()}, sentence_no bigint, chunk_id bigint, similarity double")
    return out.select("answer_id", *[F.col(name).cast(kind).alias(name) for name, kind in zip(("sentence_no", "chunk_id"), numbers)], "similarity")


def repaired_citations(text: Column | str, n_chunks: Column) -> Column:
    """Citation marks in their many spellings to ' [ID:n]'; marks of chunks that do not exist disappear."""
    t = F.regexp_replace(L.c(text), r"(?i)\s*[\[(【（]\s*(?:id|ref|ID)?\s*[:：]?\s*([0-9]{1,4})\s*[\])】）]", " [ID:$1]")
    ids = F.regexp_extract_all(t, F.lit(r" \[ID:([0-9]+)\]"), F.lit(1))
    bad = F.filter(ids, lambda i: i.cast("int") >= n_chunks)
    return F.aggregate(bad, t, lambda s, i: F.replace(s, F.concat(F.lit(" [ID:"), i, F.lit("]")), F.lit("")))
