"""Keyword and vector retrieval over DataFrames: postings, BM25, cosine top-k, reciprocal-rank fusion."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import search_tokens
from corpusloom.session import cut_lineage, spread_out

#: BM25 parameters and the constant of reciprocal-rank fusion.
K1, B = 1.5, 0.75
RRF_K = 60
#: The search tokens of a lower-cased text, as ``search_tokens`` finds them.
ASCII_TOKEN = re.compile("[a-z0-9_]+|[一-鿿]")
#: Queries and vectors of one cell of a vector search.
QUERY_BLOCK, VECTOR_BLOCK = 256, 20_000
#: Queries and texts of one cell of a keyword search; keys that are scored at once, in runs of which the maxima bound the best scores.
QUERY_CELL, TEXT_CELL, STRIDE, RUN = 32_768, 24_576, 8_192, 64
#: A term in more than this part of the texts has a weight for each of them. More than rounding moves two scores.
FREQUENT, SLACK = 8, 2e-6


def keyword_index(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, dl, terms``: each text's length in tokens, and how often each of its tokens stands in it.

    One pass, without a shuffle unless the table is read by fewer tasks than there are cores; the form in which an index is written and read. Texts without tokens have no row.
    """

    @F.arrow_udf("struct<dl: int, terms: array<struct<term: string, tf: long>>>")
    def counted(texts: pa.Array) -> pa.Array:
        counts = [Counter(ASCII_TOKEN.findall(t.as_py() or "")) for t in texts]
        terms = pa.array([t for c in counts for t in c], pa.string())
        tfs = pa.array([n for c in counts for n in c.values()], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, counts)]), pa.int32()), pa.StructArray.from_arrays([terms, tfs], ["term", "tf"]))
        return pa.StructArray.from_arrays([pa.array([c.total() for c in counts], pa.int32()), lists], ["dl", "terms"])

    rows = spread_out(texts.select(key, F.lower(text).alias("text")))
    found = rows.select(key, counted.asNondeterministic()("text").alias("c"))
    return found.select(key, "c.dl", "c.terms").where("dl > 0")


def write_index(index: DataFrame, path: str) -> None:
    """An index of ``keyword_index`` as Parquet; ``spark.read.parquet`` reads it back."""
    index.write.mode("overwrite").parquet(path)


def index_postings(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """``term, key, tf, dl`` of an index, one row for each text and token."""
    return index.select(key, "dl", F.explode("terms").alias("t")).select("t.term", key, "t.tf", "dl")


def postings(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, key, tf, dl``: how often each search token stands in each text, and the text's length in tokens.

    Null texts have no tokens and give no rows; each row of ``texts`` is a text of its own.
    """
    return index_postings(keyword_index(texts, key, text), key)


def bm25_stats(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row ``docs, terms, postings, avgdl`` of an index of ``postings``."""
    lengths = index.groupBy(key).agg(F.max("dl").alias("dl"))
    documents = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    terms = index.groupBy("term").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"))
    both = documents.unionByName(terms, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("docs", "terms", "postings", "avgdl")])


def ranked(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The best ``k`` rows of each ``query_id`` by ``score``, then key; with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def packed_index(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, dl, terms, tfs`` of a ``keyword_index``: terms and counts as two texts parted by spaces, a fraction of the arrays' size."""
    tfs = F.array_join(F.transform("terms", lambda t: t["tf"].cast("string")), " ")
    return index.select(key, "dl", F.array_join(F.transform("terms", lambda t: t["term"]), " ").alias("terms"), tfs.alias("tfs"))


def bm25_topk(queries: DataFrame, texts: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, key, score, rank``: the best ``k`` texts of every query (``query_id, query_text``) by BM25."""
    return packed_search(queries, cut_lineage(packed_index(keyword_index(texts, key, text), key)), k, key)


def bm25_search(queries: DataFrame, index: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``query_id, key, score, rank``: the best ``k`` texts of every query (``query_id, query_text``) in a ``keyword_index``."""
    return packed_search(queries, packed_index(index, key), k, key)


def parted(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The parts of texts at their spaces, one after another, and how many each text has."""
    lists = pc.split_pattern(texts.combine_chunks(), " ")
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def term_weights(texts: pa.Table, column: np.ndarray, width: int, vocabulary: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray] | None]:
    """For each of ``vocabulary`` the columns of the texts that hold it and their weights; of a frequent one the weights of all columns.

    ``column`` is that of each text, in ascending order; texts of one column add up.
    """
    held, sizes = parted(texts["terms"])
    term = pc.index_in(held, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(term >= 0)
    there = there[np.argsort(term[there], kind="stable")]
    term, at, norm = term[there], np.repeat(column, sizes)[there], np.repeat(texts["norm"].to_numpy(), sizes)[there]
    tf = parted(texts["tfs"])[0].take(pa.array(there)).cast("double").to_numpy(zero_copy_only=False)
    weight = idf[term] * (tf / (tf + norm))
    if width < len(texts) and len(term):
        first = np.flatnonzero(np.diff(term.astype("int64") * width + at, prepend=-1))
        term, at, weight = term[first], at[first], np.add.reduceat(weight, first)
    out: list[tuple[np.ndarray | None, np.ndarray] | None] = [None] * len(vocabulary)
    bounds = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        ids, own = at[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]
        if FREQUENT * len(ids) > width:
            ids, own = None, np.bincount(ids, own, -(-width // RUN) * RUN)
        out[i] = ids, own
    return out


def best_texts(asked: pa.Table, texts: pa.Table, k: int, key: str) -> pa.Table:
    """``query_id, key, score``: the best ``k`` of ``texts (key, norm, terms, tfs)`` for each of ``asked (query_id, terms, idfs)``.

    Term by term, each query adds up the weights of the texts, ``STRIDE`` keys at a time. Exact: a stride is left out
    only if the largest weights of all terms stay below the ``k``-th score so far. Equal scores, rounded, go by key.
    """
    texts = texts.take(pc.sort_indices(texts, sort_keys=[(key, "ascending")], null_placement="at_start"))
    names = texts[key].combine_chunks().dictionary_encode(null_encoding="encode")
    column = names.indices.to_numpy(zero_copy_only=False).astype("int64")
    terms, sizes = parted(asked["terms"])
    vocabulary = terms.unique()
    wanted = pc.index_in(terms, value_set=vocabulary).to_numpy(zero_copy_only=False)
    idf = np.zeros(len(vocabulary))
    idf[wanted] = asked["idfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    each = np.split(wanted, np.cumsum(sizes)[:-1])
    found = [(np.empty(0, "int64"), np.empty(0))] * len(each)
    for start in range(0, len(names.dictionary), STRIDE):
        width = min(STRIDE, len(names.dictionary) - start)
        lo, hi = np.searchsorted(column, (start, start + width))
        weights = term_weights(texts.slice(lo, hi - lo), column[lo:hi] - start, width, vocabulary, idf)
        most = np.array([0.0 if w is None else w[1].max() for w in weights])
        scores = np.empty(-(-width // RUN) * RUN)
        for q, own in enumerate(each):
            before, high = found[q]
            least = high[-1] - SLACK if len(high) == k else 0.0
            if (bound := most[own].sum()) <= 0 or bound < least:
                continue
            scores.fill(0)
            for w in (weights[i] for i in own.tolist()):
                if w and w[0] is None:
                    scores += w[1]
                elif w:
                    scores[w[0]] += w[1]
            runs = scores.reshape(-1, RUN).max(axis=1)
            if len(runs) > k:
                least = max(least, np.partition(runs, len(runs) - k)[len(runs) - k] - SLACK)
            near = np.flatnonzero(scores >= least) if least > 0 else np.flatnonzero(scores)
            if len(near):
                ids, high = np.append(before, near + start), np.append(high, scores[near])
                order = np.argsort(-np.round(high, 6), kind="stable")[:k]
                found[q] = ids[order], high[order]
    rows = np.repeat(np.arange(len(each)), [len(ids) for ids, _ in found])
    ids, scores = (np.concatenate(x) for x in zip((np.empty(0, "int64"), np.empty(0)), *found, strict=True))
    return pa.table({"query_id": asked["query_id"].take(pa.array(rows)), key: names.dictionary.take(pa.array(ids)), "score": pa.array(scores)})


def packed_search(queries: DataFrame, index: DataFrame, k: int, key: str) -> DataFrame:
    """``query_id, key, score, rank``: the best ``k`` texts of every query (``query_id, query_text``) in a ``packed_index``.

    A text without any query term has no row. Lengths and frequencies count over all texts. Queries and texts are
    laid out in a grid of blocks by hash; a cell gives its best ``k`` only, so neither postings nor pairs are shuffled.
    """
    n, mean = index.agg(F.count(F.lit(1)), F.avg("dl")).first()
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = index.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf.alias("idf"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("query_text")))).alias("term")).join(df, "term")
    asked = wanted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("t"))
    asked = cut_lineage(asked.select("query_id", F.array_join("t.term", " ").alias("terms"), F.col("t.idf").alias("idfs")))
    rows, columns = max(1, -(-asked.count() // QUERY_CELL)), max(1, -(-n // TEXT_CELL))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    place = lambda key, n, name: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)
    norm = K1 * (1 - B + B * F.col("dl") / (mean or 1.0))
    q = asked.select("query_id", "terms", "idfs", place("query_id", rows, "row"), every(columns, "column"))
    d = index.select(key, norm.alias("norm"), "terms", "tfs", place(key, columns, "column"), every(rows, "row"))
    q, d = (x.repartition(rows * columns, "row", "column").groupBy("row", "column") for x in (q, d))  # this number isn't coalesced
    types = {f.name: f.dataType.simpleString() for f in (asked.schema["query_id"], index.schema[key])}
    near = q.cogroup(d).applyInArrow(lambda a, b: best_texts(a, b, k, key), f"query_id {types['query_id']}, {key} {types[key]}, score double")
    return ranked(near.withColumn("score", F.round("score", 6)), key, k).select("query_id", key, "score", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` by one matrix product per number of dimensions."""
    out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})]
    vectors = vectors.sort_values("vec_id")
    for size in set(queries["embedding"].map(len)) & set(vectors["embedding"].map(len)):
        q, v = (df[df["embedding"].map(len) == size] for df in (queries, vectors))
        a, b = (np.stack(list(df["embedding"])).astype(float) for df in (q, v))
        lengths = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        with np.errstate(all="ignore"):
            scores = np.round(a @ b.T / lengths, 6)
        scores[~np.isfinite(scores) | (q["query_id"].to_numpy()[:, None] == v["vec_id"].to_numpy())] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(q)), best.shape[1])
        found = pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "vec_id": v["vec_id"].to_numpy()[best.ravel()], "score": scores[rows, best.ravel()]})
        out.append(found[found["score"] > -np.inf])
    return pd.concat(out)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` nearest vectors of each query by cosine, exact, itself left out.

    Queries and vectors are laid out in a grid of blocks by hash, so nothing is broadcast and no cell holds much more
    than ``QUERY_BLOCK`` by ``VECTOR_BLOCK``; a cell is one matrix product and gives its best ``k`` only. Null and zero
    vectors, those with nulls or numbers that aren't finite, and those of another length match nothing.
    """
    q = queries.where("query_id is not null and embedding is not null").select("query_id", "embedding")
    d = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    rows, columns = (max(1, -(-df.count() // size)) for df, size in ((q, QUERY_BLOCK), (d, VECTOR_BLOCK)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    place = lambda key, n, name: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)
    q = q.select("query_id", "embedding", place("query_id", rows, "row"), every(columns, "column")).groupBy("row", "column")
    d = d.select("vec_id", "embedding", place("vec_id", columns, "column"), every(rows, "row")).groupBy("row", "column")
    near = q.cogroup(d).applyInPandas(lambda a, b: nearest(a, b, k), "query_id long, vec_id long, score double")
    return ranked(near, "vec_id", k)


def fuse(*rankings: DataFrame, key: str, k: int) -> DataFrame:
    """``query_id, key, score, rank``: reciprocal-rank fusion of rankings (``query_id, key, rank``)."""
    parts = [r.select("query_id", key, (1.0 / (RRF_K + F.col("rank"))).alias("part")) for r in rankings]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return ranked(every.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("score")), key, k)


def vector_violations(vectors: DataFrame, dimensions: int) -> DataFrame:
    """``vec_id, error_code`` of vectors that break the contract: length, finite numbers, not all zero."""
    v = F.col("embedding")
    code = (
        F.when(v.isNull(), "vector_missing")
        .when(F.size(v) != dimensions, "vector_dimensions")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "vector_not_finite")
        .when(~F.exists(v, lambda x: x != 0), "vector_zero")
    )
    return vectors.select("vec_id", code.alias("error_code")).where("error_code is not null")


def reranked(results: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank`` of fused results in the order of how many of the query's tokens the text holds.

    ``results`` has ``query_id, doc_id, rank, query_text, text``. Blank texts are left out. The score is a share, so
    it lies within 0 and 1 and never rises with the rank; a query without tokens keeps the fused order and has no score.
    """
    asked = F.array_distinct(search_tokens(F.col("query_text")))
    share = F.round(F.size(F.array_intersect(asked, search_tokens(F.col("text")))) / F.size(asked), 6)
    scored = results.where("trim(text) <> ''").select("query_id", "doc_id", F.col("rank").alias("before"), F.when(F.size(asked) > 0, share).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "before", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def coverage(needed: DataFrame, vectors: DataFrame, key: str, dimensions: int) -> DataFrame:
    """One row ``needed, covered, missing, superfluous, broken``: whether ``vectors (vec_id, embedding)`` serve all ``needed`` keys.

    Reuse is allowed if nothing is missing or broken. Keys count once; null keys nowhere.
    """
    bad = vector_violations(vectors, dimensions).select("vec_id").distinct()
    there = vectors.where("vec_id is not null").select(F.col("vec_id").alias("key")).distinct().withColumn("there", F.lit(True))
    broken = bad.where("vec_id is not null").select(F.col("vec_id").alias("key"), F.lit(True).alias("bad"))
    asked = needed.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().withColumn("asked", F.lit(True))
    both = asked.join(there, "key", "full_outer").join(broken, "key", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.agg(
        F.count_if(yes("asked")).alias("needed"), F.count_if(yes("asked") & yes("there") & ~yes("bad")).alias("covered"), F.count_if(yes("asked") & ~yes("there")).alias("missing"),
        F.count_if(~yes("asked")).alias("superfluous"), F.count_if(yes("bad")).alias("broken"),
    )
