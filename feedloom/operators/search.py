"""Keyword, term, semantic and hybrid search, and context retrieval."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import add, contains, half_up, occurrences, text_of, word_occurrences


#: Rows that a semantic search can be asked for.
MOST_FOUND = 10_000


def searchable(summary: str = "summary", full_text: Column | None = None) -> Column:
    """What is searched besides the title, in lower case."""
    parts = [F.col(summary)]
    if full_text is not None:
        parts.append(F.substring(full_text, 1, 5000))
    return F.lower(text_of(*parts))


def keyword_score(query: str, title: Column, rest: Column) -> Column:
    """100 for the phrase in the title; for each term 30 a whole word in the title,
    10 a partial one, 5 a whole word in the rest, and 2 for each of up to 10 other
    parts there.  Both are in lower case.  Terms are literals, also those with
    signs that patterns have a meaning for."""
    parts = [F.when(contains(title, query.lower()), 100).otherwise(0)]
    for term in query.lower().split():
        in_title, exact = word_occurrences(title, term), word_occurrences(rest, term)
        parts += [in_title * 30, (occurrences(title, term) - in_title) * 10, exact * 5, F.least(occurrences(rest, term) - exact, F.lit(10)) * 2]
    return add(parts)


def _bound(title: Column, rest: Column, score) -> Column:
    """score(title, rest) with both worked out once a row."""
    made = F.transform(F.array(F.struct(title.alias("t"), rest.alias("r"))), lambda x: score(x["t"], x["r"]))
    return F.get(made, F.lit(0))


def search_keyword(items: DataFrame, query: str, limit: int, ties: Sequence[str] = ("id",)) -> DataFrame:
    """The best `limit` rows with a positive score, with score and similarity (at most 1)."""
    if not query.split():
        return items.withColumns({"score": F.lit(0), "similarity": F.lit(0.0)}).limit(0)
    rows = items.withColumn("score", _bound(F.lower("title"), searchable(), lambda t, r: keyword_score(query, t, r)))
    # Rows without a hit sort last: the filter after the limit keeps the score from being worked out twice.
    rows = rows.orderBy(F.desc("score"), *ties).limit(limit).where("score > 0")
    return rows.withColumn("similarity", F.least(F.lit(1.0), half_up(F.col("score") / 100, 3)))


def search_term(items: DataFrame, query: str, limit: int, ties: Sequence[str] = ("id",)) -> DataFrame:
    """Terms of more than two characters: 3 an occurrence in the title, 1 for each of up to 10 in the text."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    if not terms:
        return items.withColumns({"score": F.lit(0), "similarity": F.lit(0.0)}).limit(0)

    def score(title, rest):
        found = [(occurrences(title, t), occurrences(rest, t)) for t in terms]
        return add([a * 3 + F.least(a + b, F.lit(10)) for a, b in found])

    rows = items.withColumn("score", _bound(F.lower("title"), searchable(), score)).orderBy(F.desc("score"), *ties).limit(limit).where("score > 0")
    return rows.withColumn("similarity", half_up(F.col("score") / 100, 3))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if a norm is 0, null if the lengths differ."""
    value = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value)


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def _to_binary(vectors: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors.to_pylist()], pa.binary())


def _from_binary(size: int):
    def run(coded: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b, "<f4") if len(b) else np.zeros(size, np.float32) for b in coded.to_pylist()], pa.list_(pa.float32()))

    return run


def encode_vector(vector: Column | str) -> Column:
    """A vector as little-endian 32-bit floats in a binary."""
    return F.arrow_udf(_to_binary, "binary")(F.col(vector) if isinstance(vector, str) else vector)


def decode_vector(coded: Column | str, size: int = 768) -> Column:
    """The vector of a binary that encode_vector() made; an empty one is `size` zeros."""
    return F.arrow_udf(_from_binary(size), "array<float>")(F.col(coded) if isinstance(coded, str) else coded)


def vector_column(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def with_cosine(rows: DataFrame, vector: Sequence[float] | DataFrame, column: str = "embedding", out: str = "cosine") -> DataFrame:
    """`rows` with the cosine to one query vector (numbers, or a table of one row with column q)."""
    if isinstance(vector, DataFrame):
        return rows.crossJoin(F.broadcast(vector.limit(1))).withColumn(out, cosine(F.col(column), F.col("q"))).drop("q")
    return rows.withColumn(out, cosine(F.col(column), vector_column(vector)))


def topk(rows: DataFrame, score: str, k: int, ties: Sequence[str]) -> DataFrame:
    return rows.orderBy(F.round(score, 9).desc(), *ties).limit(k)


def nearest(items: DataFrame, vectors: DataFrame, vector: Sequence[float] | DataFrame, k: int) -> DataFrame:
    """(id, cosine) of the k items nearest to a vector; texts of items are not read."""
    rows = items.select("id").join(vectors.select(F.col("item_id").alias("id"), "embedding"), "id")
    return topk(with_cosine(rows, vector).select("id", "cosine"), "cosine", k, ["id"])


def search_semantic(items: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float] | DataFrame, limit: int) -> DataFrame:
    """Items by cosine; by terms where fewer than max(5, limit / 2) have vectors, and so
    for every limit under 5.  Which it is has to be known before the plan is made, so
    the best ids, `MOST_FOUND` at most, are found first."""
    if limit > MOST_FOUND:
        raise ValueError(f"a search gives {MOST_FOUND} rows at most")
    few = max(5, limit / 2)
    best = [tuple(r) for r in nearest(items, vectors, vector, limit).collect()] if limit >= few else []  # `limit` rows at most
    if len(best) < few:
        return search_term(items, query, limit).select(*items.columns, "similarity")
    found = items.sparkSession.createDataFrame(best, items.select("id", F.lit(0.0).alias("cosine")).schema)
    rows = topk(items.join(F.broadcast(found), "id"), "cosine", limit, ["id"])
    return rows.withColumn("similarity", half_up(F.col("cosine"), 3)).select(*items.columns, "similarity")


def search_hybrid(items: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float] | DataFrame, limit: int, candidates: int = 100, w_vector: float = 0.6) -> DataFrame:
    """The best keyword candidates by w * max(0, cosine) + (1 - w) * min(1, keyword)."""
    first = search_keyword(items, query, candidates).withColumnRenamed("similarity", "keyword")
    rows = with_cosine(first.join(vectors, first.id == vectors.item_id, "left"), vector)
    similarity = w_vector * F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))) + (1 - w_vector) * F.least(F.lit(1.0), F.col("keyword"))
    return topk(rows.withColumn("similarity", similarity), "similarity", limit, ["id"]).select(*items.columns, "similarity")


def retrieval_size(limit: int) -> int:
    return max(2 * limit, 10)


def _text_hash(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        if t is None:
            out.append(None)
            continue
        codes = np.frombuffer(t.encode("utf-16-le"), np.uint16).astype(np.uint32)
        powers = np.full(len(codes), 31, np.uint32)
        powers[:1] = 1
        raw = int((codes[::-1] * np.cumprod(powers, dtype=np.uint32)).sum(dtype=np.uint32))
        out.append(abs(raw - (1 << 32) if raw >= 1 << 31 else raw))
    return pa.array(out, pa.int64())


def pseudo_hash(text: Column) -> Column:
    """|h| of h = 31 * h + code in 32-bit arithmetic over a text's UTF-16 units."""
    return F.arrow_udf(_text_hash, "long")(text)


def pseudo_embedding(text: Column, size: int = 768) -> Column:
    """A stand-in vector from the text's hash; a blank text is all zeros."""
    numbers = F.sequence(F.lit(0), F.lit(size - 1))
    # The hash is bound once, not worked out again for every element.
    vector = F.get(F.transform(F.array(pseudo_hash(text)), lambda h: F.transform(numbers, lambda i: ((F.sin(h + i * 73) * 0.5 + 0.5) * 2 - 1).cast("float"))), F.lit(0))
    return F.when(F.trim(text) == "", F.array_repeat(F.lit(0.0).cast("float"), size)).otherwise(vector)
