"""Vector retrieval: cosine top-k, lexical and cue rerank, dedupe, evidence snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.functions.lexicon import DEFAULT, Lexicon
from ragloom.operators import nearest
from ragloom.sources.workers import ship_code

#: Weights of cosine, lexical and cue score.
WEIGHTS = (0.62, 0.25, 0.13)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def top_k(vectors: DataFrame, query: list[float], k: int, order: str, vector_col: str = "embedding") -> DataFrame:
    """The k rows of highest cosine, ties by ``order``; adds ``score``. Each task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(vector_col), q)).orderBy(F.desc("score"), order).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score`` for a stated set of queries (``query_id, query``).

    Every block of queries meets every block of vectors in a task of its own, by the matrix
    products of ``nearest``; a pair is no row. Blocks are bounded in components, and a task
    passes on k rows a query. Null and odd vectors, and repeated ids, as ``cosine`` and a
    plain join have them: null scores come last, NaN first, a null id meets nothing.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == queries.schema["query"].dataType.simpleString() and kind in ("array<float>", "array<double>") else "array<double>"
    held = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector")).where("id is not null")
    asked = queries.select(F.col("query_id").alias("id"), F.col("query").cast(kind).alias("vector")).where("id is not null")
    weigh = lambda rows: rows.agg(F.coalesce(F.sum(F.coalesce(F.size("vector"), F.lit(0)).cast("long") + 1), F.lit(0))).first()[0]
    n_held, n_asked = weigh(held), weigh(asked)
    blocks, across = max(1, -(-n_held // nearest.BLOCK), min(16, n_held >> 17)), max(1, -(-n_asked // nearest.BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    each = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell")
    of_asked = asked.select(each(blocks, lambda i: block(across) * blocks + i), F.lit(True).alias("asked"), "id", "vector")
    of_held = held.select(each(across, lambda i: i * blocks + block(blocks)), F.lit(False).alias("asked"), "id", "vector")
    names = ["query_id", id_col]
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, id_col))]
    rows = of_asked.unionByName(of_held).repartitionById(blocks * across, F.col("cell"))
    schema = ", ".join(f"`{c}` {t}" for c, t in zip([*names, "score"], [*kinds, "double"], strict=True))
    scored = rows.mapInArrow(lambda batches: nearest.meet(batches, k, [*names, "score"]), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hits(terms: Column, words) -> Column:
    return F.size(F.array_intersect(terms, T.strings(words)))


def lexical_score(text: Column, terms: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Covered part of the terms and 0.04 for each phrase in the text, 1 at most; 0 without terms."""
    lowered = F.lower(text)
    phrases = sum((F.contains(lowered, F.lit(p)).cast("int") for p in lexicon.phrases), F.lit(0))
    covered = F.size(F.array_intersect(terms, T.word_terms(text))) / F.size(terms)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.least(F.lit(1.0), covered + phrases * 0.04))


def cue_score(text: Column, profile: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """0.08 a cue of each flag that is set, 0.03 an evidence or alliance word, 1 at most."""

    def score(terms: Column) -> Column:
        flagged = sum((F.when(profile[flag], hits(terms, words) * 0.08).otherwise(0.0) for flag, words in lexicon.flag_cues.items()), F.lit(0.0))
        return F.least(F.lit(1.0), flagged + hits(terms, lexicon.evidence) * 0.03 + hits(terms, lexicon.alliance) * 0.03)

    return T.let(T.word_terms(text), score)


def dedupe(rows: DataFrame, order: list, most: int | None = None) -> DataFrame:
    """The first row, by ``order``, of each document and chunk; without both, of each text."""
    key = F.when((F.coalesce("document_id", F.lit("")) == "") & (F.coalesce("chunk_id", F.lit("")) == ""), F.coalesce(F.nullif("text_hash", F.lit("")), T.compact(F.col("text")))).otherwise(F.concat(F.coalesce("document_id", F.lit("")), F.lit(" "), F.coalesce("chunk_id", F.lit(""))))
    first = rows.withColumn("_key", key).withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_nth = 1").drop("_key", "_nth")
    return first.orderBy(*order).limit(most) if most else first


def rerank(candidates: DataFrame, question: str, keep: int, lexicon: Lexicon = DEFAULT, order: str = "ord") -> DataFrame:
    """Candidates (``document_id, chunk_id, title, text, text_hash, score``) by combined score.

    Adds ``rerank_score`` and sorted ``matched_terms``; ties keep the candidates' order.
    """
    text = T.compact(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    rows = candidates.withColumn("_text", text).withColumn("_profile", T.settled_profile(candidates.sparkSession, question, lexicon))
    terms = F.col("_profile.expanded_terms")
    parts = (F.col("score"), lexical_score(F.col("_text"), terms, lexicon), cue_score(F.col("_text"), F.col("_profile"), lexicon))
    rows = rows.withColumn("rerank_score", sum((p * w for p, w in zip(parts, WEIGHTS, strict=True)), F.lit(0.0)))
    rows = rows.withColumn("matched_terms", F.array_sort(F.array_intersect(terms, T.word_terms(F.col("_text")))))
    return dedupe(rows, [F.desc("rerank_score"), F.desc("score"), order], keep).drop("_text", "_profile")


def retrieve(store: DataFrame, question: str, query: list[float], k: int = 10, candidates: int = 30, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Cosine candidates, reranked and deduplicated to k. The costly scores see candidates only."""
    if k <= 0 or candidates < k:
        raise ValueError("k must be positive and not above the number of candidates")
    near = top_k(store, query, max(candidates, k), "ord")
    pool = rerank(near, question, max(candidates // 2, k), lexicon)
    return pool.orderBy(F.desc("rerank_score"), F.desc("score"), "ord").limit(k)


def term_points(own: Column, terms: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """What a window's distinct terms score."""
    return F.size(F.array_intersect(terms, own)) * 4 + hits(own, lexicon.evidence) + hits(own, lexicon.conflict) * 2 + hits(own, lexicon.alliance) * 2


def snippet_score(window: Column, terms: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return T.let(T.word_terms(window), lambda own: term_points(own, terms, lexicon))


def evidence_snippet(text: Column, terms: Column, length: int = 320, lexicon: Lexicon = DEFAULT) -> Column:
    """The window of highest ``snippet_score``, the first of equals, cut to ``length``.

    A term never spans two sentences, so each is parsed once, and of its terms only those
    that score go on; a pair has those of both.
    """
    scoring = F.array_union(terms, T.strings([*lexicon.evidence, *lexicon.conflict, *lexicon.alliance]))

    def read(sentences: Column) -> Column:
        return T.let(scoring, lambda words: F.transform(sentences, lambda s: F.struct(s.alias("window"), F.array_intersect(T.word_terms(s), words).alias("own"))))

    def joined(a: Column, b: Column) -> Column:
        return F.struct(F.concat_ws(" ", a["window"], b["window"]).alias("window"), F.array_union(a["own"], b["own"]).alias("own"))

    def pick(single: Column) -> Column:
        scored = F.transform(T.windows(single, joined, lambda x: F.length(x["window"])), lambda w, i: F.struct(term_points(w["own"], terms, lexicon).alias("score"), (-i).alias("place"), w["window"].alias("window")))
        return F.when(F.size(single) == 0, text).otherwise(F.array_max(scored)["window"])

    def cut(best: Column) -> Column:
        return F.when(F.length(best) <= length, best).otherwise(F.concat(F.rtrim(F.substring(best, 1, length - 3)), F.lit("...")))

    return T.let(T.let(T.let(T.sentences(T.compact(text)), read), pick), cut)
