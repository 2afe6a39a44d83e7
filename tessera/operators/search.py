"""Token tables, BM25 rankings and exact set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import written


def token_table(docs: DataFrame, key: str, words: str) -> DataFrame:
    """(key, term, tf, length) of an array column of words; documents without words have no rows."""
    rows = docs.select(key, F.size(words).cast("bigint").alias("length"), F.explode(words).alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def corpus_size(docs: DataFrame, words: str) -> DataFrame:
    """One row: the number of documents and their mean length, 1 at least."""
    return docs.agg(F.count("*").cast("double").alias("n_docs"), F.greatest(F.lit(1.0), F.coalesce(F.avg(F.greatest(F.size(words), F.lit(0))), F.lit(1.0))).alias("avg_len"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term").agg(F.count("*").alias("df"))


def expanded_terms(terms: DataFrame, vocabulary: DataFrame, least: int, weight: float, longest: int | None = None) -> DataFrame:
    """(qid, qterm, term, w): each query term itself, and words of the vocabulary that begin with it, at less weight.

    The vocabulary's prefixes are exploded, so the join is on equality; `longest` bounds how much longer a word may be.
    """
    exact = terms.select("qid", F.col("term").alias("qterm"), "term", F.lit(1.0).alias("w"))
    ends = F.sequence(F.lit(least), F.length("term") - 1) if longest is None else F.sequence(F.greatest(F.lit(least), F.length("term") - longest), F.length("term") - 1)
    prefixes = vocabulary.filter(F.length("term") > least).select("term", F.explode(F.transform(ends, lambda n: F.substring("term", F.lit(1), n))).alias("qterm"))
    more = terms.filter(F.length("term") >= least).select("qid", F.col("term").alias("qterm")).join(prefixes, "qterm").select("qid", "qterm", "term", F.lit(weight).alias("w"))
    return exact.unionByName(more)


def bm25(tokens: DataFrame, sizes: DataFrame, terms: DataFrame, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, key, score) of the documents that share a term with a query; the idf is that of the word found.

    Tokens are first cut down to the words asked for, and only these are counted. `tf` may be weighted; a term found in no document
    adds nothing.
    """
    hit = _asked(tokens, terms)
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _summed(hit, sizes, idf * F.col("w"), key, k1, b)


def fts_bm25(tokens: DataFrame, sizes: DataFrame, terms: DataFrame, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As `bm25`, with the rarity full-text indexes use: never below a millionth, however common the word."""
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return _summed(_asked(tokens, terms), sizes, idf * F.col("w"), key, k1, b)


def _asked(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The tokens of words that some query asks for, with the words' document frequencies."""
    words = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return words.join(document_frequency(words), "term").join(terms, "term")


def _summed(hit: DataFrame, sizes: DataFrame, weight: Column, key: str, k1: float, b: float) -> DataFrame:
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_len")))
    return hit.join(F.broadcast(sizes), F.lit(True)).groupBy("qid", key).agg(F.sum(weight * norm).alias("score"))


def weighted_tokens(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, term, tf, length) over several word columns: a word's frequency counts as its field's weight, the length as words in all fields."""
    tag = lambda c: F.transform(c, lambda w: F.struct(w.alias("term"), F.lit(fields[c]).alias("weight")))
    length = sum((F.size(c) for c in fields), F.lit(0)).cast("bigint")
    rows = docs.select(key, length.alias("length"), F.explode(F.flatten(F.array(*map(tag, fields)))).alias("x"))
    return rows.groupBy(key, F.col("x.term").alias("term")).agg(F.sum("x.weight").alias("tf"), F.max("length").alias("length"))


def lengths(docs: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the number of documents and their mean length over all fields, for `weighted_tokens`."""
    length = sum((F.greatest(F.size(c), F.lit(0)) for c in fields), F.lit(0))
    return docs.agg(F.count("*").cast("double").alias("n_docs"), F.greatest(F.coalesce(F.avg(length), F.lit(1.0)), F.lit(1.0)).alias("avg_len"))


def similar_sets(sets: DataFrame, key: str, words: str, threshold: float, same: str | None = None) -> DataFrame:
    """(key, rep, links): every text by its class of equal word sets, with the number of other classes similar to it.

    Exact: similarity is Jaccard's over distinct words, at least `threshold` (above 0), and the column `same`, if named, must be
    equal. Equal sets are one class and never paired. Classes meet on the rarest words of their sets only, as many as an
    intersection needs (the prefix filter), within equal `same`, at places after which enough words can follow (the positional
    filter), with marks that differ by few enough bits, and in size bands that can reach the threshold, so no pair similar enough is
    lost. Empty sets have no links.
    """
    rows = sets.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(words)).alias("ws"), (F.col(same) if same else F.lit("")).alias("same"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws("\u0001", "ws", F.coalesce("same", F.lit(""))), 256))
    classes = rows.groupBy("h").agg(F.min("k").alias("rep"), F.first("ws").alias("ws"), F.first("same").alias("same"), F.count("*").alias("members"))
    # From here on a class goes by a number, which is shorter than the hash.
    classes = written(classes.filter(F.size("ws") > 0).select("h", F.monotonically_increasing_id().alias("c"), "rep", "ws", "same"))
    # A class that is alone with its `same` has no pairs; its words count for nothing.
    apart = classes.groupBy("same").agg(F.count("*").alias("n")).filter("n > 1")
    c = written(classes.join(apart, classes["same"].eqNullSafe(apart["same"]), "left_semi").select("c", "ws", "same"))
    word = c.select("c", F.explode("ws").alias("word"))
    df = word.groupBy("word").agg(F.count("*").alias("df"))
    # Bits that each word turns over: two sets differ by as many words at least as by bits.
    marks = [F.bit_xor(F.expr(f"shiftleft(1L, cast(pmod({h}(word), 64) AS int))")).alias(f"m{i}") for i, h in enumerate(("xxhash64", "hash"))]
    ranked = word.join(df, "word").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("r"), *marks)
    n = F.size("r")
    keep = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    prefix = ranked.select("c", "m0", "m1", n.alias("n"), F.posexplode(F.slice("r", F.lit(1), keep)).alias("at", "p")).select("c", "m0", "m1", "n", "at", F.col("p.word").alias("word"))
    prefix = written(prefix.join(c.select("c", "same"), "c"))
    pairs = paired(prefix, threshold)
    both = pairs.join(c.select(F.col("c").alias("c1"), F.col("ws").alias("w1")), "c1").join(c.select(F.col("c").alias("c2"), F.col("ws").alias("w2")), "c2")
    inter = F.size(F.array_intersect("w1", "w2"))
    alike = both.filter(inter / (F.size("w1") + F.size("w2") - inter) >= threshold)
    links = alike.select(F.explode(F.array("c1", "c2")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    out = rows.select("k", "h").join(classes.select("h", "c", "rep"), "h", "left").join(links, "c", "left")
    return out.select(F.col("k").alias(key), F.coalesce("rep", "k").alias("rep"), F.coalesce("links", F.lit(0)).alias("links"))


def paired(prefix: DataFrame, threshold: float) -> DataFrame:
    """(c1, c2): classes that share a word of their prefixes (c, m0, m1, n, at, word, same) and may be alike by all that is known there."""
    x, y = prefix.alias("x"), prefix.alias("y")
    near = (F.col("x.word") == F.col("y.word")) & F.col("x.same").eqNullSafe(F.col("y.same")) & (F.col("x.c") < F.col("y.c"))
    near &= (F.col("y.n") >= F.col("x.n") * threshold - 1e-9) & (F.col("x.n") >= F.col("y.n") * threshold - 1e-9)
    # The first word that two sets share is followed by all others they share.
    near &= F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) * (1 + threshold) >= (F.col("x.n") + F.col("y.n")) * threshold - 1e-6
    for m in ("m0", "m1"):
        near &= F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) * (1 + threshold) <= (F.col("x.n") + F.col("y.n")) * (1 - threshold) + 1e-6
    return x.join(y, near).select(F.col("x.c").alias("c1"), F.col("y.c").alias("c2")).distinct()


def top_per_query(scores: DataFrame, key: str, k: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), key))
    return scores.withColumn("r", r).filter(F.col("r") <= k).drop("r")
