"""Similarity of research areas: tokens, noun phrases, phrases of two words, topics, embeddings."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import HashingTF, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.functions.vectors import cosine, highest_mean, lowest_mean
from scholarforge.runtime import stage

# Words without meaning of their own.
STOP_WORDS = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
_ADJECTIVE = re.compile(r".*(?:al|ous|ive|ic|ary|able|ible|ful|less|ent|ant|ed|ing|bound|driven|scale|range|field)$")
_VERB = frozenset("is are was were has have had can may might will asks uses keeps studies works designs maps edits leads shows links joins compares received served described supported published released meets teaches supervises welcomes".split())


def simple_tags(text: str) -> list[tuple[str, str]]:
    """Words with parts of speech by rule: the default where no tagger is given (M1)."""
    out = []
    for i, w in enumerate(re.findall(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*|\d+|[^\w\s]", text or "")):
        low = w.lower()
        tag = "PUNCT" if not w[0].isalnum() else "NUM" if w[0].isdigit() else "OTHER" if low in STOP_WORDS else "VERB" if low in _VERB else "PROPN" if w[0].isupper() and i else "ADJ" if _ADJECTIVE.match(low) else "NOUN"
        out.append((w, tag))
    return out


#: One letter for every part of speech that phrases are made of.
_CODES = {"NOUN": "N", "PROPN": "P", "ADJ": "A"}
#: A phrase in the codes of a text read backwards: its last word, the words before it, and the word that ends it.
_PHRASE = re.compile("([NP][PA]*)[^PA]?")


def noun_phrases(tagged: list[tuple[str, str]]) -> list[str]:
    """Noun phrases, the last one first; the word before a phrase ends it and begins none itself (M2)."""
    words, n = [w for w, _ in tagged], len(tagged)
    backwards = "".join(_CODES.get(tag, "-") for _, tag in reversed(tagged))
    return [" ".join(words[n - m.end(1) : n - m.start(1)]) for m in _PHRASE.finditer(backwards)]


def phrases_udf(tagger: Callable[[str], list[tuple[str, str]]] = simple_tags):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def phrases(text: pd.Series) -> pd.Series:
        return text.map(lambda t: noun_phrases(tagger(t)) if t else [])

    return phrases


def sentence_tokens(df: DataFrame, text: str, into: str = "sentences") -> DataFrame:
    """Words of every sentence, without stop words (as spelt) and marks (M4); the JVM's sentence splitter."""
    kept = F.transform(F.sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: F.filter(s, lambda w: ~w.isin(*STOP_WORDS)))
    return df.withColumn(into, F.filter(kept, lambda s: F.size(s) > 0))


def bigram_scores(df: DataFrame, sentences: str = "sentences", least: int = 5, threshold: float = 10.0) -> DataFrame:
    """``a, b, score`` of pairs of words that belong together: (n_ab - least) * V / (n_a * n_b) (M5)."""
    each = df.select(F.explode(sentences).alias("s"))
    words = each.select(F.explode("s").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = stage(words, "words")
    size = words.agg(F.count("*").alias("v"))
    pairs = each.where(F.size("s") > 1).select(F.explode(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    pairs = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = words.select(F.col("w").alias("a"), F.col("n").alias("na")), words.select(F.col("w").alias("b"), F.col("n").alias("nb"))
    scored = pairs.join(a, "a").join(b, "b").crossJoin(F.broadcast(size))
    return scored.select("a", "b", ((F.col("n") - least) * F.col("v") / (F.col("na") * F.col("nb"))).alias("score")).where(F.col("score") > threshold)


def joined_bigrams(df: DataFrame, key: str, scores: DataFrame, sentences: str = "sentences", into: str = "phrases") -> DataFrame:
    """Sentences with pairs of ``scores`` joined as ``a_b``, greedily from the left; every text meets its own pairs by a join on them."""
    steps = F.transform(F.filter(sentences, lambda s: F.size(s) > 1), lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    own = df.select(key, F.explode(F.array_distinct(F.flatten(steps))).alias("p")).select(key, "p.a", "p.b")
    known = own.join(scores.select("a", "b").distinct(), ["a", "b"]).groupBy(key).agg(F.collect_set(F.concat_ws("\t", "a", "b")).alias("__pairs"))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def join(batch: pd.Series, pairs: pd.Series) -> pd.Series:
        def one(s: list[str], known: frozenset[str]) -> list[str]:
            out: list[str] = []
            open_end = False  # whether the last word may still be joined with the next
            for w in s:
                if open_end and f"{out[-1]}\t{w}" in known:
                    out[-1], open_end = f"{out[-1]}_{w}", False
                else:
                    out.append(w)
                    open_end = True
            return out

        return pd.Series([None if b is None else [one(list(s), frozenset(() if p is None else p)) for s in b] for b, p in zip(batch, pairs)], dtype=object)

    return df.join(known, key, "left").withColumn(into, join(F.col(sentences), F.col("__pairs"))).drop("__pairs")


def topic_similarity(df: DataFrame, key: str, query: int, phrases: str = "phrases", topics: int = 25, seed: int = 124, rounds: int = 10, features: int = 1 << 18) -> DataFrame:
    """``key, lda_score``: cosine of a document's topics with the query row's (M8, M9); words are hashed, none is left out."""
    bags = df.select(key, F.flatten(phrases).alias("words"))
    counts = stage(HashingTF(inputCol="words", outputCol="counts", numFeatures=features).transform(bags).select(key, "counts"), "bags")
    model = LDA(k=topics, optimizer="online", seed=seed, maxIter=rounds, featuresCol="counts").fit(counts)
    mixed = stage(model.transform(counts).select(key, vector_to_array("topicDistribution").alias("t")), "topics")
    asked = mixed.where(F.col(key) == query).select(F.col("t").alias("q"))
    return mixed.crossJoin(F.broadcast(asked)).select(key, cosine(F.col("t"), F.col("q")).alias("lda_score"))


def embedding_similarity(df: DataFrame, key: str, query: int, phrases: str = "phrases", size: int = 50, rounds: int = 1, seed: int = 124, least: int = 1) -> DataFrame:
    """``key, word2vec_score``: highest cosine of mean sentence vectors with the query row's sentences, 0 at least.

    Words met fewer than ``least`` times have no vector; raise it where the vocabulary would outgrow the driver.
    """
    each = stage(df.select(key, F.explode(phrases).alias("words")), "sentences")
    model = Word2Vec(vectorSize=size, minCount=least, maxIter=rounds, seed=seed, inputCol="words", outputCol="v").fit(each)
    vectors = stage(model.transform(each).select(key, vector_to_array("v").alias("v")), "vectors")
    asked = vectors.where(F.col(key) == query).agg(F.collect_list("v").alias("q"))  # the sentences of one text
    best = F.aggregate(F.transform("q", lambda q: F.coalesce(cosine(F.col("v"), q), F.lit(0.0))), F.lit(0.0), lambda a, x: F.greatest(a, x))
    scored = vectors.crossJoin(F.broadcast(asked)).withColumn("s", best).groupBy(key).agg(F.max("s").alias("word2vec_score"))
    return df.select(key).join(scored, key, "left").fillna(0.0, ["word2vec_score"])


def word_vectors(df: DataFrame, phrases: str = "phrases", size: int = 50, rounds: int = 1, seed: int = 124, least: int = 5) -> DataFrame:
    """``word, vector`` of an embedding of all sentences."""
    each = df.select(F.explode(phrases).alias("words"))
    model = Word2Vec(vectorSize=size, minCount=least, maxIter=rounds, seed=seed, inputCol="words", outputCol="v").fit(each)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def closest_words(vectors: DataFrame, plus: list[str], minus: list[str] | None = None, n: int = 10) -> DataFrame:
    """The ``n`` words closest to a sum and difference of words, as in analogies (O9, M13); unknown words count nothing."""
    signs = [(w, 1.0) for w in plus] + [(w, -1.0) for w in minus or []]
    asked = vectors.join(F.broadcast(vectors.sparkSession.createDataFrame(signs, "word string, sign double")), "word")
    parts = asked.select(F.posexplode("vector").alias("i", "x"), "sign").groupBy("i").agg(F.sum(F.col("x") * F.col("sign")).alias("x"))
    target = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("q"))  # one row, one vector
    others = vectors.where(~F.col("word").isin([w for w, _ in signs]))
    return others.crossJoin(F.broadcast(target)).select("word", cosine(F.col("vector"), F.col("q")).alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), "word").limit(n)


def phrase_similarity(df: DataFrame, key: str, query: int, text: str) -> DataFrame:
    """``key, keyword_score``: mean over the query's noun phrases of the best word overlap with the text's."""
    phrased = stage(df.select(key, F.array_distinct(F.transform(phrases_udf()(F.col(text)), F.lower)).alias("k")), "phrases")
    asked = phrased.where(F.col(key) == query).select(F.col("k").alias("q"))

    def alike(a, b):
        x, y = F.split(a, " "), F.split(b, " ")
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

    best = F.transform("q", lambda q: F.aggregate(F.transform("k", lambda k: alike(q, k)), F.lit(0.0), lambda a, x: F.greatest(a, x)))
    kept = F.filter("best", lambda x: x != 0)
    scored = phrased.crossJoin(F.broadcast(asked)).withColumn("best", best)
    return scored.select(key, F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept).cast("double")), F.lit(0.0)).alias("keyword_score"))


def research_scores(df: DataFrame, key: str, query: int, text: str = "text_raw", how: str = "two_lowest", topics: int = 25) -> DataFrame:
    """``key, research_area_score`` from the three similarities (M10): mean of the two lowest, of the two highest, or of all."""
    clean = df.select(key, F.when(F.col(text) != "Unknown", F.coalesce(F.col(text), F.lit(""))).otherwise("").alias("t"))
    told = stage(sentence_tokens(clean, "t"), "tokens")
    told = stage(joined_bigrams(told, key, bigram_scores(told)), "joined")
    scores = topic_similarity(told, key, query, topics=topics).join(phrase_similarity(clean, key, query, "t"), key).join(embedding_similarity(told, key, query), key)
    three = F.array("lda_score", "keyword_score", "word2vec_score")
    score = {"two_lowest": lowest_mean(three, 2), "two_highest": highest_mean(three, 2), "all": lowest_mean(three, 3)}[how]
    return scores.select(key, "lda_score", "keyword_score", "word2vec_score", score.alias("research_area_score"))
