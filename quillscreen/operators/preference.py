"""Preferences learned from include and exclude labels: contrasted terms, or a logistic regression over TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscreen.functions import text as tx
from quillscreen.operators.store import exploded, small, written

MIN_LABELS, TERMS, FEATURES = 4, 12, 500


def terms(token_array: str) -> Column:
    """Unigrams and bigrams of a stored token array, none with a plain number in it."""
    t = F.col(token_array)
    word = lambda x: ~x.rlike("^[0-9]+$")
    pairs = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(F.get(t, i).alias("a"), F.get(t, i + 1).alias("b")))
    two = F.when(F.size(t) > 1, F.transform(F.filter(pairs, lambda p: word(p["a"]) & word(p["b"])), lambda p: F.concat_ws(" ", p["a"], p["b"]))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(t, word), two)


def contrast(texts: DataFrame, labels: DataFrame, k: int = TERMS) -> DataFrame:
    """``side, term, n_own, n_other``: the k terms that each label has most beyond the other.

    Only labelled papers are counted, with map-side combine. A term needs three characters and a surplus; it scores the surplus
    plus a hundredth of its count, ties in descending order of the term.
    """
    d = texts.join(small(labels.filter(F.col("label").isin("include", "exclude")).select("paper_id", "label")), "paper_id")
    d = d.withColumn("__t", tx.tokens("text")).select("label", F.explode(terms("__t")).alias("term")).filter(F.length("term") >= 3)
    n = d.groupBy("term").agg(F.count_if(F.col("label") == "include").alias("inc"), F.count_if(F.col("label") == "exclude").alias("exc"))
    out = None
    for side, own, other in (("positive", "inc", "exc"), ("negative", "exc", "inc")):
        best = n.filter(F.col(own) > F.col(other)).select(F.lit(side).alias("side"), "term", F.col(own).alias("n_own"), F.col(other).alias("n_other"))
        best = best.orderBy((F.col("n_own") - F.col("n_other") + 0.01 * F.col("n_own")).desc(), F.col("term").desc()).limit(k)
        out = best if out is None else out.union(best)
    return out


def term_scores(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``paper_id, preference_score``: one half plus the balance of positive and negative terms in the text, at four decimals.

    The at most 24 terms are a broadcast row of two arrays.
    """
    sides = found.agg(F.collect_list(F.when(F.col("side") == "positive", F.col("term"))).alias("pos"), F.collect_list(F.when(F.col("side") == "negative", F.col("term"))).alias("neg"))
    d = texts.withColumn("__low", F.lower("text")).join(F.broadcast(sides))
    hits = lambda c: F.size(F.filter(c, lambda t: F.col("__low").contains(t)))
    centred = (hits("pos") - hits("neg")) / F.greatest(F.lit(1), F.size("pos") + F.size("neg"))
    return d.select("paper_id", F.round(tx.clamp(0.5 + centred), 4).alias("preference_score"))


def frequent(d: DataFrame, k: int = FEATURES) -> list[str]:
    """The k most frequent grams of the array ``grams``, ties by gram, from an aggregate that spills: a vectorizer's own fit would hold every gram there is."""
    n = exploded(d, "grams", "gram").groupBy("gram").count()
    return [r["gram"] for r in n.orderBy(F.col("count").desc(), "gram").limit(k).collect()]


def classifier_scores(texts: DataFrame, labels: DataFrame, stop_words: tuple[str, ...] = tx.STOPWORDS) -> DataFrame:
    """``paper_id, preference_score`` of a logistic regression over TF-IDF of unigrams and bigrams, at most 500 of them.

    Smooth idf plus one and unit-length rows; the penalty 1 / n is the usual C = 1. With under MIN_LABELS labels, or one class only, the
    contrasted terms decide instead.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = labels.filter(F.col("label").isin("include", "exclude")).select("paper_id", "label")
    d = texts.withColumn("__w", F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\w\w+\b"), F.lit(0)), lambda x: ~x.isin(*stop_words)))
    # Pairs from two shifted copies of the array: a lambda that indexed it would compute it for every element.
    n_pairs = F.greatest(F.size("__w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("__w", F.lit(1), n_pairs), F.slice("__w", F.lit(2), n_pairs), lambda a, b: F.concat_ws(" ", a, b))
    d = d.select("paper_id", F.concat("__w", pairs).alias("grams"))
    sides = known.join(texts.select("paper_id"), "paper_id").groupBy("label").count()
    n = {r["label"]: r["count"] for r in sides.collect()}
    if sum(n.values()) < MIN_LABELS or len(n) < 2:
        return term_scores(texts, contrast(texts, labels))
    total = sum(n.values())
    train = d.join(small(known), "paper_id").withColumn("y", (F.col("label") == "include").cast("double"))
    vocabulary = frequent(train)
    if not vocabulary:
        return term_scores(texts, contrast(texts, labels))
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="tf")
    size = len(vocabulary)
    # Stored as the counts of the vocabulary alone; the grams themselves take several times the room of the texts.
    train = written(counts.transform(train).select("tf", "y"))
    flagged = train.select(vector_to_array("tf").alias("a"))
    df = flagged.select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.count_if(F.col("v") > 0).alias("df"))
    idf = {r["i"]: r["idf"] for r in df.select("i", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf")).collect()}
    weight = F.array(*[F.lit(float(idf.get(i, 0.0))) for i in range(size)])
    weighted = lambda x: x.withColumn("wv", array_to_vector(F.zip_with(vector_to_array("tf"), weight, lambda a, b: a * b)))
    unit = Normalizer(p=2.0, inputCol="wv", outputCol="x")
    prepared = lambda x: unit.transform(weighted(x))
    ready = prepared(train).select("x", "y")
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=1000).fit(ready)
    return model.transform(prepared(counts.transform(d))).select("paper_id", F.round(F.get(vector_to_array("probability"), F.lit(1)), 4).alias("preference_score"))
