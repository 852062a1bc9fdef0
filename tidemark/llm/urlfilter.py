"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

DataFrame operations and Spark's own feature and model classes only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.scratch import new_folder

Rule = tuple[str, str, str]  # allow or block, host, path

GRAMS = (3, 4, 5)
# what the small labelled table is made from: words of sites to allow and to block, syllables of names that tell nothing
PLAIN = ("news", "library", "school", "museum", "recipes", "travel", "science", "history", "garden", "health", "music", "sports", "weather", "books", "research", "university", "community", "support", "review", "journal", "theatre", "nature", "city", "culture", "education", "kitchen", "family", "photo", "design", "market")
SHADY = ("casino", "poker", "viagra", "porn", "xxx", "escort", "payday", "loans", "lottery", "betting", "bets", "warez", "torrent", "keygen", "cracked", "cialis", "jackpot", "slots", "hentai", "adult", "sex", "replica", "clickbait", "popunder", "phishing", "adserver", "ads", "tracker", "spam", "pills", "pharma", "malware", "dating", "gambling")
HOOKS = ("win", "free", "cheap", "bonus", "farm", "track", "online", "deals", "best", "x", "hot", "now")
SYLLABLES = ("ba", "con", "den", "el", "for", "gra", "her", "in", "ka", "lo", "man", "nor", "ou", "per", "re", "st", "the", "ti", "tion", "un", "ver", "wh", "ly", "ing")
# both kinds of sites have the same shapes, so that only their names tell them apart
HOSTS = ("{w}.com", "www.{w}.example.org", "m.{w}.net", "blog.{w}.example.com", "{w}.example.net", "www.{w}.info")
PATHS = ("/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}?page=2", "/{n}#top", "/", "")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def _char_grams(text: Column, mark: str) -> Column:
    """Character n-grams of ``text`` between border signs, each with ``mark`` before it."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(framed, i, F.lit(n))))

    return F.concat(*(of(n) for n in GRAMS))


def with_grams(urls: DataFrame) -> DataFrame:
    """Adds host, path and the n-grams of both as ``_grams``."""
    host, path = host_and_path(F.col("url"))
    return urls.withColumns({"host": host, "path": path}).withColumn("__grams", F.concat(_char_grams(F.col("host"), "h"), _char_grams(F.col("path"), "p")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label, site), 1 for block: some 4,000 rows, every site name in every host shape.

    Names to block: each shady word alone, before and after hooks. Names to allow: each plain word
    alone and in pairs, plain words with a hook, and names of syllables.
    """

    def names(words: Sequence[str], others: Sequence[str], forms: Sequence[str], label: float) -> DataFrame:
        rows = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("w")).select("w", F.posexplode(F.array(*map(F.lit, forms))).alias("i", "form"))
        pick = F.get(F.array(*map(F.lit, others)), F.pmod(F.xxhash64("w", "i"), F.lit(len(others))).cast("int"))
        return rows.select(F.replace(F.replace("form", F.lit("{w}"), F.col("w")), F.lit("{v}"), pick).alias("site"), F.lit(label).alias("label"))

    shady = names(SHADY, HOOKS, ("{w}", "{w}-{v}", "{v}-{w}", "{w}{v}", "best-{w}"), 1.0)
    plain = names(PLAIN, PLAIN, ("{w}", "{w}-{v}", "{w}{v}"), 0.0).unionByName(names(PLAIN, HOOKS, ("{w}-{v}", "{v}-{w}"), 0.0))
    made_up = names(SYLLABLES, SYLLABLES, tuple("{w}" + "{v}" * (1 + i % 2) + SYLLABLES[(7 * i) % len(SYLLABLES)] for i in range(16)), 0.0)
    sites = shady.unionByName(plain).unionByName(made_up)
    hosts = sites.select("site", "label", F.explode(F.array(*map(F.lit, HOSTS))).alias("host"))
    path = F.get(F.array(*map(F.lit, PATHS)), F.pmod(F.xxhash64("site", "host"), F.lit(len(PATHS))).cast("int"))
    filled = F.replace(F.concat(F.lit("http://"), F.replace("host", F.lit("{w}"), F.col("site")), path), F.lit("{n}"), F.pmod(F.xxhash64("host", "site"), F.lit(1000)).cast("string"))
    return hosts.select(filled.alias("url"), "label", "site")


def train(labelled: DataFrame, buckets: int = 1 << 14):
    """(hashing, model) from a small table (url, label 0/1); meant for up to some 100,000 rows."""
    hashing = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=buckets, binary=True)
    rows = hashing.transform(with_grams(labelled.select("url", F.col("label").cast("double").alias("label")))).select("__features", "label").coalesce(1).cache()
    try:
        model = LogisticRegression(featuresCol="__features", labelCol="label", predictionCol="__block", probabilityCol="__probability", rawPredictionCol="__raw", regParam=0.01, maxIter=40).fit(rows)
    finally:
        rows.unpersist()
    # written and read back: a fitted model drags its training summary, and with it the session, into every task
    path = f"{new_folder(labelled.sparkSession, 'url-filter')}/model"
    model.write().save(path)
    return hashing, LogisticRegressionModel.load(path)


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. For rule lists of up to some hundreds."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(urls: DataFrame, rules: Sequence[Rule], trained, block_at: float = 0.5) -> DataFrame:
    """All columns of ``urls`` (a column url among them) plus host, path, rule, verdict and block_score.

    A rule fits its host and the host's subdomains if the path starts with the rule's; the longest
    one wins; without one the model decides. Columns with the new names are replaced. A null URL
    or one without ``://`` has an empty host and path, which only the model judges.
    """
    from pyspark.ml.functions import vector_to_array

    hashing, model = trained
    names = ["host", "path", "rule", "verdict", "block_score"]
    keep = [c for c in urls.columns if c not in names]
    scored = model.transform(hashing.transform(with_grams(urls.select(*keep))))
    score = F.get(vector_to_array("__probability"), F.lit(1))
    out = scored.withColumns({"__rule": rule_of(rules, F.col("host"), F.col("path")), "block_score": score})
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("block_score") >= block_at, "block").otherwise("allow"))
    return out.select(*(F.col(f"`{c}`") for c in keep), "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "block_score")
