"""URL filters: host and path rules, and a ratio of character language models for the rest; DataFrame functions only.

Rules. A rule is host + path (its path begins at the first slash) with a verdict. It fits its host and all
subdomains if the url's path starts with the rule's; of several the longest wins.

Models. Urls that rules accept and urls that rules reject teach one smoothed variable-order Markov model each: the
probability of a character after the ORDER - 1 before it is its count, with the number of different characters seen
there as the weight of the next lower order (Witten-Bell), down to the alphabet. Characters are A-Z lower-cased and
those outside ALPHABET read as one, so there are at most 44^ORDER grams, which bounds what is broadcast. An
expression that neither class has seen is scored by its longest seen end. A url's score is the difference of the two
log-likelihoods divided by its length; it is rejected from the threshold on, which lies between the two classes' mean
scores over the different urls that rules fit, as far from either in its standard deviations.

Counts are taken over all different urls that rules fit, and scores once per different url. Null urls have no host,
path or score and are accepted; so is every url where rules fit only urls of one verdict. All rows stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name

ORDER = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./:-_?="
_OTHER = "*"
_EDGE = "^"

#: (rule, verdict), fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _read(url: Column) -> Column:
    """The url as the models read it, ORDER - 1 edges before and one after."""
    known = F.regexp_replace(ascii_lower(url), "[^" + ALPHABET.replace("-", r"\-").replace("?", r"\?").replace(".", r"\.") + "]", _OTHER)
    return F.concat(F.lit(_EDGE * (ORDER - 1)), known, F.lit(_EDGE))


def _ends(urls: DataFrame) -> DataFrame:
    """(url.., g): for each character of the url and its end the ORDER characters up to it."""
    read = urls.withColumn("_r", _read(F.col("url")))
    return read.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.length("_r") - (ORDER - 1)), lambda i: F.substring(F.col("_r"), i, F.lit(ORDER))))).drop("_r")


def train(urls: DataFrame) -> DataFrame:
    """(url, rejected) of different urls -> (g, says): grams of 1 to ORDER characters and their log ratio."""
    counts = _ends(urls).groupBy("g").agg(*[F.sum((F.col("rejected") == bool(c)).cast("long")).alias(f"c{c}") for c in (0, 1)])
    counts = cut(counts)
    size = len(ALPHABET) + 2
    below = None
    for k in range(1, ORDER + 1):
        level = counts.groupBy(F.substring("g", ORDER - k + 1, k).alias("g")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        level = level.withColumn("h", F.substring("g", 1, k - 1))
        seen = level.groupBy("h").agg(*[f(F.col(f"c{c}")).alias(f"{n}{c}") for c in (0, 1) for f, n in ((F.sum, "n"), (lambda x: F.sum((x > 0).cast("long")), "t"))])
        level = level.join(F.broadcast(seen), "h")
        if below is None:
            level = level.withColumns({f"b{c}": F.lit(1.0 / size) for c in (0, 1)})
        else:
            level = level.join(F.broadcast(below.select(F.col("g").alias("_low"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))), F.substring("g", 2, k - 1) == F.col("_low"))
        p = {f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(f"c{c}") + F.col(f"t{c}") * F.col(f"b{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"b{c}")) for c in (0, 1)}
        below = cut(level.withColumns(p).select("g", "p0", "p1"))
        out = below if k == 1 else out.union(below)
    return cut(out.select("g", (F.log("p1") - F.log("p0")).alias("says")))


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``urls`` (different, in column url) with the length-normalised difference as ``score``."""
    # one partition would be left of the few bytes that urls are
    found = _ends(urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for k in range(1, ORDER + 1):
        level = model.filter(F.length("g") == k).select(F.col("g").alias(f"g{k}"), F.col("says").alias(f"s{k}"))
        found = found.join(F.broadcast(level), F.substring("g", ORDER - k + 1, k) == F.col(f"g{k}"), "left").drop(f"g{k}")
    says = F.coalesce(*[F.col(f"s{k}") for k in range(ORDER, 0, -1)], F.lit(0.0))
    return found.groupBy(*urls.columns).agg(F.avg(says).alias("score"))


def judged(pages: DataFrame, *, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with columns host, path, rule, score (null where a rule decides) and verdict, which replace columns of these names."""
    url = F.col(url_col).cast("string")
    fit = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    says = reduce(lambda out, r: F.when(F.col("_r") == r[0], F.lit(r[1])).otherwise(out), rules, F.lit(None).cast("string"))
    urls = fit(pages.filter(url.isNotNull()).select(url.alias("url")).distinct()).withColumn("_r", F.col("rule"))
    urls = cut(urls.select("url", "host", "path", "rule", says.alias("says"), (says == "block").alias("rejected")))
    known = urls.filter("rejected is not null").select("url", "rejected")
    kinds = {r[0]: r[1] for r in known.groupBy("rejected").count().collect()}
    if len(kinds) < 2:
        found = urls.select("url", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.coalesce("says", F.lit("allow")).alias("verdict"))
    else:
        model = train(known)
        each = cut(scored(urls.select("url", "rejected"), model))
        by = {r["rejected"]: r for r in each.filter("rejected is not null").groupBy("rejected").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
        score = F.when(F.col("says").isNull(), F.col("score"))
        verdict = F.coalesce("says", F.when(F.col("score") >= threshold(by[False], by[True]), "block").otherwise("allow"))
        found = urls.join(each.drop("rejected"), "url").select("url", "host", "path", "rule", score.alias("score"), verdict.alias("verdict"))
    names = {c: free_name(pages, f"_url_{c}") for c in ("url", "host", "path", "rule", "score", "verdict")}
    found = found.select(*[F.col(c).alias(n) for c, n in names.items()])
    rows = pages.join(found, url == F.col(names["url"]), "left")
    given = {c: F.col(names[c]) for c in ("host", "path", "rule", "score", "verdict")}
    given |= {c: F.coalesce(given[c], F.lit(d)) for c, d in (("host", ""), ("path", ""), ("verdict", "allow"))}
    return rows.withColumns(given).drop(*names.values())


def threshold(low: dict, high: dict) -> float:
    """Between the mean scores m of accepted and rejected urls, as far from either in its standard deviations s."""
    spread = low["s"] + high["s"]
    return (low["m"] * high["s"] + high["m"] * low["s"]) / spread if spread > 0 else (low["m"] + high["m"]) / 2
