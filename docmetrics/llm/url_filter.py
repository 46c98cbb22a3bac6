"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Method: URLs that a rule decides are the labelled ones. Trees (``pyspark.ml`` GBTClassifier) are fitted on
a bounded sample of them and judge the URLs that no rule fits. The sample holds every URL once, however many
rows it has (with its row count as a weight a hot URL would outweigh all others): the first ``SAMPLE_ROWS``
distinct URLs by a hash, and the first ``VERDICT_ROWS`` of each verdict. Features: lengths of URL, host and path, path depth, longest segment, digit ratio, entropy of
the characters, counts of parameters, hyphens, signs and host labels, scheme, and suffix statistics:
for the host's last label, its last two labels and the first path segment, the smoothed share of blocked
URLs among all distinct labelled URLs that have it, and their number. A labelled URL's own verdict is left out of its
statistics when the trees are fitted, as a URL that is judged has none in them either. Everything is DataFrame expressions and
spark.ml; no Python runs on the executors.

Scale: the distinct labelled URLs are written once (partial aggregation, so a hot URL is one row per task); the
sample is taken among those whose hash is below a bound that leaves about twice the sample. The statistics are aggregations of them,
and equi-joins; the joined tables hold only keys with labelled URLs, and Spark broadcasts them only if they are small,
or else splits a hot key.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule fits it. If the
rules decide no URL at all the rest is allowed; if all decided URLs have one verdict, the rest gets it.
Rules tie by length: then the one that sorts first. Repeated rows get equal rows; an empty table gives an
empty result; null ids are carried. Further columns are returned untouched inside the struct ``page``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SAMPLE_ROWS, VERDICT_ROWS = 20_000, 1_000
TREES, DEPTH, STEP = 12, 4, 0.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STAT_KEYS = ("suffix1", "suffix2", "segment")


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct<rule, verdict>, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
             for v, h, p in ordered]
    return F.coalesce(*cases, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.greatest(F.length(url), F.lit(1))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    chars = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")

    def of_char(total: Column, c: Column) -> Column:
        share = (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(F.lit(0.0))

    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": _count(path, "/"), "longest_segment": F.array_max(F.transform(F.split(path, "/"), F.length)),
        "digit_ratio": digits(url) / size, "host_digits": digits(host), "entropy": F.aggregate(chars, F.lit(0.0), of_char),
        "parameters": F.when(F.contains(url, F.lit("?")), _count(url, "&") + 1).otherwise(F.lit(0)), "hyphens": _count(url, "-"),
        "labels": _count(host, ".") + 1, "signs": F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / size,
        "https": F.startswith(url, F.lit("https")).cast("int"), "fragment": F.contains(url, F.lit("#")).cast("int"),
        "ends_in_slash": path.endswith("/").cast("int"), "has_extension": path.rlike("\\.[A-Za-z0-9]+$").cast("int"),
    }


def _fitting_sample(urls: DataFrame, distinct: dict[str, int]) -> DataFrame:
    """Of distinct ruled URLs the first ``SAMPLE_ROWS`` by hash, and the first ``VERDICT_ROWS`` of each verdict."""
    place, size = F.xxhash64("url"), max(SAMPLE_ROWS, VERDICT_ROWS)
    below = {v: -(1 << 63) + (min(1 << 64, (1 << 65) * size // max(n, 1)) - 1) for v, n in distinct.items()}
    near = urls.where(reduce(lambda a, b: a | b, ((F.col("ruled") == v) & (place <= F.lit(bound)) for v, bound in below.items())))
    first = lambda df, n: df.orderBy(place, "url").limit(n)
    return reduce(DataFrame.unionByName, (first(near.where(F.col("ruled") == v), VERDICT_ROWS) for v in distinct), first(near, SAMPLE_ROWS)).distinct()


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """-> page (the input row as a struct), host, path, rule, verdict, allow_score (the trees'; null if a rule decides)."""
    rows = pages.select(F.struct("*").alias("page"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("hit", hit).withColumn("rule", F.col("hit.rule")).withColumn("ruled", F.col("hit.verdict")).drop("hit")

    keyed = (rows.withColumn("suffix1", F.substring_index("host", ".", -1)).withColumn("suffix2", F.substring_index("host", ".", -2))
             .withColumn("segment", F.regexp_extract("path", "^/([^/]*)", 1)))
    decided = keyed.where("ruled IS NOT NULL")
    blocked = (F.col("ruled") == "block").cast("int")
    urls = materialize(decided.select("url", "host", "path", *STAT_KEYS, "ruled").distinct(), "url_ruled")
    totals = urls.agg(F.count("*").alias("n"), F.coalesce(F.sum(blocked), F.lit(0)).alias("blocked")).first()
    if totals["blocked"] in (0, totals["n"]):
        rest = "block" if totals["blocked"] else "allow"
        return rows.select("page", "host", "path", "rule", F.coalesce("ruled", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("allow_score"))

    prior = totals["blocked"] / totals["n"]
    plain = lexical_features(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))
    names = [*plain, *(f"{k}_{x}" for k in STAT_KEYS for x in ("blocked", "seen"))]
    tables = [urls.groupBy(k).agg(F.sum(blocked).alias(f"{k}_b"), F.count("*").alias(f"{k}_n")) for k in STAT_KEYS]

    def featured(df: DataFrame, own: Column, own_blocked: Column) -> DataFrame:
        """``own`` is 1 for URLs that are in the statistics, which then leave out that one."""
        df = df.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in plain.items()})
        df = reduce(lambda d, kt: d.join(kt[1], kt[0], "left"), zip(STAT_KEYS, tables), df)
        for k in STAT_KEYS:
            n, b = (F.coalesce(f"{k}_{x}", F.lit(0)) - o for x, o in (("n", own), ("b", own_blocked)))
            df = df.withColumns({f"{k}_blocked": (b + 4 * prior) / (n + 4), f"{k}_seen": F.log1p(n)})
        return df

    sample = _fitting_sample(urls, {"allow": totals["n"] - totals["blocked"], "block": totals["blocked"]}).withColumn("label", 1 - blocked)
    sample = materialize(featured(sample, F.lit(1), 1 - F.col("label")).select(*names, "label"), "url_sample")
    both = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(both.transform(sample))

    judged = trees.transform(both.transform(featured(keyed.where("ruled IS NULL"), F.lit(0), F.lit(0))))
    from pyspark.ml.functions import vector_to_array

    allow = vector_to_array("probability")[1]
    rest = judged.select("page", "host", "path", "rule", F.when(F.col("prediction") == 1, "allow").otherwise("block").alias("verdict"), allow.alias("allow_score"))
    return decided.select("page", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("allow_score")).unionByName(rest)
