"""URL filters: fixed host and path rules, and association rules mined with FP-growth.

Each url is a set of tokens (host labels, path segments, query keys). Spark's FP-growth mines the token combinations that
are frequent among labelled pages together with their label, for both labels: combinations for "bad" block, combinations for
"good" allow. A rule needs support, confidence and a lead over the base rate of its label, that is the share of the way
from the base rate to certainty that its confidence has covered, and the lead must exceed the chance of so few pages. Tokens
of nearly all labelled pages say nothing and are left out. A rule that holds a shorter one of its label with no less
confidence is left out. Rules are matched by an inverted index: each rule is listed under its rarest token, urls look their
tokens up there, and a listed rule fits if all its tokens are in the url. Of the rules that fit, the one with the largest lead decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from pliego.session import kept

LEAST_SUPPORT = 0.002  # share of the labelled pages that hold the tokens and have the label
LEAST_PAGES = 8  # and so many pages at least
LEAST_CONFIDENCE = 0.5  # share of the label among the pages that hold the tokens
LEAST_LEAD = 0.4  # (confidence - base rate) / (1 - base rate)
LEAST_ERRORS = 3.0  # standard errors of a share over as many pages between base rate and confidence
MOST_SHARE = 0.95  # tokens of more pages are left out
BAD, GOOD = "label=bad", "label=good"
RULE = "items array<string>, bad boolean, confidence double, lead double, support double"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Verdict, rule as host and path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, or null. Rules are tried from the longest on."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, under = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + under)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, path segments (numbers as one), query keys; none for null."""
    url = F.translate(url, UPPER, LOWER)
    named = lambda parts, kind: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), p))
    segments = F.transform(F.split(path_of(url), "/"), lambda p: F.regexp_replace(p, "[0-9]+", "0"))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1))
    scheme = F.array(F.regexp_extract(url, r"^([^:/?#]*)://", 1))
    all_ = F.concat(named(scheme, "scheme="), named(F.split(host_of(url), r"\."), "host="), named(segments, "path="), named(keys, "key="))
    return F.coalesce(F.array_distinct(all_), F.array().cast("array<string>"))


def mine(
    labelled: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE, lead: float = LEAST_LEAD, errors: float = LEAST_ERRORS
) -> DataFrame:
    """Rules (items, bad, confidence, lead, support) from rows (items, bad); rows with null in either say nothing."""
    known = kept(labelled.filter("items is not null and bad is not null").select("items", "bad"), "labelled")
    n, n_bad = known.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if n < LEAST_PAGES:  # no rule can have the support
        return labelled.sparkSession.createDataFrame([], RULE)
    shares = known.select(F.explode("items").alias("item")).groupBy("item").agg((F.count(F.lit(1)) / n).alias("share"))
    usual = [r.item for r in shares.filter(F.col("share") > MOST_SHARE).select("item").collect()]  # as many as a url has tokens
    telling = F.array_except("items", F.array(*map(F.lit, usual)).cast("array<string>"))
    baskets = known.select(F.concat(telling, F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, LEAST_PAGES / n), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.select(
        F.array_sort("antecedent").alias("items"), F.element_at("consequent", 1).alias("label"), "confidence", "support"
    ).filter(F.col("label").isin(BAD, GOOD))
    base = F.when(F.col("label") == BAD, n_bad / n).otherwise(1 - n_bad / n)
    pages = F.col("support") * n / F.col("confidence")
    rules = rules.withColumns({"bad": F.col("label") == BAD, "lead": F.when(base < 1, (F.col("confidence") - base) / (1 - base)).otherwise(0.0)})
    rules = rules.filter((F.col("lead") >= lead) & (F.col("confidence") - base >= errors * F.sqrt(base * (1 - base) / pages)))
    rules = kept(rules.select("items", "bad", "confidence", "lead", "support"), "rules")
    # a rule that holds another one cannot fit where the other one does not
    shorter = rules.select(F.col("items").alias("part"), "bad", F.col("confidence").alias("sure"), F.element_at("items", 1).alias("key"))
    longer = rules.select("items", "bad", "confidence", F.explode("items").alias("key")).join(shorter, ["key", "bad"])
    longer = longer.filter((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("sure") >= F.col("confidence")))
    return rules.join(longer.select("items", "bad").distinct(), ["items", "bad"], "left_anti").select("items", "bad", "confidence", "lead", "support")


def matching_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls (column url) that some rule fits, with that of the largest lead (then confidence, support, bad, items)."""
    listed = urls.filter("url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    postings = listed.select("url", "tokens", F.explode("tokens").alias("token"))
    often = postings.join(rules.select(F.explode("items").alias("token")).distinct(), "token", "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    places = rules.select("*", F.explode("items").alias("token")).join(often, "token", "left")
    index = places.groupBy("items", "bad").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("rare"), *(F.first(c).alias(c) for c in ("confidence", "lead", "support"))
    )
    index = index.select(F.col("rare.token").alias("token"), F.struct("lead", "confidence", "support", "bad", "items").alias("found"))
    fits = postings.join(index, "token").filter(F.size(F.array_except("found.items", "tokens")) == 0)
    return fits.groupBy("url").agg(F.max("found").alias("found"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, and of the mined rule that fits best, whether or
    not it decides: mined (its tokens, joined by ``+``), mined_verdict and mined_confidence, or nulls.

    Labels (doc_id, quality) belong to the page of the same number; quality 0 is bad, and one bad label makes a page bad.
    Null urls and urls without ``://`` have an empty host and path, no fixed rule, and are allowed unless a mined rule blocks them.
    Very long urls are read whole. Repeated rows are judged each; extra columns are ignored; without labels nothing but the
    fixed rules blocks; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url")
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled = rows.join(known, F.col("page_id") == F.col("doc_id")).select(tokens(F.col("url")).alias("items"), "bad")
    matched = matching_urls(rows, mine(labelled))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.join(matched, "url", "left").withColumns({"host": host, "path": path})
    judged = judged.withColumn("fixed", longest_rule(F.col("host"), F.col("path")))
    mined_verdict = F.when(F.col("found.bad"), "block").when(~F.col("found.bad"), "allow")
    return judged.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", mined_verdict, F.lit("allow")).alias("verdict"),
        F.array_join("found.items", "+").alias("mined"), mined_verdict.alias("mined_verdict"),
        F.col("found.confidence").alias("mined_confidence"),
    )
