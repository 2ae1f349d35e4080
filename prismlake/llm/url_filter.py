"""URL filtering by association rules, native Spark only.

Listing rules (host and path) come first. Pages they don't name are judged by rules that Spark's
FP-growth mines from labelled URLs: token sets that imply `block` with enough support and confidence.
A label says what a host's words are, never what the listing says of it: what the listing blocks says
nothing of other hosts. A rule must hold for the hosts that it matches as it does for their URLs, so that
no host with many URLs makes a rule for others. Mined rules are kept minimal (no rule whose antecedent holds another
rule's) and match through an inverted index of token to rules, an equi-join. Spark broadcasts the index
only if it is small.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.staging import staged

#: Listing rules (host, path, verdict).
LISTING = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that mark a host as unwanted: the labels for mining.
UNWANTED = ("adult", "bets", "betting", "casino", "cheap", "escort", "loans", "pills", "porn", "poker", "replica", "viagra", "warez", "xxx")
MIN_SUPPORT = 0.002
#: ... and at least so many URLs, whatever the share.
MIN_URLS = 5
MIN_CONFIDENCE = 0.8
MAX_ANTECEDENT = 3
BLOCK, ALLOW = "label=block", "label=allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Without `://`, or null: both empty. Only A-Z of the host are lower-cased."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, listing=LISTING) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listing rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(listing, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels, the words of hyphenated ones, path words, query keys. A label
    without a hyphen is one token."""
    labels = F.transform(F.split(host, "[.]"), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(host, "[.-]"), lambda x: F.concat(F.lit("h:"), x))
    steps = F.transform(F.filter(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), "[?][^#]*", 0), F.lit("[?&]([^=&]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(labels, words, steps, keys))


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_antecedent: int = MAX_ANTECEDENT, unwanted=UNWANTED) -> DataFrame:
    """rule_id, antecedent, confidence, support of the minimal rules that imply block.

    urls: host, path, url. The label of a URL is block if its host has an unwanted word, else allow. The support threshold is a share, so that the
    number of frequent token sets doesn't grow with the table. Tokens that stand in the same URLs throughout
    (the labels of one long host) count as one, the first of them: each subset of them would be a rule.
    """
    words = F.split("host", "[.-]")
    label = F.when(F.exists(words, lambda w: w.isin(*unwanted)), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    items = F.array_append(tokens(F.col("host"), F.col("path"), F.col("url")), label)
    baskets = staged(urls.where("host <> ''").select("host", items.alias("items")), "baskets")
    spark = urls.sparkSession
    if baskets.isEmpty():
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, support double")
    # only labels and tokens that ever stand beside block can be part of a rule that implies it
    rows = baskets.count()
    min_support = max(min_support, min(1.0, MIN_URLS / rows))
    common = rows * min_support
    useful = baskets.where(F.array_contains("items", BLOCK)).select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= common).select("item")
    kept = staged(baskets.withColumn("id", F.monotonically_increasing_id()).select("id", F.explode("items").alias("item")), "baskets")
    places = kept.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("where")).join(useful, "item", "left_semi")
    # a label is no token: it stays, whatever stands beside it
    alone = F.col("item").startswith("label=")
    rated = staged(places.groupBy("n", "where", alone.alias("label")).agg(F.min("item").alias("item")).select("item"), "items")
    slim = kept.join(rated, "item").groupBy("id").agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(slim)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BLOCK) & (F.size("antecedent") <= max_antecedent))
    rules = staged(rules.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support").withColumn("rule_id", F.xxhash64("antecedent")), "rules")
    index = rules.select("rule_id", F.size("antecedent").alias("need"), F.explode("antecedent").alias("item"))
    tried = baskets.withColumn("id", F.monotonically_increasing_id()).select("id", "host", F.array_contains("items", BLOCK).alias("block"), F.explode("items").alias("item"))
    met = tried.join(index, "item").groupBy("id", "host", "rule_id", "need", "block").agg(F.count("*").alias("have")).where("have = need")
    hosts = met.groupBy("rule_id", "host").agg(F.avg(F.col("block").cast("double")).alias("right"))
    kept = hosts.groupBy("rule_id").agg(F.avg("right").alias("right")).where(F.col("right") >= min_confidence).select("rule_id")
    rules = staged(rules.join(kept, "rule_id", "left_semi"), "held")
    # minimal: no other rule's antecedent is a proper part of it; candidates meet on a shared token
    a = rules.select("rule_id", F.explode("antecedent").alias("token"), F.col("antecedent").alias("mine"))
    b = rules.select(F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("other"))
    wider = a.join(b, "token").where((F.size("other") < F.size("mine")) & (F.size(F.array_except("other", "mine")) == 0)).select("rule_id").distinct()
    return rules.join(wider, "rule_id", "left_anti").select("rule_id", "antecedent", "confidence", "support")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence: the best mined rule of each distinct URL of which all tokens are present."""
    index = rules.select("rule_id", "confidence", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    each = urls.select("url", "host", "path").distinct().select("url", F.explode(tokens(F.col("host"), F.col("path"), F.col("url"))).alias("token"))
    hits = each.join(index, "token").groupBy("url", "rule_id", "need", "confidence").agg(F.count("*").alias("have")).where("have = need")
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, listing=LISTING, unwanted=UNWANTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that blocked, else null).

    One row per row of pages. Null or odd URLs have empty host and path and are allowed; an empty table
    gives no rows; further columns are ignored.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), listing)
    split = split.withColumn("rule", rule).withColumn("verdict", verdict)
    rules = staged(mine(split, min_support, min_confidence, unwanted=unwanted), "mined")
    open_urls = split.where("rule is null and host <> ''")
    best = staged(fired(open_urls, rules).select(F.col("url").alias("hit"), "confidence"), "fired")
    joined = split.join(best, (F.col("url") == F.col("hit")) & F.col("rule").isNull(), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("hit").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
