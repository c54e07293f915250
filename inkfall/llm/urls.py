"""URL filter: given rules, and association rules mined from labelled urls; DataFrame functions only.

A url's tokens are the suffixes of its host (``h:example.com``), the words of its host (``w:casino``: runs
between ``.``, ``-`` and ``_``), its path segments (``p:en``; runs of digits become ``#``) and the keys of
its query (``q:page``).  Labelled urls are baskets of all their
tokens; FP-growth finds the frequent sets, and rules from a set of tokens to ``label:block`` are kept by support
and confidence.  A rule's confidence is an estimate from the urls that have its tokens, so what is held
against the threshold is its lower bound (Wilson, 95 %), which accounts for few urls: the same rule at every size.
The threshold is CONFIDENCE, or more where blocked urls are common: a rule must
halve the doubt that the base rate leaves.  A rule none of whose parts adds confidence
(a subset of its tokens is as confident) is pruned.  Rules match by an inverted index: each stands
under the rarest of its tokens, a page looks up its tokens, and the rule holds if the page has all.

So that subsets of long urls don't explode, FP-growth is not shown sets that pruning takes anyway:
tokens below the support among blocked urls are left out, and a set has only tokens of which any
two are partners (``_partners``), so never two suffixes of one host or tokens that always come together.

A given rule fits its host and all subdomains if the url's path starts with the rule's; the longest
wins, and given rules come before mined ones.

The query's labels: a given rule's verdict where one covers the page, else the row of ``labels`` with
the page's number (low quality or toxic text is bad).  The first bear on urls; the second are those of documents and vary little with
the url, but they keep what the given rules say of the pages they cover from being carried over to
hosts and paths whose own pages are labelled as good.  The operator takes any labels.

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens, no rule
and the verdict allow; repeated rows get a row each; without blocked labels, or with blocked ones only, there
are no rules.  The number of rules is bounded by support (at most tokens-per-url over support for each set size), not by rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed values of the contract: (verdict, host, path).
GIVEN = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The share of the labelled urls that a rule must block, and the least lower bound of its confidence.
SUPPORT, CONFIDENCE = 0.0005, 0.75
#: Square of the normal quantile of 95 %, two-sided.
Z2 = 3.8416
#: The item of FP-growth that stands for ``label:block``; ids of pairs are not negative.
BLOCK = -1
RULE = "antecedent array<string>, confidence double, sure double, lift double, support double"
#: Equal baskets are counted together within 2 ** CHUNK_BITS rows.
CHUNK_BITS = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: suffixes and words of the host, path segments, query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.lit(1 << 20)), ".")))
    names = F.transform(F.filter(F.split(host, r"[.\-_]"), lambda w: w != ""), lambda w: F.concat(F.lit("w:"), w))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, r"[0-9]+", "#")))
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.element_at(F.split(s, "="), 1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, names, segments, keys)))


def _pairs(baskets: DataFrame, single: DataFrame) -> DataFrame:
    """All pairs a < b of frequent tokens of each basket: basket, block, allow, a, b."""
    numbered = baskets.select(F.monotonically_increasing_id().alias("basket"), "tokens", "block", "allow")
    kept = numbered.withColumn("token", F.explode("tokens")).join(single.select("token"), "token").groupBy("basket", "block", "allow").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    split = stored(kept.where("size(tokens) > 1"), "frequent")
    first = split.select("basket", "block", "allow", "tokens", F.posexplode("tokens").alias("at", "a"))
    return first.select("basket", "block", "allow", "a", F.explode(F.slice("tokens", F.col("at") + 2, F.size("tokens"))).alias("b"))


def _partners(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """The pairs that a rule left after pruning can have: each token must lack some allowed url of the other.
    If all allowed urls of a have b, then a set with both is no more confident than without b, and is pruned."""
    of = lambda c: single.select(F.col("token").alias(c), F.col("allow").alias(f"allow_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("allow < allow_a and allow < allow_b")


def lower_bound(block: Column, n: Column) -> Column:
    """Wilson's lower bound of the share block / n."""
    share = block / n
    return (share + Z2 / (2 * n) - F.sqrt(Z2 * share * (1 - share) / n + Z2 * Z2 / (4 * n * n))) / (1 + Z2 / n)


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled (url, bad boolean) -> antecedent, confidence, sure, lift, support: rules to ``label:block``;
    ``sure`` is the lower bound of the confidence."""
    rows = labelled.where("url is not null and bad is not null").select(tokens_of(F.col("url")).alias("tokens"), "bad", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("chunk"))
    # Equal baskets of a chunk of rows become one: ``block`` and ``allow`` are its rows by label.
    counted = lambda df, *by: df.groupBy(*by).agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    baskets = stored(counted(rows.select("tokens", "chunk", F.col("bad").cast("long").alias("block"), (~F.col("bad")).cast("long").alias("allow")), "tokens", "chunk"), "baskets")
    spark = labelled.sparkSession
    blocked, n = baskets.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum(F.col("block") + F.col("allow")), F.lit(0))).first()
    if blocked in (0, n):
        return spark.createDataFrame([], RULE)
    needed = max(confidence, (1 + blocked / n) / 2)
    # With fewer blocked urls even a set that is always blocked stays below the bound.
    floor = max(1, math.ceil(needed * Z2 / (1 - needed) - 1e-9), math.ceil(support * n))
    single = stored(counted(baskets.select(F.explode("tokens").alias("token"), "block", "allow"), "token").where(F.col("block") >= floor), "tokens")
    paired = _pairs(baskets, single)
    pairs = stored(_partners(counted(paired, "a", "b").where(F.col("block") >= floor), single).select(F.monotonically_increasing_id().alias("id"), "a", "b"), "pairs")
    # A token's partners in a basket are a transaction, so sets of ids are sets of that token and its partners.
    grouped = stored(paired.join(pairs, ["a", "b"]).groupBy("basket", "block", "allow", "a").agg(F.collect_list("id").alias("ids")), "transactions")
    total = grouped.agg(F.coalesce(F.sum(F.col("block") + F.col("allow")), F.lit(0))).first()[0]
    found = single.select(F.array("token").alias("antecedent"), (F.col("block") / (F.col("block") + F.col("allow"))).alias("confidence"), "block")
    if total:
        items = F.when(F.col("copy") <= F.col("block"), F.concat("ids", F.array(F.lit(BLOCK)))).otherwise(F.col("ids"))
        copies = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("block") + F.col("allow")))).select(items.alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / total, minConfidence=confidence).fit(copies)
        sets = model.associationRules.where(F.element_at("consequent", 1) == BLOCK).select("antecedent", "confidence", F.round(F.col("support") * total).cast("long").alias("block"))
        tokens = F.sort_array(F.array_union(F.collect_set("a"), F.collect_set("b"))).alias("tokens")
        named = sets.withColumn("id", F.explode("antecedent")).join(pairs, "id").groupBy("antecedent", "confidence", "block").agg(tokens)
        found = found.union(named.select("tokens", "confidence", "block"))
    rules = stored(
        found.select("antecedent", "confidence", lower_bound(F.col("block"), F.col("block") / F.col("confidence")).alias("sure"), (F.col("confidence") / (blocked / n)).alias("lift"), (F.col("block") / n).alias("support"))
        .where(F.col("sure") >= needed),
        "rules",
    )
    # A rule goes if one with fewer of its tokens is at least as confident; they meet under that one's first token.
    less = rules.select(F.element_at("antecedent", 1).alias("key"), F.col("antecedent").alias("fewer"), F.col("confidence").alias("other"))
    more = rules.select("antecedent", "confidence", F.explode("antecedent").alias("key"))
    inside = (F.size(F.array_except("fewer", "antecedent")) == 0) & (F.size("fewer") < F.size("antecedent")) & (F.col("other") >= F.col("confidence"))
    pruned = more.join(less, "key").where(inside).select("antecedent").distinct()
    return rules.join(pruned, "antecedent", "left_anti")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (key, tokens) -> key, confidence of its best rule; by the inverted index of the rules."""
    counts = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    spread = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(counts, "token")
    index = spread.groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    looked = pages.select("key", "tokens", F.explode("tokens").alias("token"))
    return looked.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("key").agg(F.max("confidence").alias("confidence"))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for every row of pages (page_id, url)."""
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url.alias("key"), tokens_of(url).alias("tokens"))
    rule, verdict = given_rule(F.col("host"), F.col("path"))
    base = base.withColumns({"rule": rule, "given": verdict})
    # Urls are looked up once each, however many rows have them.  Rows that need no look-up get keys that no url has, so that they are
    # spread over the join: those without a url would meet in one task.
    needed = F.col("given").isNull() & (F.size("tokens") > 0)
    base = base.withColumn("key", F.when(needed, F.col("key")).otherwise(F.concat(F.lit("-"), (F.monotonically_increasing_id() % 4096).cast("string"))))
    asked = base.where(needed).select("key", "tokens").distinct()
    found = matched(asked, rules)
    joined = base.drop("tokens").join(found, "key", "left")
    final = F.coalesce("given", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        final.alias("verdict"),
        F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"),
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, bad of the pages (page_id, url) that a given rule covers or that have a row in labels (doc_id, quality, toxic)."""
    _, verdict = given_rule(host_of(F.col("url")), path_of(F.col("url")))
    # Of several rows for one page the worst counts.
    own = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("own"))
    return pages.join(own, "page_id", "left").select("page_id", "url", F.coalesce(verdict == "block", "own").alias("bad")).where("bad is not null")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return judged(pages, mined_rules(page_labels(pages, table(spark, sf_dir, "labels"))))
