"""Operator 2: URL filters from explicit rules and from mined association rules.

Spark's FP-growth mines combinations of URL tokens from labelled URLs. Of its association rules, those that
conclude the label "block" are kept if they pass the bounds on support and confidence and if the rows that they rest on
prove more than the share of blocked rows among all: the lower confidence bound of a rule's share must exceed it. Rules that a
shorter one implies go. The label comes from an explicit rule, so the tokens of that rule's host and path are left out of
the row: mined rules tell what else blocked URLs have in common, not what the explicit ones say anyway. They are indexed by their rarest token: a URL meets only the rules under its own tokens, and blocks
if one of these has all its tokens in the URL. Only DataFrame functions and Spark's own FP-growth run here.

FP-growth lists every combination of tokens that is frequent, so k tokens that come together would cost 2^k. Three exact
steps keep these few, and no token of a URL is dropped for its length: tokens that occur in exactly the same labelled
URLs are one (the least of them stands for all, in rules and in the URLs that are judged); tokens that are not frequent
among blocked URLs are in no rule; and a token that is a rule by itself is in no longer rule that it doesn't imply, so
it isn't combined. What stays exponential are tokens that often occur together, not always, in blocked and in allowed URLs.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staveframe.llm._lineage import cut

#: (host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many mined rules are broadcast; beyond, they are joined by a shuffle on the token.
BROADCAST_RULES = 20_000
LABEL = "label:block"
#: Standard deviations of the lower bound that a rule's share of blocked rows must keep above that of all rows.
DEVIATIONS = 2.58


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path (runs of digits as one 0), names in the query."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, parts, names))


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(length, rule, verdict, host, path)`` of the longest explicit rule that fits; null if none does."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length int, rule string, verdict string, host string, path string>")


def lower_bound(hits: Column, rows: Column, deviations: float) -> Column:
    """Wilson's lower bound of the share ``hits / rows``."""
    square, share = deviations**2, hits / rows
    return (share + square / (2 * rows) - deviations * F.sqrt(share * (1 - share) / rows + square / (4 * rows * rows))) / (1 + square / rows)


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, fit_rows: int = 200_000, deviations: float = DEVIATIONS) -> tuple[DataFrame, DataFrame]:
    """Association rules ``key, antecedent, confidence, support`` for blocking from ``tokens array<string>, block
    boolean``, and ``token, stands``: the token that stands for each in the rules, where it is another or occurs often.

    Fitted on all labelled rows, or on a sample of about ``fit_rows`` of them (by a hash of both columns) where there are
    more. A table without labels or without frequent combinations gives no rules. Rules of one token count as
    combinations of one. With ``deviations`` 0 rules need no more than their support and confidence.
    """
    rows = labelled.select("tokens", "block").where((F.size("tokens") > 0) & F.col("block").isNotNull())
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("tokens", "block"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    # Equal rows are one, with their number, so that a hot URL costs no more than others.
    rows = cut(rows.select(F.array_sort("tokens").alias("tokens"), "block").groupBy("tokens", "block").agg(F.count("*").alias("copies")))
    blocked = F.sum(F.when(F.col("block"), F.col("copies")).otherwise(0))
    n, bad = (x or 0 for x in rows.agg(F.sum("copies"), blocked).first())
    usual = bad / max(1, n)
    # Two tokens occur in the same rows if the sums over rows of (a hash of the row) are equal.
    big, place = "decimal(38,0)", F.xxhash64("tokens", "block")
    met = rows.select("block", "copies", place.cast(big).alias("place"), F.explode(F.array_distinct("tokens")).alias("token"))
    known = met.groupBy("token").agg(F.sum("copies").alias("freq"), blocked.alias("bad"), F.sum("place").alias("vector"))
    known = known.where(F.col("bad") >= max(1.0, min_support * n))  # at most (tokens a row) / min_support of them
    stands = F.min("token").over(Window.partitionBy("vector", "freq", "bad"))
    proven = lambda hits, of: (hits >= min_confidence * of) & ((lower_bound(hits, of, deviations) > usual) if deviations else F.lit(True))
    known = cut(known.select("token", stands.alias("stands"), "freq", "bad", proven(F.col("bad"), F.col("freq")).alias("alone")))
    own = known.where(F.col("token") == F.col("stands"))
    single = own.where("alone").select(F.array("token").alias("antecedent"), (F.col("bad") / F.col("freq")).alias("confidence"), (F.col("bad") / F.lit(max(1, n))).alias("support"))
    combined = own.where("not alone").select("token")
    keyed = rows.select("tokens", "block", "copies", F.explode(F.array_distinct("tokens")).alias("token")).join(F.broadcast(combined), "token")
    narrow = keyed.groupBy("tokens", "block").agg(F.collect_set("token").alias("items"))
    # Blocked rows carry the label; rows without a frequent token count too, as the support is a share of all rows.
    none = F.array().cast("array<string>")
    items = F.concat(F.coalesce("items", none), F.when(F.col("block"), F.array(F.lit(LABEL))).otherwise(none))
    each = rows.join(narrow, ["tokens", "block"], "left").select(items.alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(each)
    found = model.associationRules.where((F.col("consequent")[0] == LABEL) & (F.size("antecedent") > 1)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    hits = F.col("support") * F.lit(n)
    found = cut(found.where(proven(hits, hits / F.col("confidence"))).unionByName(single))
    # A rule goes if a rule over part of its tokens is kept: look up each rule without one of its tokens.
    less = found.where(F.size("antecedent") > 1).select("antecedent", F.explode("antecedent").alias("out")).select("antecedent", F.array_remove("antecedent", F.col("out")).alias("part"))
    implied = less.join(found.select(F.col("antecedent").alias("part")), "part", "left_semi").select("antecedent").distinct()
    kept = found.join(implied, "antecedent", "left_anti")
    keyed = kept.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(known.select("token", "freq"), "token")
    rules = cut(keyed.groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key")).select("key", "antecedent", "confidence", "support"))
    return rules, known.select("token", "stands").where(F.col("token") != F.col("stands"))


def judge(pages: DataFrame, rules=RULES, mined: tuple[DataFrame, DataFrame] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for every row.

    An explicit rule decides where one fits (longest wins). Elsewhere the mined rules do: a URL is blocked if one
    fits, with its confidence; else it is allowed. Without ``mined`` (what :func:`mine` gives), they are mined from the
    rows that explicit rules block or allow, without the tokens of the rule's own host and path; rows without such a rule
    have no label and are left out. Null URLs and
    those without ``://`` have empty host and path and are allowed; repeated rows are judged once each; other columns
    are left out.
    """
    host, path = host_path(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    base = base.select("page_id", "host", "path", explicit(F.col("host"), F.col("path"), rules).alias("own"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    if mined is None:
        rest = F.array_except("tokens", tokens(F.col("own.host"), F.col("own.path"), F.lit("")))
        mined = mine(base.where(F.col("own").isNotNull()).select(rest.alias("tokens"), (F.col("own.verdict") == "block").alias("block")))
    rules_, stands = mined
    by_token = F.broadcast(rules_) if rules_.count() <= BROADCAST_RULES else rules_
    by_token = by_token.select(F.col("key").alias("token"), "antecedent", F.col("confidence").alias("rule_confidence"))
    stands = F.broadcast(stands) if stands.count() <= BROADCAST_RULES else stands
    decided = base.where(F.col("own").isNotNull()).select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    open_ = base.where(F.col("own").isNull()).withColumn("row", F.monotonically_increasing_id())
    each = open_.select("row", "page_id", "host", "path", F.explode_outer("tokens").alias("token")).join(stands, "token", "left")
    # Tokens by what stands for them; a URL of several tokens that one stands for has it once.
    own = each.groupBy("row", "page_id", "host", "path").agg(F.collect_set(F.coalesce("stands", "token")).alias("tokens"))
    met = own.select("row", "page_id", "host", "path", "tokens", F.explode_outer("tokens").alias("token")).join(by_token, "token", "left")
    hit = F.when(F.forall("antecedent", lambda x: F.array_contains("tokens", x)), F.col("rule_confidence"))
    judged = met.groupBy("row", "page_id", "host", "path").agg(F.max(hit).alias("confidence"))
    rest = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow").alias("verdict"), "confidence")
    return decided.unionByName(rest)
