"""URL filters by association rules, with DataFrame operations only.

Labelled URLs are baskets of tokens (host labels, path words, file endings, names of query
parameters; numbers become ``#``). FP-growth finds the token combinations that are frequent among the bad
ones: the only rules that are asked for are "these tokens, so bad". How often all baskets have each is
counted by the same inverted index that applies the rules. A rule is kept if their confidence is high, if even the lower
end of its 99.9 % interval (Wilson; many rules are tried) is well above the share of bad URLs, and if no
rule with fewer tokens is as confident. The rest is an inverted index: each rule is filed under its rarest token, URLs look
their tokens up, and a rule applies if all its tokens are there.

Two kinds of tokens would only multiply combinations, as those of a campaign's template do, and are taken out before mining.
Tokens that the same baskets have are one class, mined as one; a URL has a class if it has a token of it, which is what rules of
every combination would say. And a token that only bad URLs have is a rule by itself, or none if there are too few: nothing
with more tokens can be more confident. Rules are compared with those of fewer tokens level by level. What is left can
still be many combinations where many tokens occur with each other in nearly, but not quite, the same URLs, good ones among them.

Explicit rules (host, path) come first: a rule fits its host and all subdomains if the URL's path starts
with the rule's path, and the longest that fits decides.

A null URL, or one without ``://``, has empty host and path and no tokens; it is allowed. Repeated
pages are judged alike, other columns are left out, and empty tables give no rows. Without labelled pages
there are no mined rules. Very long URLs are read whole (a rule of a few tokens applies to them as to others). Of several rules that fit, the most
confident one is named, then the last by its tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_COUNT = 0.002, 0.6, 1.5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The explicit rules, verdict and host with path.
EXPLICIT = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits, nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL."""
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    host = F.transform(F.split(host_of(url), r"[.:]"), lambda t: F.concat(F.lit("h:"), t))
    path = F.transform(F.split(F.lower(path_of(url)), r"[/._~+]+"), lambda t: F.concat(F.lit("p:"), F.regexp_replace(t, r"\d+", "#")))
    params = F.transform(F.split(query, "&"), lambda t: F.concat(F.lit("q:"), F.lower(F.substring_index(t, "=", 1))))
    return F.coalesce(F.array_distinct(F.filter(F.concat(host, path, params), lambda t: F.length(t) > 2)), F.array().cast("array<string>"))


def filed(sets: DataFrame, often: DataFrame) -> DataFrame:
    """``sets`` with ``filed``, the rarest of their tokens (then the first by name). often: (t, freq)."""
    by = sets.select("tokens", F.explode("tokens").alias("t")).join(often, "t").groupBy("tokens").agg(F.min_by("t", F.struct("freq", "t")).alias("filed"))
    return sets.join(by, "tokens")


def token_classes(baskets: DataFrame) -> DataFrame:
    """(t, name, n, n_bad): each token's class, named by its first token; a class' tokens are in the same baskets."""
    mark = lambda seed: F.xxhash64(F.lit(seed), F.col("items"))
    # sets of distinct baskets are equal if two sums of their 64-bit hashes and their sizes are
    each = baskets.select(F.explode("items").alias("t"), "n", "n_bad", mark(1).alias("a"), mark(2).alias("b"))
    each = each.groupBy("t").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    names = each.groupBy("size", "a", "b").agg(F.min("t").alias("name"))
    return each.join(names, ["size", "a", "b"]).select("t", "name", "n", "n_bad")


def most_confident_part(sets: DataFrame, longest: int) -> DataFrame:
    """(tokens, part): the highest confidence of a rule with some, not all, of the tokens. sets: (tokens, rule: its
    confidence, or null if it is none), with every part of every set; one level of lengths after the other."""
    below = sets.where(F.size("tokens") == 1).select("tokens", "rule", F.lit(None).cast("double").alias("part"))
    out = below.select("tokens", "part")
    for n in range(2, longest + 1):
        own = sets.where(F.size("tokens") == n)
        parts = own.select("tokens", F.explode("tokens").alias("t")).select("tokens", F.array_remove("tokens", F.col("t")).alias("less"))
        best = parts.join(below.select(F.col("tokens").alias("less"), F.greatest("rule", "part").alias("best")), "less").groupBy("tokens").agg(F.max("best").alias("part"))
        below = stored(own.join(best, "tokens").select("tokens", "rule", "part"), "rule-parts")
        out = out.unionByName(below.select("tokens", "part"))
    return out


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(rule_id, tokens, classes, filed, confidence, support) from rows (url, bad): tokens name classes, ``classes`` has the tokens of each."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, classes array<array<string>>, filed string, confidence double, support double")
    baskets = labelled.select(tokens_of(F.col("url")).alias("items"), "bad").groupBy(F.array_sort("items").alias("items"))
    baskets = stored(baskets.agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_bad")), "baskets")
    total, bad = baskets.agg(F.sum("n"), F.sum("n_bad")).first()
    if not bad:
        return empty
    least = max(min_support * total, MIN_COUNT)  # bad URLs that a rule must have
    # a class that too few bad URLs have is in no rule
    classes = stored(token_classes(baskets).where(F.col("n_bad") >= least - 0.5), "token-classes")
    named = baskets.withColumn("basket", F.xxhash64("items")).select("basket", "n", "n_bad", F.explode("items").alias("t")).join(small(classes.select("t", "name")), "t")
    named = stored(named.groupBy("basket").agg(F.first("n").alias("n"), F.first("n_bad").alias("n_bad"), F.array_sort(F.collect_set("name")).alias("items")), "class-baskets")
    often = stored(classes.where("t = name").select(F.col("name").alias("t"), F.col("n").alias("freq"), "n_bad"), "tokens")
    pure = often.where("freq = n_bad").select(F.array("t").alias("tokens"), F.col("n_bad").alias("freq"))
    impure = small(stored(often.where("freq > n_bad").select("t"), "impure"))
    bad_baskets = named.where("n_bad > 0").select("basket", "n_bad", F.explode("items").alias("t")).join(impure, "t", "left_semi").groupBy("basket").agg(F.first("n_bad").alias("n_bad"), F.collect_set("t").alias("items"))
    bad_baskets = stored(bad_baskets.select("items", F.explode(F.sequence(F.lit(1).cast("long"), "n_bad")).alias("i")).select("items"), "bad-baskets")
    sets = pure
    if not bad_baskets.isEmpty():
        there = bad_baskets.count()
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / there)).fit(bad_baskets).freqItemsets
        sets = sets.unionByName(found.where(F.size("items") > 0).select(F.array_sort("items").alias("tokens"), "freq"))
    sets = stored(filed(sets, often), "token-sets")
    every = named.select("n", F.col("items").alias("own"), F.explode("items").alias("filed")).join(sets.select("filed", "tokens"), "filed")
    every = every.where(F.size(F.array_except("tokens", "own")) == 0).groupBy("tokens").agg(F.sum("n").alias("n"))
    n, p, z, share = F.col("n"), F.col("confidence"), 3.29, bad / total
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rated = sets.join(every, "tokens").withColumns({"confidence": F.col("freq") / F.col("n"), "support": F.col("freq") / total})
    rated = stored(rated.withColumn("rule", F.when((p >= min_confidence) & (lower >= share * min_lift), p)), "rated-sets")
    longest = rated.agg(F.max(F.size("tokens"))).first()[0] or 1
    part = most_confident_part(rated, longest)
    rules = rated.where("rule is not null").join(part, "tokens").where("part is null or part < confidence")
    # a rule's classes, in the order of its tokens
    members = classes.groupBy("name").agg(F.array_sort(F.collect_list("t")).alias("members"))
    wide = rules.select("tokens", F.posexplode("tokens").alias("pos", "name")).join(members, "name").groupBy("tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "members"))), lambda x: x["members"]).alias("classes"))
    return rules.join(wide, "tokens").select(F.xxhash64("tokens").alias("rule_id"), "tokens", "classes", "filed", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence, rule_tokens): the distinct URLs that a mined rule fits, with the best rule."""
    # filed under each token of the class that it is filed by
    home = F.element_at("classes", F.array_position("tokens", F.col("filed")).cast("int"))
    index = small(stored(rules.select(F.explode(home).alias("filed"), "tokens", "classes", "confidence"), "index"))
    looked = urls.select("url").where("url is not null").distinct().withColumn("own", tokens_of(F.col("url"))).select("url", "own", F.explode("own").alias("filed"))
    hits = looked.join(index, "filed").where(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("own"))))
    return hits.groupBy("url").agg(F.max(F.struct("confidence", "tokens")).alias("best")).select("url", "best.confidence", F.col("best.tokens").alias("rule_tokens"))


def url_filter(pages: DataFrame, labels: DataFrame, explicit: tuple[tuple[str, str], ...] = EXPLICIT, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence of each page. Labels (doc_id, quality,
    toxic) say of the pages with that page_id that they are bad: quality 0 or toxic 1."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    labelled = pages.where("url is not null").select("page_id", "url").join(known, "page_id").select("url", "bad")
    rules = stored(mined_rules(labelled, **how), "url-rules")
    rows = pages.select("page_id", "url")
    if rules.isEmpty():
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    else:
        rows = rows.join(small(stored(matched(pages, rules), "matched")), "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), explicit)
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), F.col("confidence").alias("mined_confidence"))
    mined = F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "mined_confidence")
