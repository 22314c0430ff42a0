"""URL filter: rules first, then the ratio of two character language models, by Spark expressions alone.

Rules name a host and a path's beginning.  The URLs that rules judge teach two variable-order Markov models, one of
allowed and one of blocked URLs: counts of character n-grams, each context smoothed by the next shorter one, contexts
too rare left out.  A URL's score is the difference of its two log-likelihoods divided by its length.  For every
n-gram that difference splits into a weight of its own on top of its shorter ending's, so a model is one table of
weights and a score is one join and one sum.  The threshold is calibrated on labelled URLs held out from the counts.

URLs are normalised before the models see them (lower case, runs of digits to one zero, other characters to ``~``),
so at most ``len(ALPHABET) + 2`` symbols occur and a model has fewer than 3 million rows however many pages there are;
that bound (some 60 bytes a row, so 200 MB at the very most) is why it may be broadcast.  Each distinct normalised URL is scored once.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, has no score and is allowed;
without labelled URLs of both kinds everything that no rule judges is allowed; repeated rows stay; other columns are
left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import cut

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Symbols of normalised URLs, besides the marks of beginning and end.
ALPHABET = string.ascii_lowercase + "0./-_?=&#%:~"
ORDER = 4
#: Weight of the shorter context in a longer one's estimates, and how often a context must have been seen.
PRIOR, MIN_CONTEXT = 4.0, 8
#: One in so many labelled URLs is held out for calibration; scores are counted in bins of this width up to +-LIMIT.
FOLDS, BIN, LIMIT = 4, 0.01, 4.0
#: A URL with more than this part of the pages is joined by itself.
HOT_SHARE = 1000


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all that follows ``://``; empty where the URL has none."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + of_path))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def normalised(rest: Column) -> Column:
    """What the models read of a URL."""
    return F.regexp_replace(F.regexp_replace(F.lower(rest), "[0-9]+", "0"), r"[^a-z0./\-_?=&#%:]", "~")


def _grams(url: Column) -> Column:
    """All n-grams up to ORDER that end at a symbol or at the last mark of beginning."""
    marked = F.concat(F.lit("^" * ORDER), url, F.lit("$"))
    ends = F.sequence(F.lit(ORDER), F.length(marked))
    each = lambda end: F.array(*[F.substr(marked, end - (n - 1), F.lit(n)) for n in range(1, ORDER + 1)])
    return F.flatten(F.transform(ends, each))


def fit(labelled: DataFrame) -> DataFrame:
    """gram, weight from (url, allowed: boolean), the URLs normalised."""
    seen = (
        labelled.groupBy("url").agg(F.sum(F.col("allowed").cast("long")).alias("a"), F.sum((~F.col("allowed")).cast("long")).alias("b"))
        .select(F.explode(_grams(F.col("url"))).alias("gram"), "a", "b")
        .where(~F.endswith("gram", F.lit("^")))
        .groupBy("gram")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    seen = cut(seen.withColumn("context", F.substr("gram", F.lit(1), F.length("gram") - 1)))
    contexts = seen.groupBy("context").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    contexts = contexts.where((F.col("all_a") + F.col("all_b") >= MIN_CONTEXT) | (F.col("context") == ""))
    known = cut(seen.join(contexts, "context"))
    estimate = lambda n, all_n, shorter: (F.col(n) + PRIOR * F.col(shorter)) / (F.col(all_n) + PRIOR)
    uniform = F.lit(1.0 / (len(ALPHABET) + 1))
    before, weights = None, []
    for n in range(1, ORDER + 1):
        own = known.where(F.length("gram") == n)
        if before is None:
            own = own.select("*", uniform.alias("short_a"), uniform.alias("short_b"))
        else:
            shorter = before.select(F.col("gram").alias("ending"), F.col("p_a").alias("short_a"), F.col("p_b").alias("short_b"))
            own = own.join(shorter, F.substr("gram", F.lit(2)) == F.col("ending")).drop("ending")
        before = own.withColumn("p_a", estimate("a", "all_a", "short_a")).withColumn("p_b", estimate("b", "all_b", "short_b"))
        unseen = F.ln((F.col("all_b") + PRIOR) / (F.col("all_a") + PRIOR))
        gain = F.ln(F.col("p_a") / F.col("p_b")) - F.ln(F.col("short_a") / F.col("short_b"))
        weights.append(before.select("gram", (gain - (unseen if n > 1 else F.lit(0.0))).alias("weight")))
        if n > 1:  # what any symbol after this context gains, seen there or not
            weights.append(contexts.where(F.length("context") == n - 1).select(F.col("context").alias("gram"), unseen.alias("weight")))
    all_weights = weights[0]
    for more in weights[1:]:
        all_weights = all_weights.unionByName(more)
    return cut(all_weights.groupBy("gram").agg(F.sum("weight").alias("weight")))


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """url, score, pages: length-normalised log-likelihood difference of each distinct non-empty normalised URL."""
    each = urls.where(F.col("url") != "").groupBy("url").agg(F.count("*").alias("pages"))
    terms = each.select("url", "pages", F.explode(_grams(F.col("url"))).alias("gram")).join(F.broadcast(model), "gram")
    return terms.groupBy("url").agg((F.sum("weight") / (F.length("url") + 1)).alias("score"), F.first("pages").alias("pages"))


def calibrated(labelled: DataFrame, model: DataFrame) -> float:
    """The score from which URLs are allowed: the best balanced accuracy on these labelled URLs."""
    binned = F.floor(F.least(F.greatest(F.col("score"), F.lit(-LIMIT)), F.lit(LIMIT)) / BIN)
    counts = labelled.join(scored(labelled, model), "url").groupBy(binned.alias("bin"), "allowed").count().collect()
    bins = sorted({r["bin"] for r in counts})
    of = {(r["bin"], r["allowed"]): r["count"] for r in counts}
    allowed, blocked = (sum(of.get((b, kind), 0) for b in bins) for kind in (True, False))
    if not allowed or not blocked:
        return float("-inf")
    best, threshold, right, wrong = -1.0, float("-inf"), allowed, blocked
    for b in bins:
        if (balanced := right / allowed + 1 - wrong / blocked) > best:
            best, threshold = balanced, b * BIN
        right -= of.get((b, True), 0)
        wrong -= of.get((b, False), 0)
    return threshold


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    host, path, rest = parts(F.col("url"))
    held_out = F.crc32(rest) % FOLDS == 0
    read = pages.select("page_id", host.alias("host"), path.alias("path"), normalised(rest).alias("url"), held_out.alias("held_out"))
    read = read.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    taught = read.where("by_rule is not null and url <> ''").select("url", (F.col("by_rule.verdict") == "allow").alias("allowed"), "held_out")
    model = fit(taught.where("not held_out"))
    threshold = calibrated(taught.where("held_out"), model)
    open_, judged_ = read.where("by_rule is null"), read.where("by_rule is not null")
    scores = cut(scored(open_, model))
    total = scores.agg(F.sum("pages")).first()[0] or 0
    # A URL of a thousandth of the pages or more: there are at most a thousand, so these may be broadcast.
    often = scores.where(F.col("pages") * HOT_SHARE > total).select("url", "score")
    seldom = scores.where(F.col("pages") * HOT_SHARE <= total).select("url", "score")
    hot = open_.join(F.broadcast(often), "url")
    rest = open_.join(F.broadcast(often), "url", "left_anti").join(seldom, "url", "left")
    everyone = hot.unionByName(rest).unionByName(judged_.withColumn("score", F.lit(None).cast("double")))
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return everyone.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
