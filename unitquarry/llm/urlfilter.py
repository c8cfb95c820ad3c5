"""URL filter by the ratio of two character language models.

Two variable-order Markov models with interpolated Witten-Bell smoothing are
estimated by grouped aggregation, one from accepted and one from rejected
URLs.  A URL's score is the difference of its log-likelihoods over its length;
it is blocked above a threshold calibrated on URLs that were held out.  Listed
rules come first.  Everything is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from unitquarry.llm.common import attach, lower_ascii
from unitquarry.runtime import cut

ORDER = 3
# Symbols of a URL's shape: letters, digit run, . - / _, anything else, start, end. A model has at most SYMBOLS^(ORDER+1) grams
# of full length, which bounds what is broadcast.
SYMBOLS = 26 + 8
# Fixed words of the usual filter categories (adult, gambling, pharmacy, advertising and tracking, spam and fraud) that mark a
# URL as an example of a rejected one: long ones anywhere in its host, short ones as a whole part between dots and hyphens.
REJECT_TERMS = (
    "adult", "escort", "porn", "casino", "gambl", "jackpot", "lottery", "poker", "sportsbook", "cialis", "viagra", "pharma", "adserv",
    "doubleclick", "malware", "phishing", "warez")
REJECT_PARTS = (
    "sex", "xxx", "bet", "bets", "betting", "slots", "pill", "pills", "drugs", "ad", "ads", "advert", "banner", "banners", "popup",
    "track", "tracker", "tracking", "spam", "scam", "linkfarm", "torrent")

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty if there is none or the URL is null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Longest fitting rule as text, and its action; both null if none fits.

    A rule is (action, host, path).  Of rules of one length the first by text wins.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def shape_of(host: Column, path: Column) -> Column:
    """What the models see: lower-cased host and path, digit runs as one symbol, rare symbols as one."""
    plain = F.regexp_replace(lower_ascii(F.concat(host, path)), "[0-9]+", "0")
    return F.concat(F.lit("^"), F.regexp_replace(plain, r"[^a-z0./_-]", "*"), F.lit(r"$"))


def _grams(shapes: DataFrame, first: int, least: int) -> DataFrame:
    """(..., at, size, gram): for each position from ``first`` its grams of ``least`` to ORDER + 1 symbols ending there."""
    ends = shapes.withColumn("at", F.explode(F.sequence(F.lit(first), F.length("shape"))))
    sized = ends.withColumn("size", F.explode(F.sequence(F.lit(least), F.least(F.lit(ORDER + 1), F.col("at")))))
    return sized.withColumn("gram", F.substring("shape", F.col("at") - F.col("size") + 1, F.col("size")))


def train(examples: DataFrame) -> DataFrame:
    """Model table from (shape, accepted, rejected: numbers of URLs).

    Columns: gram, gain (log of the ratio of its last symbol's smoothed
    probabilities after the others) and back (log of the ratio of the weights
    that unseen symbols after the gram leave to the shorter context).
    """
    counts = cut(_grams(examples, 2, 1).groupBy("size", "gram").agg(
        F.sum("accepted").alias("a"), F.sum("rejected").alias("r")))
    lower, parts = None, []
    for size in range(1, ORDER + 2):
        grams = counts.filter(F.col("size") == size).select("gram", "a", "r", F.expr(f"substring(gram, 1, {size - 1})").alias("context"))
        contexts = grams.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"),
            F.count(F.when(F.col("a") > 0, 1)).alias("da"), F.count(F.when(F.col("r") > 0, 1)).alias("dr"))
        full = grams.join(contexts, "context")
        if lower is None:
            full = full.withColumn("pa0", F.lit(1.0 / SYMBOLS)).withColumn("pr0", F.lit(1.0 / SYMBOLS))
        else:
            full = full.withColumn("_shorter", F.expr(f"substring(gram, 2, {size - 1})")).join(
                lower.select(F.col("gram").alias("_shorter"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0")), "_shorter")
        for c in "ar":
            seen = F.col(f"n{c}") > 0
            smooth = (F.col(c) + F.col(f"d{c}") * F.col(f"p{c}0")) / (F.col(f"n{c}") + F.col(f"d{c}"))
            full = full.withColumn(f"p{c}", F.when(seen, smooth).otherwise(F.col(f"p{c}0")))
            left = F.when(seen, F.col(f"d{c}") / (F.col(f"n{c}") + F.col(f"d{c}"))).otherwise(F.lit(1.0))
            contexts = contexts.withColumn(f"w{c}", left)
        lower = cut(full.select("gram", "pa", "pr"))
        parts.append(lower.select("gram", F.log(F.col("pr") / F.col("pa")).alias("gain"), F.lit(0.0).alias("back")))
        parts.append(contexts.select(
            F.col("context").alias("gram"), F.lit(None).cast("double").alias("gain"), F.log(F.col("wr") / F.col("wa")).alias("back")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return cut(every.groupBy("gram").agg(F.max("gain").alias("gain"), F.sum("back").alias("back")))


def ratio(shapes: DataFrame, model: DataFrame) -> DataFrame:
    """shape and its log-likelihood difference per symbol; ``shapes`` are distinct."""
    looked = _grams(shapes.select("shape"), 1, 0).select("shape", "at", "size", "gram")
    known = attach(looked, model, ["gram"], "inner", "gram")
    # A gram predicts the symbol it ends with, and is the context of the next one.
    roles = known.select(
        "shape", "size", "gain", "back",
        F.explode(F.array(F.struct(F.col("at").alias("at"), F.lit(True).alias("predicts")),
                          F.struct((F.col("at") + 1).alias("at"), F.lit(False).alias("predicts")))).alias("role"))
    # The start is given, nothing predicts it.
    hits = roles.filter((F.col("role.at") >= 2) & (F.col("role.at") <= F.length("shape")))
    predicts = F.col("role.predicts") & F.col("gain").isNotNull()
    backs = [F.coalesce(F.max(F.when(~F.col("role.predicts") & (F.col("size") == s), F.col("back"))), F.lit(0.0)).alias(f"b{s}")
             for s in range(ORDER + 1)]
    at = hits.groupBy("shape", F.col("role.at").alias("at")).agg(
        F.max(F.when(predicts, F.struct("size", "gain"))).alias("best"), *backs)
    size = F.coalesce(F.col("best.size"), F.lit(0))
    gain = F.coalesce(F.col("best.gain"), F.lit(0.0))
    for s in range(ORDER + 1):
        gain = gain + F.when(size <= s, F.col(f"b{s}")).otherwise(F.lit(0.0))
    return at.groupBy("shape").agg(F.sum(gain).alias("score")).withColumn("score", F.col("score") / (F.length("shape") - 1))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], reject_terms: Sequence[str] = REJECT_TERMS, reject_parts: Sequence[str] = REJECT_PARTS,
    accepted_lost: float = 0.001,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (page_id, url).

    Rejected examples are URLs whose host contains one of ``reject_terms`` or
    has one of ``reject_parts`` between its dots and hyphens, accepted ones all
    others that no rule blocks.  A fifth of the shapes, by
    hash, is held out of the counts to calibrate the threshold: at most
    ``accepted_lost`` of the accepted ones held out lie above it, and it is
    not below 0.  Null URLs and those without ``://`` have empty host and path
    and are judged by the models like any other; repeated rows are judged
    alike; an empty table gives no rows; further columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    parsed = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("rule", rule).withColumn("_action", action)
        .withColumn("shape", shape_of(F.col("host"), F.col("path"))))
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(p) for p in reject_parts])) if reject_parts else F.lit(False)
    for term in reject_terms:
        bad = bad | F.contains(F.col("host"), F.lit(term))
    good = ~bad & ~(F.coalesce(F.col("_action"), F.lit("")) == "block")
    shapes = cut(
        parsed.groupBy("shape").agg(
            F.count(F.when(good, 1)).alias("accepted"), F.count(F.when(bad, 1)).alias("rejected"))
        .withColumn("held", F.pmod(F.xxhash64("shape"), F.lit(5)) == 0))
    model = train(shapes.filter(~F.col("held") & (F.col("accepted") + F.col("rejected") > 0)))
    scored = cut(ratio(shapes, model))
    held = shapes.filter(F.col("held") & (F.col("accepted") > 0)).join(scored, "shape")
    level = held.agg(F.percentile_approx("score", 1 - accepted_lost, 100_000)).first()[0]
    judged = attach(parsed, scored, ["shape"], "left", "shape")
    score = F.coalesce(F.col("score"), F.lit(0.0))
    own = F.when(score > F.lit(max(0.0, level or 0.0)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_action", own).alias("verdict"), score.alias("score"))
