"""URL filters: host and path rules first, else a character language-model ratio; DataFrame functions only.

URLs that a rule decides are the labelled rows: allowed ones train one variable-order Markov model of characters, blocked
ones another. Both interpolate orders 3 to 0 by Witten-Bell weights over an alphabet of 32 symbols (letters, one digit
symbol, one each for / . - and for query marks, one for all else, and the start), so their tables have at most 32 ** 4
rows, whatever the input; the table of gram scores is counted, and broadcast up to that bound. The verdict compares the
difference of log-likelihoods for each character with a threshold that is calibrated on three sixteenths of the labelled URLs,
which trains neither model: that with the least sum of both error rates, of 0.05 wide steps.

Defined cases: a null or empty url is blocked (host and path empty); without labelled URLs of both kinds every other url
is allowed; repeated rows are judged alike and counted each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import cut, lower_ascii, small_join

ORDER, SYMBOLS, STEP = 3, 32, 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, a struct of name and verdict; null if none does."""
    out = F
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = (host.eqNullSafe(r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = out.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
    return out if out is not F else F.lit(None).cast("struct<name:string,verdict:string>")


def held_out(page_id: Column) -> Column:
    """Whether a labelled row calibrates rather than trains: by the first digit of its id's md5."""
    return F.substring(F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary")), 1, 1).isin("0", "1", "2")


def symbols(url: Column) -> Column:
    """url over 32 symbols: a-z; 0 for a digit; / . -; ? for any of ?&=#; _ for all else."""
    low = lower_ascii(F.coalesce(url, F.lit("")))
    return F.regexp_replace(F.translate(low, "123456789&=#", "000000000???"), r"(?s)[^a-z0/.?-]", "_")


def grams_of(text: Column) -> Column:
    """The ORDER + 1 symbols that end at each symbol, after a start mark for each that is missing: one pass over the text."""
    padded = F.concat(F.lit("^" * ORDER), text)
    return F.regexp_extract_all(padded, F.lit(f"(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def gram_scores(counts: DataFrame) -> DataFrame:
    """From gram (4 symbols), allow and block (how often the labelled URLs have it): gram and delta, the difference of the
    log-probabilities of its last symbol after its first three. Gives every gram of counts a score."""
    tables = [counts.select("gram", "allow", "block")]
    for n in range(ORDER, 0, -1):
        tables.append(tables[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    lower = None
    for n, t in enumerate(reversed(tables)):
        context = W.partitionBy(F.substring("gram", 1, n)) if n else W.partitionBy()
        named = t.select("gram", F.substring("gram", 2, n).alias("rest"), *[x for k in ("allow", "block") for x in (F.col(k).alias(f"n_{k}"), F.sum(k).over(context).alias(f"all_{k}"), F.sum((F.col(k) > 0).cast("long")).over(context).alias(f"kinds_{k}"))])
        if lower is None:
            named = named.withColumns({f"low_{k}": F.lit(1.0 / SYMBOLS) for k in ("allow", "block")})
        else:
            named = named.join(lower.select(F.col("gram").alias("rest"), *[F.col(f"p_{k}").alias(f"low_{k}") for k in ("allow", "block")]), "rest")
        p = lambda k: F.when(F.col(f"all_{k}") == 0, F.col(f"low_{k}")).otherwise((F.col(f"n_{k}") + F.greatest(F.col(f"kinds_{k}"), F.lit(1)) * F.col(f"low_{k}")) / (F.col(f"all_{k}") + F.greatest(F.col(f"kinds_{k}"), F.lit(1))))
        lower = named.select("gram", p("allow").alias("p_allow"), p("block").alias("p_block"))
    return lower.select("gram", (F.log("p_allow") - F.log("p_block")).alias("delta"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides or the url is empty) for each row."""
    url = F.col("url").cast("string")
    named = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), symbols(url).alias("symbols"), held_out(F.col("page_id")).alias("held"))
    named = named.withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules))
    # a row number keeps apart rows that repeat an id; it is fixed once it is in the shared folder
    named = cut(named.withColumn("row", F.monotonically_increasing_id()))
    grams = named.where(F.length("symbols") > 0).select("row", F.col("ruled.verdict").alias("ruled"), "held", F.explode(grams_of(F.col("symbols"))).alias("gram"))
    seen = lambda v: F.count_if((F.col("ruled") == v) & ~F.col("held"))
    counts = cut(grams.groupBy("gram").agg(seen("allow").alias("allow"), seen("block").alias("block")))
    table = cut(gram_scores(counts))
    scores = small_join(grams, table, ["gram"], "inner", SYMBOLS ** (ORDER + 1)).groupBy("row").agg(F.round(F.sum("delta") / F.count("*"), 9).alias("score"))
    scored = cut(named.join(scores, "row", "left"))
    at = threshold(scored.where("held").select("score", F.col("ruled.verdict").alias("label")))
    passes = F.when(F.col("score") >= at, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", F.col("ruled.name").alias("rule"), F.coalesce(F.col("ruled.verdict"), passes).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))


def threshold(labelled: DataFrame) -> float:
    """Of score and label (allow or block): the multiple of 1 / STEP with the least sum of the share of allowed rows
    below it and the share of blocked rows not below it; the lowest such; -infinity where either label is missing."""
    known = labelled.where(F.col("label").isNotNull() & F.col("score").isNotNull())
    bins = known.groupBy(F.floor(F.col("score") * STEP).alias("bin")).agg(F.count_if(F.col("label") == "allow").alias("allow"), F.count_if(F.col("label") == "block").alias("block"))
    below, everything = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    lost = F.try_divide(F.coalesce(F.sum("allow").over(below), F.lit(0)), F.sum("allow").over(everything))
    passed = F.try_divide(F.sum("block").over(everything) - F.coalesce(F.sum("block").over(below), F.lit(0)), F.sum("block").over(everything))
    wrong = bins.select("bin", F.round(lost + passed, 9).alias("wrong")).where("wrong is not null")
    best = wrong.agg(F.min(F.struct("wrong", "bin")).alias("best")).first()["best"]
    return best["bin"] / STEP if best else float("-inf")
