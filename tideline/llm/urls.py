"""URL filtering by host and path rules, and by the ratio of two character language models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Characters of the longest context, and how often a context must occur for its statistics to be used.
ORDER, LEAST_COUNT = 3, 8
#: Characters that the models know; every other one counts as ``*``.
OTHER = r"[^a-z0-9./:?#=&_%+~$-]"
#: Rows of a model that are broadcast at most; a larger one is joined by shuffling.
MODEL_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits (by host and path together; ties: the first given), else null."""
    found = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][1]) + len(rules[i][2]), -i))
    for i in order:  # the last to fit is the longest
        _, h, p = rules[i]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule (like ``net/``; null if none fits) and ruled (the rule's verdict or null)."""
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    names = F.array(*[F.lit(h + p) for _, h, p in rules])
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules])
    return rows.withColumns({"rule": F.get(names, F.col("__rule")), "ruled": F.get(verdicts, F.col("__rule"))}).drop("__rule")


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with (g0 .. gORDER) for each character: the character after contexts of 0 to ORDER characters.

    The url is lower-cased and ends in ``$``; contexts before its beginning are filled with ``^``.
    """
    said = F.concat(F.lit("^" * ORDER), F.regexp_replace(F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER), OTHER, "*"), F.lit("$"))
    # an array of characters, since a place in a string is found only by walking there
    rows = rows.withColumn("__said", F.split(said, ""))
    ends = F.transform(F.sequence(F.lit(0), F.size("__said") - ORDER - 1), lambda i: F.concat(*[F.get("__said", i + j) for j in range(ORDER + 1)]))
    rows = rows.select(*keep, F.explode_outer(ends).alias(f"g{ORDER}"))
    return rows.select(*keep, *[F.substring(F.col(f"g{ORDER}"), ORDER + 1 - k, k + 1).alias(f"g{k}") for k in range(ORDER + 1)])


@dataclass(frozen=True)
class Model:
    tables: tuple[DataFrame, ...]  # by order: (gram, ratio)
    threshold: float


def _tables(labelled: DataFrame) -> tuple[DataFrame, ...]:
    """By order, (gram, ratio): log P(accepted) - log P(rejected) of a character after its context.

    A context is used if it occurs LEAST_COUNT times or more over both classes. Each class smooths its estimate
    with that of the next shorter context (Witten-Bell), down to a uniform one, so a ratio is never infinite.
    """
    counts = _grams(labelled, "ruled").groupBy("ruled", f"g{ORDER}").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    accepted = F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0))
    rejected = F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0))
    tables, shorter = [], None
    for k in range(ORDER + 1):
        gram = F.substring(F.col(f"g{ORDER}"), ORDER + 1 - k, k + 1)
        grams = counts.groupBy(gram.alias("gram")).agg(accepted.alias("na"), rejected.alias("nb"))
        kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
        context = F.substring(F.col("gram"), 1, k)
        grams = grams.withColumn("context", context if k else F.lit(""))
        totals = grams.groupBy("context").agg(F.sum("na").alias("ca"), F.sum("nb").alias("cb"), kinds("na").alias("ka"), kinds("nb").alias("kb"))
        grams = grams.join(totals.where(F.col("ca") + F.col("cb") >= (LEAST_COUNT if k else 0)), "context")
        if shorter is None:
            grams = grams.withColumns({"qa": F.lit(1 / 64), "qb": F.lit(1 / 64)})
        else:
            below = shorter.select(F.col("gram").alias("__short"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            grams = grams.join(below, F.substring(F.col("gram"), 2, k) == F.col("__short"))
        # a class that never saw the context keeps the shorter context's estimate
        smooth = lambda n, c, kinds, q: F.when(F.col(c) > 0, (F.col(n) + F.col(kinds) * F.col(q)) / (F.col(c) + F.col(kinds))).otherwise(F.col(q))
        grams = grams.withColumns({"pa": smooth("na", "ca", "ka", "qa"), "pb": smooth("nb", "cb", "kb", "qb")})
        shorter = materialize(grams.select("gram", "pa", "pb"))
        tables.append(shorter.select("gram", (F.log("pa") - F.log("pb")).alias("ratio")))
    return tuple(tables)


def _scored(rows: DataFrame, tables: tuple[DataFrame, ...], *keep: str) -> DataFrame:
    """(keep, score): mean over a url's characters of the ratio after the longest known context, else 0.

    Each row is scored under an id of its own, which no other row of this one plan has.
    """
    grams = _grams(rows.withColumn("__row", F.monotonically_increasing_id()), "__row", *keep)
    for k, table in enumerate(tables):
        table = table.select(F.col("gram").alias(f"__g{k}"), F.col("ratio").alias(f"r{k}"))
        grams = grams.join(checked_broadcast(table, MODEL_ROWS), grams[f"g{k}"] == F.col(f"__g{k}"), "left")
    ratio = F.coalesce(*[F.col(f"r{k}") for k in reversed(range(ORDER + 1))], F.lit(0.0))
    return grams.groupBy("__row", *keep).agg(F.round(F.avg(ratio), 9).alias("score")).drop("__row")


def fit(judged: DataFrame) -> Model | None:
    """Learns from the urls that rules have judged; None unless there are some of both verdicts.

    The threshold is calibrated on their scores: between the two classes' means, divided by their spreads.
    """
    labelled = judged.where("ruled is not null").select("url", "ruled")
    if {r["ruled"] for r in labelled.select("ruled").distinct().collect()} != {"allow", "block"}:
        return None
    tables = _tables(labelled)
    stats = _scored(labelled, tables, "ruled").groupBy("ruled").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()
    at = {r["ruled"]: (r["m"], r["s"] + 1e-9) for r in stats}
    (ma, sa), (mb, sb) = at["allow"], at["block"]
    return Model(tables, round((ma * sb + mb * sa) / (sa + sb), 9))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages``.

    The verdict is the rule's where one fits; else the url is blocked if its score is below the threshold of
    the models learned from the ruled urls, and allowed under no model. A null url, or one without ``://``, has
    empty host and path and is scored like any text. Repeated rows stay; an empty table gives no rows.
    """
    judged = judged_by_rules(pages.select("page_id", "url"), rules)
    model = fit(judged)
    if model is None:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    scored = _scored(judged, model.tables, "page_id", "host", "path", "rule", "ruled")
    verdict = F.coalesce("ruled", F.when(F.col("score") < model.threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
