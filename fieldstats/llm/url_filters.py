"""Association-rule URL filtering: FP-growth on labelled URLs, rules matched by index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.common import settled

BAD = "label=bad"
#: Labelled URLs that a rule needs at least.
MIN_ROWS = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host and its endings, path words, query keys. Empty for no URL."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("([^&=]+)(=[^&]*)?"), 1)
    mark = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.coalesce(
        F.array_distinct(F.concat(mark("h:", labels), mark("p:", words), mark("q:", keys))),
        F.array().cast("array<string>"),
    )


def few_token_rules(labelled: DataFrame, counts: DataFrame, min_confidence: float, min_rows: int) -> DataFrame:
    """Rules of one or two tokens: ``tokens``, ``bad`` and ``all`` rows, counted exactly.

    ``labelled`` has ``_row``, ``tokens`` and ``bad``; ``counts`` has ``_token``, ``_bad`` and ``_all``. The same
    rows are a rule in a table of any size. Pairs are made of tokens with ``min_rows`` bad rows that
    are no rules themselves: others are in no pair that counts, or in covered ones only.
    """
    sure = F.col("_bad") >= F.col("_all") * min_confidence
    often = counts.filter(F.col("_bad") >= min_rows)
    single = often.filter(sure).select(F.array("_token").alias("tokens"), F.col("_bad").alias("bad"), F.col("_all").alias("all"))
    open_ = (
        labelled.select("_row", "bad", F.explode("tokens").alias("_token"))
        .join(often.filter(~sure).select("_token"), "_token")
        .groupBy("_row", "bad")
        .agg(F.array_sort(F.collect_list("_token")).alias("_open"))
    )
    after = lambda i: F.slice("_open", i + 2, F.size("_open"))
    pairs = F.flatten(F.transform("_open", lambda x, i: F.transform(after(i), lambda y: F.array(x, y))))
    pair = (
        open_.select("bad", F.explode(pairs).alias("tokens"))
        .groupBy("tokens")
        .agg(F.count_if("bad").alias("bad"), F.count("*").alias("all"))
        .filter((F.col("bad") >= min_rows) & (F.col("bad") >= F.col("all") * min_confidence))
    )
    return single.unionByName(pair)


def mine_rules(
    labelled: DataFrame, min_support: float, min_confidence: float, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Rules (``tokens`` -> bad): ``rule_id``, ``tokens``, ``key``, ``confidence``, ``support``.

    ``labelled`` has ``tokens`` and the boolean ``bad``. FP-growth counts token combinations of any
    length with the label; they need ``min_support`` of the rows, and at least ``min_rows``. Combinations
    of one or two tokens need ``min_rows`` only (``few_token_rules``). Rules below ``min_confidence``
    go, and so do those whose part already is a rule (they match nothing else). ``key`` is the
    token of the rule that fewest labelled URLs have, the one it is looked up by.
    """
    rows = settled(
        labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("_row"), "tokens", "bad")
    )
    items = F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens"))
    baskets, n = rows.select(items.alias("items")), max(1, rows.count())
    support = min(1.0, max(min_support, min_rows / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    counts = settled(
        rows.select("bad", F.explode("tokens").alias("_token"))
        .groupBy("_token")
        .agg(F.count_if("bad").alias("_bad"), F.count("*").alias("_all"))
    )
    named = lambda tokens: [F.concat_ws("\x1f", F.array_sort(tokens)).alias("rule_id"), F.array_sort(tokens).alias("tokens")]
    few = few_token_rules(rows, counts, min_confidence, min_rows).select(
        *named("tokens"), (F.col("bad") / F.col("all")).alias("confidence"), (F.col("bad") / n).alias("support")
    )
    many = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") > 2)).select(
        *named("antecedent"), "confidence", "support"
    )
    rules = settled(few.unionByName(many))
    longer, shorter = rules.select("rule_id", "tokens", F.explode("tokens").alias("_token")), rules
    covered = (
        longer.join(
            shorter.select(F.col("rule_id").alias("_part"), F.col("tokens").alias("_few"), F.element_at("tokens", 1).alias("_token")),
            "_token",
        )
        .filter((F.col("rule_id") != F.col("_part")) & (F.size(F.array_except("_few", "tokens")) == 0))
        .select("rule_id")
        .distinct()
    )
    keyed = (
        longer.select("rule_id", "_token")
        .join(counts, "_token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("_all", "_token"))["_token"].alias("key"))
    )
    return rules.join(covered, "rule_id", "left_anti").join(keyed, "rule_id")


def host_rules(labelled: DataFrame, min_confidence: float, min_rows: int = MIN_ROWS) -> DataFrame:
    """Whole hosts that are bad: ``host`` and ``host_rule``, whatever their share of the labels.

    ``labelled`` has ``host`` and the boolean ``bad``. Hosts are counted exactly, so the same
    evidence is a rule in a table of any size.
    """
    return (
        labelled.filter(F.col("host") != "")
        .groupBy("host")
        .agg(F.count_if("bad").alias("_bad"), F.count("*").alias("_all"))
        .filter((F.col("_bad") >= min_rows) & (F.col("_bad") >= F.col("_all") * min_confidence))
        .select("host", F.concat(F.lit("host="), "host").alias("host_rule"))
    )


def match_rules(pages: DataFrame, id_col: str, rules: DataFrame) -> DataFrame:
    """Ids whose tokens hold all tokens of some rule: id and ``mined_rule``, the first by name.

    The rules form an inverted index under their rarest token; a URL looks its tokens
    up there and compares the rest of each rule found.
    """
    return (
        pages.select(F.col(f"`{id_col}`").alias("_id"), "tokens", F.explode("tokens").alias("key"))
        .join(rules.select("key", F.col("tokens").alias("_need"), "rule_id"), "key")
        .filter(F.size(F.array_except("_need", "tokens")) == 0)
        .groupBy(F.col("_id").alias(id_col))
        .agg(F.min("rule_id").alias("mined_rule"))
    )


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule name and verdict of the longest listed rule (host, path, verdict) that fits; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge_urls(
    pages: DataFrame,
    id_col: str,
    url_col: str,
    labels: DataFrame,
    listed: Sequence[tuple[str, str, str]],
    min_support: float = 0.005,
    min_confidence: float = 0.6,
) -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule``, ``mined_rule``, ``verdict``.

    ``labels`` has ``id_col`` and the boolean ``bad``. A listed rule decides first; where
    none fits, a mined rule blocks and everything else is allowed. Null or odd URLs have
    empty host and path, no tokens, and are allowed; pages without a label and labels
    without a page are left out of the mining; null labels too. Without labels nothing
    is mined. Rows that repeat an id get their own verdicts; the rule of tokens is the id's.
    A rule of the whole host is named before one of tokens. Of two equally long listed rules
    that fit, the later one in ``listed`` decides.
    """
    url = F.col(f"`{url_col}`")
    seen = pages.select(F.col(f"`{id_col}`").alias("_id"), url.alias("_url"))
    tokens = seen.select("_id", url_tokens(F.col("_url")).alias("tokens"))
    hosts = seen.select("_id", host_of(F.col("_url")).alias("host"))
    marks = labels.select(F.col(f"`{id_col}`").alias("_id"), "bad").filter(F.col("bad").isNotNull())
    rules = settled(mine_rules(tokens.join(marks, "_id"), min_support, min_confidence))
    mined = match_rules(tokens, "_id", rules)
    by_host = settled(host_rules(hosts.join(marks, "_id"), min_confidence))
    parts = seen.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    return (
        parts.withColumns({"rule": rule, "verdict": verdict})
        .join(mined, "_id", "left")
        .join(by_host, "host", "left")
        .withColumn("mined_rule", F.coalesce("host_rule", "mined_rule"))
        .select(
            F.col("_id").alias(id_col),
            "host",
            "path",
            "rule",
            "mined_rule",
            F.coalesce("verdict", F.when(F.col("mined_rule").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
        )
    )
