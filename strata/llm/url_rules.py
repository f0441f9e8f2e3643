"""URL filters: domain rules given by the caller, and association rules mined with FP-growth.

Token combinations that are frequent among the URLs of block-labelled pages are mined by Spark's
FP-growth; their support over all labelled pages gives each rule's confidence. Rules match
through an inverted index on their rarest token.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut_lineage

#: (host and path, verdict)
DOMAIN_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Share of the block-labelled pages that a combination must occur in, of the labelled pages
#: with the combination that must be block-labelled, and pages it must occur in.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_PAGES = 0.005, 0.8, 5
#: Parts that the pages of one token are dealt over; rows that a hot token set is repeated to in one task.
SALTS, REPEATS = 32, 10_000
#: Largest count of fitting rules that is told apart.
MOST_RULES = 2.0**53
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z in lower case; '' without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ? # or the end; '' without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_rule(host: Column, path: Column, rules=DOMAIN_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host (or a parent domain of it) and
    whose path starts the url's path; nulls if none does."""
    name = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested last and so wins
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, host as a whole, path segments (digits folded),
    query keys and fragment mark. None without ``://``."""
    host, path = url_host(url), url_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    fold = lambda c: F.regexp_replace(F.translate(c, _UPPER, _LOWER), "[0-9]+", "0")
    parts = lambda c, by, tag: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(tag), fold(x)))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.when(
        host != "",
        F.array_distinct(F.concat(
            parts(host, "\\.", "h:"), F.array(F.concat(F.lit("host:"), host)), parts(path, "/", "p:"),
            F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), fold(x))),
        )),
    ).otherwise(F.array().cast("array<string>"))


def _matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of (``pages`` columns, rule columns) for each rule of which a page has a token of every item: the
    page's tokens meet the inverted index (tokens of the anchor item -> rules), then the whole rule is compared.

    A token can stand in every URL, so its pages are dealt over ``SALTS`` parts, each of which
    meets a copy of the (few) rules. A page with several tokens of the anchor meets its rule by the first of them."""
    probe = pages.withColumn("word", F.explode("tokens")).withColumn("salt", F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int"))
    index = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("word", F.explode("anchor"))
    first = F.array_intersect("anchor", "tokens")[0] == F.col("word")
    whole = F.forall("items", lambda item: F.arrays_overlap(item, "tokens"))
    return probe.join(index, ["word", "salt"]).where(first & whole).drop("salt", "word")


def token_classes(sets: DataFrame, least: int) -> DataFrame:
    """(item, n_block, n_all): the tokens in at least ``least`` block-labelled pages, as classes of tokens that
    occur in the same labelled pages; ``item`` is the class's sorted token array.

    ``sets`` (tokens, n_block, n_all) has one row per distinct token set. Two tokens are in the same sets if two
    64-bit hashes of these sets have equal sums. As every class has ``least`` pages, there are at most
    1 / support times as many tokens as an average block page has."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "tokens").cast("decimal(38,0)"))
    per_token = (
        sets.withColumn("token", F.explode("tokens")).groupBy("token")
        .agg(F.sum("n_block").alias("n_block"), F.sum("n_all").alias("n_all"), wide(1).alias("s1"), wide(2).alias("s2"))
        .where(F.col("n_block") >= least)
    )
    return per_token.groupBy("s1", "s2", "n_block", "n_all").agg(F.array_sort(F.collect_list("token")).alias("item")).select("item", "n_block", "n_all")


def _transactions(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(items): one row per block-labelled page with a token, of the first tokens of its classes. A hot token set is
    dealt over many tasks before its rows are repeated."""
    token = classes.select(F.col("item")[0].alias("token")).withColumn("known", F.lit(True))
    known = (
        sets.where("n_block > 0").select("tokens", "n_block", F.explode("tokens").alias("token")).join(token, "token", "left")
        .groupBy("tokens", "n_block").agg(F.collect_list(F.when(F.col("known"), F.col("token"))).alias("items"))
    )
    upto = lambda n: F.explode(F.sequence(F.lit(1), n))
    chunks = known.withColumn("chunk", upto(F.ceil(F.col("n_block") / REPEATS))).repartition("items", "chunk")
    left = F.least(F.lit(REPEATS), F.col("n_block") - (F.col("chunk") - 1) * REPEATS)
    return chunks.withColumn("copy", upto(left.cast("long"))).select("items")


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(anchor, items, n_block, n_all, confidence) from (tokens, block) rows.

    A rule is a token combination of any length that occurs in at least ``min_support`` of the block-labelled
    pages and ``min_pages`` of them, and of whose labelled pages ``min_confidence`` are
    block-labelled. Counts cover all labelled pages.

    Rules come folded: an item is a class of tokens that occur in the same labelled pages (``token_classes``), and
    stands for every choice of tokens from it, which all have the same counts. So FP-growth sees one item where a
    long URL on many pages has dozens. A class that is a rule by itself is given alone and not mined on: whatever
    a longer rule with it matches, it matches too. The anchor is the item in the fewest block-labelled pages."""
    sets = labelled.where(F.size("tokens") > 0).groupBy("tokens").agg(
        F.sum(F.col("block").cast("long")).alias("n_block"), F.count("*").alias("n_all"))
    sets = cut_lineage(sets)
    n_pages = sets.agg(F.sum("n_block")).first()[0] or 0
    least = max(math.ceil(min_support * n_pages), min_pages, 1)
    classes = cut_lineage(token_classes(sets, least).withColumn("confidence", F.col("n_block") / F.col("n_all")))
    alone = classes.where(F.col("confidence") >= min_confidence)
    alone = alone.select(F.col("item").alias("anchor"), F.array("item").alias("items"), "n_block", "n_all", "confidence")
    rest = classes.where(F.col("confidence") < min_confidence)

    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(_transactions(sets, rest))
    found = model.freqItemsets.where((F.col("freq") >= least) & (F.size("items") > 1))
    found = found.select(F.array_sort("items").alias("names"), F.col("freq").alias("n_block"))
    item = rest.select(F.col("item")[0].alias("name"), "item", F.col("n_block").alias("freq"))
    folded = (
        found.withColumn("name", F.explode("names")).join(item, "name").groupBy("names", "n_block")
        .agg(F.min(F.struct("freq", "item"))["item"].alias("anchor"), F.array_sort(F.collect_list("item")).alias("items"))
    )
    counts = _matches(sets.select("tokens", "n_all"), folded).groupBy("items", "n_block", "anchor").agg(F.sum("n_all").alias("n_all"))
    longer = counts.withColumn("confidence", F.col("n_block") / F.col("n_all")).where(F.col("confidence") >= min_confidence)
    return longer.select(*alone.columns).unionByName(alone)


def judge_urls(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=DOMAIN_RULES,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``labels`` (doc_id, quality, toxic) label the pages with the same id: block if any of its
    rows has quality 0 or is toxic. A domain rule decides first; otherwise an association rule
    that matches blocks, and the rest is allowed. A null url, or one without ``://``, has empty
    host and path, fits nothing and is allowed. Null ids get a verdict but no label; repeated
    rows each give a row. Without block labels there are no association rules. ``n_rules`` counts the
    token combinations among the mined rules that fit (at most ``MOST_RULES``)."""
    marked = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("block")
    )
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    tokens = rows.withColumn("tokens", url_tokens(F.col("url")))
    labelled = tokens.join(marked, F.col("page_id") == F.col("label_id")).select("tokens", "block")
    found = mine_rules(labelled, min_support, min_confidence, min_pages)
    blocked = _matches(tokens.select("url", "tokens").distinct(), found.select("anchor", "items"))
    choices = F.transform("items", lambda item: F.pow(F.lit(2.0), F.size(F.array_intersect(item, "tokens"))) - 1)
    fits = F.aggregate(choices, F.lit(1.0), lambda n, x: n * x)
    blocked = blocked.groupBy("url").agg(F.least(F.sum(fits), F.lit(MOST_RULES)).alias("n_rules"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    name, verdict = domain_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("given", verdict).join(blocked, "url", "left")
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("given", F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
    )
