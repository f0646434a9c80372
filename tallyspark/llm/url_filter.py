"""URL filtering by listed rules and by association rules that FP-growth mines from labelled URLs.

A listed rule `host/path` fits its host and all subdomains where the url's path starts with the rule's path; the longest
wins. Urls that no listed rule fits are judged by the mined rules: Spark's FP-growth finds token combinations that go
with a label. Tokens that occur in exactly the same urls are one item, and tokens of every url none, so the sets that are
mined don't multiply with what urls have in common anyway; a support is the same share of urls in tables of any size. Rules
are pruned by support, by Laplace's estimate of their confidence, (right + 1) / (urls + 2), for which one or two urls are never
enough, and where some of their tokens alone are as sure of the same label; all others are matched, through an inverted index from each rule's rarest token: a literal map inside the scan for
up to LITERAL_RULES rules, a skew-safe join beyond, with equal results.

Labels come as a table of (url, label). `labelled` makes one where there is none: the listed rules' verdicts and, for other
urls, `block` where a word of the host is one that spam lives on (a parameter), else `allow`; so mining finds what else such
urls have in common, and drops what it shares with the rest.

Defined results: a null url, or one without `://`, has empty host and path, no listed rule and the default verdict;
equal confidence is decided by support, then by size, then by the rule's text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_classes, stored

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
#: Rules up to this number travel in the plan; an antecedent up to SUBSETS tokens is held against all its subsets.
LITERAL_RULES, SUBSETS = 2_000, 12
#: Words of a host that label a url as spam, to start with.
SPAM_WORDS = tuple(
    "spam farm casino casinos poker slots jackpot roulette blackjack betting bets lottery bingo wager pills pill viagra cialis levitra xanax valium tramadol phentermine pharmacy "
    "payday loans loan forex binary replica replicas knockoff porn porno xxx sex escort escorts nude adult webcam dating hookup warez crack cracks keygen serial torrents "
    "cheap discount coupons giveaway prize winner bitcoin doubler ringtones toolbar seo backlinks traffic clicks".split())  # fmt: skip
DEFAULT = "allow"
#: Fixed rules of the registered query: (verdict, rule).
LISTED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _index(pairs: dict[str, list]) -> Column:
    """A literal map from key to array; keys are few by parameter."""
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*v))])


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, or null. Looked up by each suffix of the host."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,path:string,verdict:string>")
    index: dict[str, list] = {}
    for verdict, rule in rules:
        at = rule.find("/")
        r = F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(rule[at:]).alias("path"), F.lit(verdict).alias("verdict"))
        index.setdefault(rule[:at], []).append(r)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    m = _index(index)
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(m, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: host labels with their distance from the end, words of hyphenated ones, path segments, extension, query keys; digits as #."""
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x))
    joined = F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-")))  # other labels are tokens already
    words = F.transform(F.flatten(F.transform(joined, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    exts = F.when(ext != "", F.array(F.concat(F.lit("x:"), ext))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(hosts, words, segments, keys, exts))


RULE = "tokens array<string>, label string, confidence double, support double"


def items(rows: DataFrame, n_urls: int) -> DataFrame:
    """(token, item) of (row, tokens): tokens that occur in exactly the same urls share an item, the first of them; those of every url have none.

    What a token occurs in is known by the number of its rows and two sums of their hashes.
    """
    each = rows.select("row", F.explode("tokens").alias("token"))
    sums = [F.sum(F.xxhash64(F.lit(k), "row").bitwiseAND((1 << 40) - 1)) for k in (1, 2)]
    per = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), sums[0].alias("a"), sums[1].alias("b")).where(F.col("n") < n_urls)
    return per.join(per.groupBy("n", "a", "b").agg(F.min("token").alias("item")), ["n", "a", "b"]).select("token", "item", "n")


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, label, confidence, support, key) of the pruned rules from (url, label) rows; label is not null.

    Frequent sets are at most 2^items / min_support, however many urls there are. key is the rule's rarest token.
    """
    spark = urls.sparkSession
    rows = stored(urls.select(tokens(F.col("url")).alias("tokens"), F.concat(F.lit("label="), "label").alias("label")).withColumn("row", F.monotonically_increasing_id()))
    if not (n_urls := rows.count()):
        return spark.createDataFrame([], RULE + ", key string")
    known = stored(items(rows, n_urls))
    per = rows.select("row", F.explode("tokens").alias("token")).join(known.where("token = item"), "token").groupBy("row").agg(F.collect_list("item").alias("items"))
    sets = rows.join(per, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets)
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("label=")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("label="))))
    right = F.col("support") * n_urls
    found = found.withColumn("confidence", (right + 1) / (right / F.col("confidence") + 2)).where(F.col("confidence") >= min_confidence)
    found = stored(found.select(F.array_sort("antecedent").alias("tokens"), F.replace(F.col("consequent")[0], F.lit("label=")).alias("label"), "confidence", "support"))
    # rules that a part of them makes needless; longer ones than SUBSETS stay, which changes no verdict
    n = F.size("tokens")
    masks = F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2.0), n) - 2).cast("long"))
    part = F.explode(F.transform(masks, lambda m: F.filter("tokens", lambda x, i: F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1)))
    parts = found.where(n.between(2, SUBSETS)).select("tokens", "label", "confidence", part.alias("part"))
    by = found.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("sure"))
    covered = parts.join(by, ["part", "label"]).where("sure >= confidence").select("tokens", "label").distinct()
    kept = found.join(covered, ["tokens", "label"], "left_anti")
    each = kept.select("tokens", "label", F.explode("tokens").alias("token"))
    key = each.join(known.select("token", "n"), "token").groupBy("tokens", "label").agg(F.min_by("token", F.struct("n", "token")).alias("key"))
    return stored(kept.join(key, ["tokens", "label"]).select("tokens", "label", "confidence", "support", "key"))


#: As compared to find the surest rule.
RANK = "struct<confidence:double,support:double,size:int,tokens:array<string>,label:string>"


def rank() -> Column:
    return F.struct("confidence", "support", (-F.size("tokens")).alias("size"), "tokens", "label")


def surest(rules: Column, have: Column) -> Column:
    """Of an array of ranks the surest rule whose tokens a url has all of, or null."""
    return F.array_max(F.filter(rules, lambda r: F.size(F.array_except(r["tokens"], have)) == 0))


def matched(rows: DataFrame, mined: DataFrame | None) -> DataFrame:
    """rows (row, tokens, open, ...) with `mined`: the surest rule of a row that is open, else null."""
    n = mined.count() if mined is not None else 0
    if not n:
        return rows.withColumn("mined", F.lit(None).cast(RANK))
    grouped = mined.groupBy("key").agg(F.collect_list(rank()).alias("rules"))
    if n <= LITERAL_RULES:
        index = {
            r["key"]: [
                F.struct(
                    F.lit(x["confidence"]).alias("confidence"), F.lit(x["support"]).alias("support"), F.lit(x["size"]).alias("size"),
                    F.array(*map(F.lit, x["tokens"])).alias("tokens"), F.lit(x["label"]).alias("label"))
                for x in r["rules"]]
            for r in grouped.orderBy("key").collect()}
        m = _index(index)
        found = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at(m, t)), lambda x: x.isNotNull()))
        return rows.withColumn("mined", F.when(F.col("open"), surest(found, F.col("tokens"))))
    rows = stored(rows)
    each = rows.where("open").select("row", "tokens", F.explode("tokens").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hits = join_classes(each, grouped.join(often, "key"), "key", "n", max(1, each.count())).where("rules is not null")
    best = hits.select("row", surest(F.col("rules"), F.col("tokens")).alias("mined")).where("mined is not null").groupBy("row").agg(F.max("mined").alias("mined"))
    return rows.join(best, "row", "left")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = LISTED, mined: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) for every row."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    p = p.withColumn("listed", listed(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    p = matched(p.withColumn("open", F.col("listed").isNull()), mined)
    return p.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), F.col("mined.label"), F.lit(default)).alias("verdict"),
        F.array_join("mined.tokens", " ").alias("mined_rule"), F.col("mined.confidence").alias("confidence"))


def labelled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = LISTED, spam_words: tuple[str, ...] = SPAM_WORDS) -> DataFrame:
    """(url, label): the listed verdict, else block for hosts with a spam word, else allow; urls without a host have none."""
    host = host_of(F.col("url"))
    spam = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, spam_words)))
    label = F.coalesce(listed(host, path_of(F.col("url")), rules)["verdict"], F.when(spam, "block").otherwise("allow"))
    return pages.where(host != "").select("url", label.alias("label"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = LISTED, default: str = DEFAULT) -> DataFrame:
    """Labels the urls, mines the labels, and judges every row."""
    return judge(pages, rules, mine(labelled(pages, rules)), default)
