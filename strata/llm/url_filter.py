"""Verdicts on URLs: rules by host and path first, else a logistic regression on hashed character n-grams. DataFrame and SQL functions only.

``parts`` cuts a URL: the host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end (A-Z lower-cased), the path goes on to ``?``, ``#`` or the end.
A rule names a host (it holds for all subdomains) and what the path starts with; the longest that fits wins.

The classifier's features are the 3-grams of code points of ``^host$`` and of ``^path$``, hashed apart into ``BUCKETS`` buckets and counted; a URL's counts are divided by
their Euclidean length. It is trained from a small labelled table (``LABELLED``, or a table of at most ``MOST_LABELLED`` rows) by gradient descent with an L2 penalty, in its dual form:
weights that start at zero stay sums of the labelled rows, so the descent needs nothing but the rows' inner products, which are exact integers before they are scaled, and
runs inside one SQL expression. The weights (one number a bucket) are put into the plan, scaled to integers, so scores don't depend on the order of additions.
Judging is a projection: no shuffle, no join, and only ``url`` is read.

Defined results: a null url, or one without ``://``, has an empty host and path, is matched by no rule and is judged by the classifier's features of empty strings (``allow`` with ``LABELLED``). Very long
urls are used whole. Equal urls get equal verdicts; null ids and repeated rows are kept; other columns are ignored by ``judge`` and kept by ``keep``; no rows give no rows. Two rules of equal length that both fit can
only be the same rule: the first given counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._stage import cut

BUCKETS, SEEDS = 1 << 14, (7, 4099)  # of host and path
STEPS, RATE, PENALTY, SCALE = 200, 1.0, 0.002, 1 << 20
MOST_LABELLED = 1000

#: (block or allow, host, what the path starts with)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The small labelled table: URLs to block and URLs to allow. Names and endings are dealt alike to both sides, so that only the words count.
BLOCKED = [
    "http://casino-royal.example.com/en/12", "https://www.online-casino.example.org/es/88.html", "http://m.casino-bonus.example.com/fr/7", "https://big-win.example.org/en/402/", "http://poker-win.example.net/en/9?ref=x",
    "https://sports-bets.example.com/en/31", "http://www.live-bets.example.org/en/5", "https://bets-odds.example.net/es/44.html", "http://free-spins.example.org/en/61", "https://www.free-coins.example.net/fr/3",
    "http://spam-mail.example.com/en/17", "https://blog.spam-links.example.org/es/72", "http://link-farm.example.com/en/90/", "https://www.content-farm.example.org/en/15", "http://m.spam-bulk.example.net/fr/55",
    "https://cheap-meds.example.com/en/10", "http://www.cheap-watches.example.org/es/8", "https://diet-pills.example.com/fr/21.html", "http://pills-store.example.org/en/33", "https://m.buy-pills.example.net/en/6",
    "http://adult-video.example.com/en/77", "https://www.adult-chat.example.org/en/2", "http://blog.adult-cam.example.com/es/13/", "https://xxx-x.example.org/fr/99", "http://porn-x.example.net/en/4",
    "https://ads-server.example.com/en/81", "http://www.ads-banner.example.org/es/60", "https://track-click.example.com/en/18", "http://pixel-track.example.org/fr/29.html", "https://m.ads-pop.example.net/en/36",
]
ALLOWED = [
    "http://theatre.example.com/en/12", "https://www.history.example.org/es/88.html", "http://m.weather.example.com/fr/7", "https://garden.example.org/en/402/", "http://there.example.com/en/9?ref=x",
    "https://thomson.example.com/en/31", "http://www.nation.example.org/en/5", "https://station.example.com/es/44.html", "http://theory.example.org/en/61", "https://www.thread.example.com/fr/3",
    "http://library.example.com/en/17", "https://blog.kitchen.example.org/es/72", "http://motion.example.com/en/90/", "https://www.thistle.example.org/en/15", "http://m.fashion.example.com/fr/55",
    "https://science.example.com/en/10", "http://www.school.example.org/es/8", "https://thing.example.com/fr/21.html", "http://mothers.example.org/en/33", "https://m.other.example.com/en/6",
    "http://city-news.example.com/en/77", "https://www.open-data.example.org/en/2", "http://blog.travel.example.com/es/13/", "https://those.example.org/fr/99", "http://recipes.example.com/en/4",
    "https://authors.example.com/en/81", "http://www.museum.example.org/es/60", "https://thinking.example.com/en/18", "http://action.example.org/fr/29.html", "https://m.health.example.com/en/36",
    "", "https://example.com/", "https://example.org/en/1", "http://www.example.net/de/5.html", "https://thus.example.net/de/8", "http://blog.caption.example.net/fr/70?utm_source=feed",
]
LABELLED = [(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    own = F.split_part(F.translate(rest, "?#", "##"), F.lit("#"), F.lit(1))
    at = F.instr(own, "/")
    host = F.when(at > 0, own.substr(F.lit(1), at - 1)).otherwise(own)
    path = F.when(at > 0, own.substr(at, F.length(own))).otherwise(F.lit(""))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.when(host.isNotNull(), path), F.lit(""))


def _buckets(text: Column, seed: int) -> Column:
    """The bucket of each 3-gram of ^text$: a polynomial of its code points."""
    points = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("bigint"))
    rest = lambda k: F.slice(points, k, F.length(text) + 2)
    # three arrays side by side: what a lambda looks up by place it would make again for each element
    longer = lambda a, b: F.zip_with(a, b, lambda x, y: x * 8191 + F.coalesce(y, F.lit(0)))
    grams = F.slice(longer(longer(points, rest(2)), rest(3)), 1, F.greatest(F.length(text), F.lit(1)))
    return F.transform(grams, lambda g: F.pmod(g * 31 + seed, F.lit(1_000_003)) % BUCKETS)


def features(host: Column, path: Column) -> Column:
    """The buckets of a URL's n-grams, one for each occurrence."""
    return F.concat(_buckets(host, SEEDS[0]), _buckets(path, SEEDS[1]))


@dataclass
class Model:
    """weights: whole numbers, ``SCALE`` times the regression's, one a bucket."""

    weights: list[int]
    bias: float

    def probability(self, host: Column, path: Column) -> Column:
        """Of the class ``block``."""
        table = F.from_json(F.lit(str(self.weights)), "array<bigint>")
        own = F.array_sort(features(host, path))
        total = F.aggregate(own, F.lit(0).cast("bigint"), lambda s, b: s + F.get(table, b.cast("int")))
        # squares of the counts: in sorted order an occurrence that is the k-th of its bucket adds 2k - 1
        none = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("s"))
        squares = F.aggregate(own, none, lambda a, b: F.struct(b.alias("b"), F.when(a.b == b, a.k + 1).otherwise(F.lit(1).cast("bigint")).alias("k"), (a.s + F.when(a.b == b, 2 * a.k + 1).otherwise(F.lit(1).cast("bigint"))).alias("s")), lambda a: a.s)
        return 1 / (1 + F.exp(-(total / SCALE / F.sqrt(squares) + self.bias)))


def labelled(spark: SparkSession) -> DataFrame:
    """url and label (1: block) of the built-in table."""
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in LABELLED])).alias("x")).select("x.*")


def train(rows: DataFrame) -> Model:
    """The regression fitted to ``rows`` of url and label; rows with a null label don't count."""
    known = rows.where(F.col("label").isNotNull()).select(*[c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path"))], F.col("label").cast("double").alias("y"))
    n = known.count()
    if not 0 < n <= MOST_LABELLED:
        raise ValueError(f"{n} labelled rows: 1 to {MOST_LABELLED} are expected")
    ranked = known.groupBy().agg(F.array_sort(F.collect_list(F.struct("host", "path", "y"))).alias("all")).select(F.posexplode("all").alias("r", "x"))
    counts = ranked.select("r", F.explode(features(F.col("x.host"), F.col("x.path"))).alias("b")).groupBy("r", "b").agg(F.count("*").alias("c"))
    length = counts.groupBy("r").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l"))
    # inner products of the labelled rows, over the buckets they share: at most n * n numbers
    has = counts.groupBy("b").agg(F.collect_list(F.struct("r", "c")).alias("has"))
    products = has.select(F.explode("has").alias("one"), "has").select("one.*", F.explode("has").alias("two")).groupBy("r", F.col("two.r").alias("j")).agg(F.sum(F.col("c") * F.col("two.c")).alias("g"))
    own = products.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("j", "g"))).alias("g"))
    table = ranked.join(length, "r").join(own, "r").groupBy().agg(F.array_sort(F.collect_list(F.struct("r", F.col("x.y").alias("y"), "l", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.col("g")[j], F.lit(0))).alias("g")))).alias("v"))
    # + 1: the bias is a feature of every row
    table = table.select("v", F.transform("v", lambda x: F.zip_with(x.g, F.col("v"), lambda g, o: g / (x.l * o.l) + 1)).alias("k"))
    score = lambda a, r: F.aggregate(F.zip_with(F.get("k", r), a, lambda k, x: k * x), F.lit(0.0), lambda s, x: s + x)
    step = lambda a: F.transform(a, lambda x, r: x - RATE * (PENALTY * x + (1 / (1 + F.exp(-score(a, r))) - F.get("v", r).y) / n))
    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array_repeat(F.lit(0.0), n), lambda a, _: step(a))
    fitted = cut(table.select(F.explode(F.zip_with(alpha, F.col("v"), lambda a, v: F.struct(v.r.alias("r"), a.alias("a"), v.l.alias("l")))).alias("f")).select("f.*"))
    weights = [0] * BUCKETS
    for x in counts.join(fitted, "r").groupBy("b").agg(F.round(F.sum(F.col("a") * F.col("c") / F.col("l")) * SCALE).cast("bigint").alias("w")).collect():  # at most ``BUCKETS`` rows
        weights[x.b] = x.w
    return Model(weights, fitted.agg(F.sum("a")).first()[0])


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one tried first is the longest
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(out)
    return out


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the classifier's probability of ``block`` for each row."""
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    by = cut.select("*", rule(F.col("host"), F.col("path"), rules).alias("by"), model.probability(F.col("host"), F.col("path")).alias("p"))
    return by.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce(F.col("by.verdict"), F.when(F.col("p") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.col("p").alias("probability"))


def keep(pages: DataFrame, model: Model, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rows of ``pages`` with verdict ``allow``, with all their columns."""
    host, path = parts(F.col("url"))
    by = F.coalesce(rule(host, path, rules).verdict, F.when(model.probability(host, path) >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return pages.where(by == "allow")
