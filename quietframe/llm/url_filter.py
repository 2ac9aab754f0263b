"""URL filter (operator 5), in DataFrame functions alone: rules by host and path, and for the rest a logistic regression on hashed
character n-grams of host and path.

The regression is trained from a small labelled URL table (at most `most` rows, else it is refused) inside one SQL expression: the
examples become arrays of bucket numbers, and full-batch gradient descent is an ``aggregate`` over the iterations, whose state is the
weight array. The trained weights (one double for each bucket) come to the driver and return as one literal, so that judging pages is a
projection with no shuffle.

The labelled table is made by rule: hosts put together from general words of the trade (gambling, medicine, adult, money, advertising, link
farms) against hosts of ordinary words, of two words, and of made-up syllables, with the same leads, tails and, mostly, paths. No host of a
page that is judged was taken into it.

Defined results. A null url, or one without ``://``, has empty host and path; no rule fits it and the method judges it on its empty
strings. Repeated rows and ties are judged row by row. Of two rules that fit, the longer (host and path together) wins, and of equally
long ones a block. An empty table gives no rows. Other columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query's contract: (host, path prefix, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: General words of hosts that sell, track and spam, and what is put to them.
_TRADE = ["casino", "poker", "slots", "roulette", "lottery", "jackpot", "bets", "betting", "pills", "pharmacy", "viagra", "meds", "adult", "porn", "sex", "xxx", "escort", "dating", "loans", "payday", "cash", "money", "profit", "crypto", "win", "prize", "bonus", "free", "cheap", "discount", "replica", "spam", "scam", "warez", "cracks", "ads", "adserver", "banner", "popup", "clicks", "track", "tracker", "affiliate", "traffic", "farm", "links"]
_ADDED = ["", "online", "now", "4u", "24", "best", "top", "hub", "zone", "deals"]
#: Ordinary words, some of which hold a word of the trade.
_WORDS = ["garden", "museum", "library", "school", "river", "bakery", "history", "physics", "council", "kitchen", "papers", "reading", "stories", "weather", "village", "theatre", "orchard", "printing", "mountain", "harbour", "letters", "music", "choir", "science", "journal", "archive", "cycling", "pottery", "coffee", "birds", "forest", "railway", "bridge", "lantern", "market", "island", "painter", "atlas", "lesson", "almanac", "sailing", "cheese", "meadow", "station", "chapel", "sister", "father", "winter", "window", "freedom", "address", "pillow", "better", "adults-choir", "linkoping", "tracktor", "farmers", "cashmere", "moneta", "badger", "roads", "heads", "reads", "threads", "kids", "bonn"]
_SYLLABLES = ["an", "er", "on", "th", "the", "he", "in", "re", "nd", "ha", "ing", "ed", "es", "ti", "tion", "en", "or", "at", "st", "ou", "ly", "ble", "sh", "wh", "ea", "nt", "a", "is", "it", "la", "de", "ka", "mo", "ne", "ro", "su", "vi", "po", "gu", "bel", "mar", "sen", "tor", "lin", "ber", "dal", "fen", "ric", "wal", "hol"]
_LEADS, _TAILS = ["", "www.", "m.", "blog.", "shop."], ["example.com", "example.net", "example.org", "test"]
_TRADE_PATHS = ["/click", "/track/pixel.gif", "/ads/banner", "/win-free-money", "/promo/bonus"]
_PATHS = ["/en/1024", "/about.html", "/de/88", "/2021/05/notes", "/en/825/", "/fr/471/", "/es/9034.html", "/en/64.html", "/"]


def _made_up(n: int, seed: int = 5) -> list[str]:
    """Names of two to four syllables without a word of the trade."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        name = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(2, 5)))
        if 4 <= len(name) <= 14 and not any(w in name for w in _TRADE):
            out.append(name)
    return out


def labelled_names() -> tuple[list[str], list[str]]:
    """Names of hosts to block (each word of the trade with others and with additions), and of hosts to allow."""
    n, m = len(_TRADE), len(_WORDS)
    bad = []
    for i, word in enumerate(_TRADE):
        bad += [f"{word}{['-', '', '-'][(i + j) % 3]}{_TRADE[(i + j) % n]}" for j in (3, 5, 7, 9)]
        for j in range(4):
            more = _ADDED[(i + 3 * j) % len(_ADDED)]
            bad.append(f"{word}-{more}" if more and (i + j) % 2 else word + more)
    good = [x for i, word in enumerate(_WORDS) for x in (word, f"{word}-{_WORDS[(i + 11) % m]}", f"{_WORDS[(i + 23) % m]}-{word}")]
    return bad, good + _made_up(300)


def labelled_urls(without: str = "") -> list[tuple[str, float]]:
    """(url, 1.0 to block): every name once, with leads, tails and paths in turn. Names that match the pattern `without` are held out."""
    rows = []
    for names, label in zip(labelled_names(), (1.0, 0.0), strict=True):
        for k, name in enumerate(names):
            path = _TRADE_PATHS[k // 6 % len(_TRADE_PATHS)] if label and k % 6 == 0 else _PATHS[5 * k % len(_PATHS)]
            if not without or not re.search(without, name):
                rows.append((f"https://{_LEADS[k % len(_LEADS)]}{name}.{_TAILS[k // 2 % len(_TAILS)]}{path}", label))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, buckets: int, sizes: tuple[int, ...] = (2, 4, 6)) -> Column:
    """Bucket numbers of the character n-grams of host and of path, each between marks that keep the two apart. The hash is the
    first 32 bits of MD5. Work and memory are linear in the url: the characters become an array first."""
    out = []
    for mark, part in (("h", host), ("p", path)):
        for n in sizes:
            out.append(_grams(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), mark, n))
    return F.transform(F.array_distinct(F.flatten(F.array(*out))), lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % buckets).cast("int"))


def _grams(chars: Column, mark: str, n: int) -> Column:
    def at(c: Column) -> Column:
        places = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.lit(mark), *[F.element_at(c, i + k) for k in range(n)]))

    return F.element_at(F.transform(F.array(chars), at), 1)  # so that the characters are made once, not once for each n-gram


def train(spark: SparkSession, examples: DataFrame, buckets: int = 8192, steps: int = 60, rate: float = 50.0, bias_rate: float = 2.0, decay: float = 1e-4, most: int = 10_000) -> list[float]:
    """Weights, one for each bucket and the bias last. examples: url, label; at most `most` rows, as they become one row.

    Full-batch gradient descent as one aggregate over the steps. Each step computes the error of every example from the weights of
    its buckets, then moves each bucket's weight by the errors of the examples that hold it.
    """
    if examples.limit(most + 1).count() > most:
        raise ValueError(f"the labelled table has over {most} rows")
    host, path = host_and_path(F.col("url"))
    rows = examples.select(grams(host, path, buckets).alias("g"), F.col("label").cast("double").alias("y"), "url")
    rows = rows.withColumn("scale", 1 / F.sqrt(F.greatest(F.size("g"), F.lit(1)).cast("double")))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("url", "g", "y", "scale"))).alias("e"))
    one = one.select(F.expr("e.g").alias("g"), F.expr("e.y").alias("y"), F.expr("e.scale").alias("scale"))
    # For each bucket the examples that hold it, as often as they do.
    pairs = one.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(x, b -> struct(b AS b, i AS i))))")).alias("p"))
    pairs = pairs.select("p.b", "p.i").unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(None).cast("int").alias("i")))
    held = pairs.groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("l")).agg(F.expr("sort_array(collect_list(struct(b, l))).l").alias("held"))
    both = one.unionByName(held, allowMissingColumns=True).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("g", "y", "scale", "held")])
    step = f"""
        aggregate(sequence(1, {steps}),
          transform(sequence(0, {buckets}), b -> 0D),
          (w, t) -> transform(
            array(zip_with(zip_with(g, scale, (x, s) -> element_at(w, {buckets + 1}) + s * aggregate(x, 0D, (z, b) -> z + element_at(w, b + 1))),
                           y, (z, l) -> l - 1D / (1D + exp(-z)))),
            err -> concat(
              transform(held, (l, b) -> element_at(w, b + 1) * (1D - {rate} * {decay}) + {rate} / size(y) * aggregate(l, 0D, (s, i) -> s + element_at(err, i + 1) * element_at(scale, i + 1))),
              array(element_at(w, {buckets + 1}) + {bias_rate} / size(y) * aggregate(err, 0D, (s, x) -> s + x))))[0])"""
    return both.select(F.expr(step).alias("w")).first()["w"]


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The regression's log odds that a url is to be blocked."""
    buckets = len(weights) - 1
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")

    def of(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda z, b: z + F.element_at(w, b + 1))
        return F.element_at(w, buckets + 1) + total / F.sqrt(F.greatest(F.size(g), F.lit(1)).cast("double"))

    return F.element_at(F.transform(F.array(grams(host, path, buckets)), of), 1)


def judge(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, score (null where a rule decides) and verdict; a projection."""
    host, path = host_and_path(F.col("url"))
    own = {"page_id", "url"}
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path")) if own <= set(pages.columns) else pages
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        hit = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        fits, verdict = F.when(hit, h + p).otherwise(fits), F.when(hit, v).otherwise(verdict)
    out = out.withColumn("rule", fits).withColumn("rule_verdict", verdict)
    out = out.withColumn("score", F.when(F.col("rule_verdict").isNull(), score(F.col("host"), F.col("path"), weights)))
    return out.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))).drop("rule_verdict")
