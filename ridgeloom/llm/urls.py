"""URL filters: rules on host and path first, then logistic regression on hashed character n-grams.

Everything that touches a page is a built-in expression on one row: no shuffle, no Python on the executors.
The model is fitted on the driver to a small labelled URL table given as a parameter (a constant here) and
enters the plan as a literal array of weights of fixed length.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host, path, verdict); a rule fits its host and all its subdomains below that path.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: The labelled table: 1 is a URL to block.
LABELLED = tuple((u, 1) for u in (
    "http://casino-win.example.com/en/12", "https://www.casino-win.example.net/fr/801.html", "https://m.casino-win.example.org/de/4033",
    "http://free-bets.example.com/en/5462", "https://blog.free-bets.example.net/es/883", "https://free-bets.example.org/fr/27/",
    "http://cheap-pills.example.com/de/6652", "https://www.cheap-pills.example.net/en/131", "https://m.cheap-pills.example.org/es/90",
    "http://spam-farm.example.com/fr/907", "https://www.spam-farm.example.net/en/8601", "https://blog.spam-farm.example.org/de/59",
    "http://ads-track.example.com/en/43", "https://m.ads-track.example.net/fr/7719", "https://ads-track.example.org/es/3.html",
    "http://adult-x.example.com/en/66", "https://www.adult-x.example.net/de/1200", "https://blog.adult-x.example.org/fr/515",
    "http://casino-bonus.example.com/en/4", "https://win-big.example.net/fr/71", "https://online-casino.example.org/de/9",
    "http://best-bets.example.com/es/15", "https://cheap-meds.example.net/en/66", "https://pills-online.example.org/fr/2",
    "http://link-farm.example.com/de/31", "https://track-ads.example.net/en/8", "https://xxx-adult.example.org/es/77",
)) + tuple((u, 0) for u in (
    "http://tionsh.example.com/en/7623", "https://blog.tionsh.example.net/fr/3528", "https://tionble.example.org/en/7391",
    "https://m.tiontion.example.net/es/1662", "https://www.ththth.example.com/en/207", "http://ththon.example.org/de/1583",
    "https://thther.example.net/en/486", "https://ththou.example.com/es/2508", "http://www.ththre.example.net/en/9585.html",
    "https://m.therer.example.org/en/8574", "http://therou.example.com/es/667", "https://www.theron.example.org/fr/883/",
    "http://thered.example.net/en/9264", "https://ththin.example.org/de/1832", "https://blog.theror.example.com/fr/7960.html",
    "http://news.example.com/en/12", "https://www.city-library.example.org/de/44", "https://garden.example.net/fr/18",
    "http://open-maps.example.org/en/300", "https://recipes.example.com/es/52", "https://m.weather.example.net/en/9",
    "http://blog.train-times.example.org/de/7", "https://science.example.com/en/8888", "https://museum.example.net/fr/61/",
    "http://school.example.org/es/204", "https://www.history-notes.example.com/de/95", "https://music.example.net/en/33",
    "http://www.ththat.example.com/fr/6977", "https://ththly.example.org/en/9482", "https://m.theran.example.net/es/17",
))

SIZES, BUCKETS, ROUNDS, RATE, DECAY = (3, 4), 4096, 300, 2.0, 1e-4


def _grams(text: str) -> list[str]:
    return [text[i : i + n] for n in SIZES for i in range(len(text) - n + 1)]


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[cut:]
    return rest[:cut].lower(), path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


@lru_cache(maxsize=4)
def fit(labelled: tuple[tuple[str, int], ...] = LABELLED) -> tuple[float, ...]:
    """Weights by hash bucket, the intercept last: gradient descent on the mean logistic loss with weight decay.

    A URL's features are the shares of its n-grams that fall into each bucket, times ten.
    """
    rows = []
    for url, y in labelled:
        grams = _grams("".join(_parts(url)))
        x: dict[int, float] = {}
        for g in grams:
            x[_bucket(g)] = x.get(_bucket(g), 0.0) + 10.0 / len(grams)
        rows.append((x, y))
    w = [0.0] * (BUCKETS + 1)
    for _ in range(ROUNDS):
        step: dict[int, float] = {}
        for x, y in rows:
            z = w[BUCKETS] + sum(w[k] * v for k, v in x.items())
            miss = (1 / (1 + math.exp(-z)) - y) / len(rows)
            for k, v in x.items():
                step[k] = step.get(k, 0.0) + miss * v
            step[BUCKETS] = step.get(BUCKETS, 0.0) + miss
        for k, g in step.items():
            w[k] -= RATE * (g + DECAY * w[k])
    return tuple(round(v, 6) for v in w)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    h, p, _ = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def _char_grams(text: Column, n: int) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))


def blocked_odds(text: Column, weights: tuple[float, ...]) -> Column:
    """The model's log-odds of a block for host and path joined."""
    table = F.array(*[F.lit(w) for w in weights[:-1]])
    grams = F.concat(*[_char_grams(text, n) for n in SIZES])
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.element_at(table, (F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int") + 1)))
    return F.lit(weights[-1]) + F.when(F.size(grams) > 0, total * 10.0 / F.size(grams)).otherwise(0.0)


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule and verdict of every row.

    The longest fitting rule decides; where none fits, the model blocks at odds above one. A null or shapeless
    URL has empty host and path and so gets the intercept's verdict. Repeated rows are judged alike, an empty
    table gives an empty one, and columns other than the id and the URL are not read.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("_host"), path.alias("_path"))
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest):
        fits = rule_fits(F.col("_host"), F.col("_path"), r)
        rule, said = F.when(fits, r[0] + r[1]).otherwise(rule), F.when(fits, r[2]).otherwise(said)
    odds = blocked_odds(F.concat("_host", "_path"), fit(labelled))
    return parts.select(
        F.col(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"),
        F.when(said.isNotNull(), said).when(odds > 0, "block").otherwise("allow").alias("verdict"),
    )


def oracle() -> str:
    w = fit()
    table = "[" + ", ".join(f"{v!r}::DOUBLE" for v in w[:-1]) + "]"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    return f"""
WITH w AS (SELECT {table} AS w),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
g AS (SELECT *, list_concat(list_transform(range(1, length(host || path) - 1), lambda i: substr(host || path, i, 3)),
                           list_transform(range(1, length(host || path) - 2), lambda i: substr(host || path, i, 4))) AS grams FROM b),
s AS (SELECT page_id, host, path, {w[-1]!r} + CASE WHEN len(grams) > 0 THEN
        10.0 * list_sum(list_transform(grams, lambda x: w[('0x' || substr(md5(x), 1, 3))::INT + 1])) / len(grams) ELSE 0 END AS odds FROM g, w)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} WHEN odds > 0 THEN 'block' ELSE 'allow' END AS verdict FROM s
"""
