"""URL filters: allow and block rules by host and path, and for the rest a logistic regression on hashed character n-grams.

Host and path are cut from the url by built-in functions. A rule (host, path, verdict) fits its host and
all subdomains if the url's path starts with the rule's; of those that fit the one with the longest text (host and path together) wins, among equally long ones
that with the longer host. Where no rule fits, the model judges: character n-grams of ".host." and "path$" are hashed as polynomials of their code points into BUCKETS
places, a url's features are the shares of its n-grams, and whole-numbered weights make the verdict exact on any machine.
It is trained in the driver on a small labelled table of urls, of at most MOST_LABELLED rows. Urls are judged batch by batch
without a shuffle; rules (at most MOST_RULES) and weights are all that is broadcast.

Defined results: a null url, and one without "://", has an empty host and path and no rule that needs a host; with no n-gram at all the model's
constant decides; a host keeps its port and user name; empty labels in a host ("a..b") are labels like others; repeated rows repeat; empty tables give
no rows; of `keep` columns none may have the name of a result (an error); a labelled table without both verdicts allows everything.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

BUCKETS, P, GRAMS = 16381, 131, (3, 4)
MOST_LABELLED, MOST_RULES = 1000, 1_000_000
#: Weights are kept as whole numbers of 1 / SCALE.
SCALE = 1000
#: Fixed values of the query: its rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A small table of labelled urls, the default for training.
ALLOWED = """https://www.example.com/articles/history-of-bridges.html https://blog.example.net/en/20418 http://docs.example.org/guide/install https://news.example.com/world/2021/05/elections
https://en.wiki.example.org/wiki/Photosynthesis https://library.example.edu/catalog/item/4711 http://www.museum.example.org/collections/prints/ https://example.net/fr/1187.html
https://research.example.edu/papers/graph-theory.pdf https://forum.example.com/questions/3021/how-to-bake-bread http://m.example.org/de/30771 https://journal.example.com/science/article/5521
https://handbook.example.net/chapter-3/sorting http://weather.example.com/en/9921?page=2 https://www.example.edu/courses/biology/lecture-notes https://blog.example.com/travel/norway-in-winter
https://recipes.example.net/soups/tomato-soup https://museum.example.com/es/41802/ http://archive.example.org/letters/1850/ https://planet.example.com/en/73311.html
https://reference.example.org/grammar/verbs https://www.council.example.org/reports/annual-2019 https://garden.example.net/de/2207 http://school.example.edu/timetable/history
https://magazine.example.com/interview-with-a-composer https://stories.example.org/en/55120#top https://maps.example.net/rivers/danube https://www.example.org/fr/8841/
https://encyclopedia.example.com/entry/telescope https://books.example.net/reviews/the-long-road""".split()
BLOCKED = """http://casino-bonus.example.com/play/free-spins https://cheap-pills.example.net/buy/online-pharmacy http://xxx-cams.example.com/live/sex https://www.example.com/login?next=account
https://ads.example.net/click/track/banner http://best-poker.example.org/bonus/slots https://shop.example.com/cart/checkout https://example.net/wp-login.php
http://free-loans.example.com/apply/payday-cash https://adult-dating.example.net/porn/videos http://tracker.example.com/pixel/beacon.gif https://www.example.org/tag/cheap-replica-watches
http://win-prize.example.net/claim/free-iphone https://torrent.example.com/download/crack-keygen http://casino.example.net/jackpot/slots-online https://viagra-pharmacy.example.com/order/cheap-pills
https://example.com/signup/register/account http://banner-ads.example.org/adserver/click.php https://hot-singles.example.com/sex-chat/live http://betting.example.net/odds/sports-bonus
https://cdn.example.com/track/analytics/beacon http://replica-bags.example.com/buy/cheap-luxury https://xxx.example.org/porn/free-videos http://crypto-profit.example.net/claim/bonus-coins
https://www.example.net/cart/add-to-cart?id=5 http://keygen.example.com/crack/serial-download https://poker.example.com/free-bonus/spins http://clickbait-prize.example.org/win/free-cash
https://www.example.com/account/password/login http://payday-loans.example.org/apply/fast-cash""".split()
LABELLED = [(u, "allow") for u in ALLOWED] + [(u, "block") for u in BLOCKED]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what comes after the first :// up to one of / ? # or the end, with A-Z in lower case; the path goes on from there up to ? or #."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def split_url(url: str | None) -> tuple[str, str]:
    """parts() of one labelled url, for training."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    end = min([i for c in "?#" if (i := rest.find(c, cut)) >= 0], default=len(rest))
    return rest[:cut].translate(str.maketrans(_UPPER, _LOWER)), rest[cut:end]


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each n-gram's hash."""
    rows, found = [], []
    for part, texts in enumerate(([f".{h}." for h in hosts], [f"{p}$" for p in paths])):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        owner, end = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
        for n in GRAMS:
            ok = np.flatnonzero(np.arange(len(points)) + n <= end)
            value = np.full(len(ok), 2 * n + part, np.int64)
            for j in range(n):
                value = value * P + points[ok + j]
            rows.append(owner[ok])
            found.append(value % BUCKETS)
    return np.concatenate(rows), np.concatenate(found)


class Model:
    """Whole-numbered weights of the buckets, and the constant: a url is blocked if constant * n + the sum of its n n-grams' weights is above 0."""

    def __init__(self, weights: np.ndarray, constant: int):
        self.weights, self.constant = weights, constant

    def points(self, hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum, n): the sum of weights with the constants, and the number of n-grams (the constant alone and 1 if there is none)."""
        row, place = grams(hosts, paths)
        n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        total = np.zeros(len(hosts), np.int64)
        np.add.at(total, row, self.weights[place])
        return total + self.constant * n, n


def fit(labelled: list[tuple[str | None, str]], rounds: int = 600, ridge: float = 1e-4) -> Model:
    """Logistic regression by accelerated gradient steps on the shares of n-grams; verdicts are allow and block."""
    y = np.array([v == "block" for _, v in labelled], float)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(BUCKETS, np.int64), -SCALE)
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    row, place = grams(list(hosts), list(paths))
    used, at = np.unique(place, return_inverse=True)
    x = np.zeros((len(y), len(used) + 1))
    np.add.at(x, (row, at), 1.0)
    x[:, :-1] *= 8 / np.maximum(x.sum(1, keepdims=True), 1)
    x[:, -1] = 1
    w, before, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4 * len(y) / np.linalg.norm(x, 2) ** 2
    for k in range(rounds):
        ahead = w + (w - before) * k / (k + 3)
        p = 1 / (1 + np.exp(-x @ ahead))
        slope = x.T @ (p - y) / len(y) + ridge * np.append(ahead[:-1], 0)
        before, w = w, ahead - step * slope
    weights = np.zeros(BUCKETS, np.int64)
    weights[used] = np.rint(8 * w[:-1] * SCALE).astype(np.int64)
    return Model(weights, int(np.rint(w[-1] * SCALE)))


def train(labelled: DataFrame) -> Model:
    """A model from a small table (url, verdict); an error if it has over MOST_LABELLED rows. Rows of other verdicts are left out."""
    rows = labelled.where("verdict in ('allow', 'block')").select("url", "verdict").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    return fit(sorted(((r.url, r.verdict) for r in rows), key=lambda r: (r[0] or "", r[1])))


@functools.cache
def default_model() -> Model:
    return fit(LABELLED)


class Rules:
    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.of: dict[str, list[tuple[str, str, str]]] = {}
        for host, path, verdict in rules:
            self.of.setdefault(host, []).append((path, host + path, verdict))

    def candidates(self, host: str) -> list[tuple[str, str, str]]:
        """(path, text, verdict) of the rules for a host and those above it, the longest first."""
        found, at = list(self.of.get(host, ())), host.find(".")
        while at >= 0:
            found += self.of.get(host[at + 1 :], ())
            at = host.find(".", at + 1)
        return sorted(found, key=lambda r: (-len(r[1]), len(r[0]), r[2]))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], model: Model, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule (its host and path, null if none fits), verdict (allow or block), score (0 to 1, the model's share for block)."""
    out = ("host", "path", "rule", "verdict", "score")
    if clash := set(keep) & set(out):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    host, path = parts(F.col(url_col))
    rows = urls.select(*keep, host.alias("host"), path.alias("path"))
    shared = urls.sparkSession.sparkContext.broadcast((Rules(rules), model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            by_host = {h: known.candidates(h) for h in set(hosts)}
            won = [next((r for r in by_host[h] if p.startswith(r[0])), None) for h, p in zip(hosts, paths, strict=True)]
            total, n = of.points(hosts, paths)
            verdict = [r[2] if r else "block" if t > 0 else "allow" for r, t in zip(won, total.tolist(), strict=True)]
            score = 1 / (1 + np.exp(-np.clip(total / n / SCALE, -30, 30)))
            more = [pa.array([r and r[1] for r in won], pa.string()), pa.array(verdict, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *out[2:]])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, rule string, verdict string, score double"
    return arrow_map(rows, run, schema)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, default_model()).drop("score")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def op11_sql() -> str:
    """The same in DuckDB's SQL: the longest rule, else the sum of the trained weights over n-grams."""
    model, ordered = default_model(), sorted(RULES, key=lambda r: (-len(r[0] + r[1]), len(r[1])))
    pick = lambda k: " ".join(f"WHEN {_fits(h, p)} THEN '{(h + p, v)[k]}'" for h, p, v in ordered)
    value = lambda n, part: "+".join([f"{(2 * n + part) * P**n}", *(f"CAST(unicode(substr(t{part}, i + {j}, 1)) AS BIGINT) * {P ** (n - 1 - j)}" for j in range(n))])
    each = " UNION ALL ".join(f"SELECT k, ({value(n, part)}) % {BUCKETS} AS b FROM (SELECT k, t{part}, unnest(range(1, length(t{part}) - {n - 2})) AS i FROM d)" for part in (0, 1) for n in GRAMS)
    return f"""WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
d AS (SELECT row_number() OVER () AS k, host, path, '.' || host || '.' AS t0, path || '$' AS t1 FROM (SELECT DISTINCT host, path FROM u)),
w AS (SELECT [{", ".join(map(str, model.weights.tolist()))}] AS w),
g AS (SELECT k, count(*) AS n, sum(w[b + 1]) AS total FROM ({each}), w GROUP BY k),
m AS (SELECT host, path, coalesce(total, 0) + {model.constant} * coalesce(n, 1) > 0 AS bad FROM d LEFT JOIN g USING (k))
SELECT page_id, host, path, CASE {pick(0)} END AS rule, CASE {pick(1)} WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM u JOIN m USING (host, path)"""
