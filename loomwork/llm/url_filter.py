"""URL filters: rules by host and path, then gradient-boosted trees on lexical features.

Features of a URL are built-in expressions: its length, host and path length, depth, the digit shares of the whole and of its
host, the character entropies of both, number of parameters, and, as suffix statistic, the smoothed share of blocked URLs
among labelled ones with that last host label. Trees are fitted on labelled URLs (logistic loss, exact splits, Newton leaves)
on the driver, from about ``TRAIN_ROWS`` rows at most, chosen by hash, and run as nested SQL conditionals, so that judging is
one narrow projection.

Without labelled URLs of one's own, ``labelled_urls`` makes a deterministic set from a seed: ordinary pages (front pages, dated
articles, manuals, shops, searches, forums) and link spam (redirect chains, random hosts, doorway pages, numbered hosts), with
hyphens, digits, parameters, depth and every suffix on both sides, so that no one feature decides.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; path: then up to ``?``, ``#`` or the
end. A rule (host and path, like ``example.net/en/``) fits its host and all subdomains if the path starts with the rule's; the
longest fitting rule wins, of equally long ones the first in code point order.

Defined results: null and URLs without ``://`` have an empty host and path, no rule, and the method's verdict on what text
there is; very long URLs are judged whole; repeated rows are judged one by one; a score of exactly ``CUT`` blocks; an empty table
gives no rows; input columns named like an added column are replaced, others are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the production query: text and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Labelled rows that trees are fitted on at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, LEAST_LEAF = 40, 4, 0.2, 20
#: A URL is blocked from this probability on.
CUT = 0.5
#: Labelled URLs a suffix needs as much as the prior's weight.
PRIOR = 20
#: Suffixes that get a statistic of their own; the others share the prior.
MOST_SUFFIXES = 100
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_host_digits", "f_entropy", "f_host_entropy", "f_params", "f_suffix"]


def host_of(url: str | Column) -> Column:
    raw = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: dict[str, str], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The winning rule's text and verdict; null where none fits."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, slash, rest = rule.partition("/")
        own = own.lower()
        fits = (F.col(host) == own) | F.col(host).endswith("." + own)
        if slash:
            fits = fits & F.col(path).startswith("/" + rest)
        text = F.when(fits, rule) if text is None else text.when(fits, rule)
        verdict = F.when(fits, rules[rule]) if verdict is None else verdict.when(fits, rules[rule])
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def with_features(df: DataFrame, suffixes: dict[str, float], prior: float, url: str = "url") -> DataFrame:
    """df, which has host and path, with FEATURES."""
    text = F.coalesce(F.col(url), F.lit(""))

    def digits(x: Column) -> Column:
        return F.when(F.length(x) > 0, (F.length(x) - F.length(F.translate(x, "0123456789", ""))) / F.length(x)).otherwise(0.0)

    def entropy(x: Column) -> Column:
        # Over the sorted characters a run's length is its character's count.
        chars = F.array_sort(F.filter(F.split(x, ""), lambda c: c != ""))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("last"), F.lit(0).alias("run"))
        part = lambda n: n * F.log2(n.cast("double"))
        step = lambda a, c: F.when(a["last"] == c, F.struct(a["sum"].alias("sum"), c.alias("last"), (a["run"] + 1).alias("run"))).otherwise(
            F.struct((a["sum"] + F.when(a["run"] > 0, part(a["run"])).otherwise(0.0)).alias("sum"), c.alias("last"), F.lit(1).alias("run"))
        )
        total = F.aggregate(chars, start, step, lambda a: a["sum"] + F.when(a["run"] > 0, part(a["run"])).otherwise(0.0))
        return F.when(F.length(x) > 0, F.log2(F.length(x).cast("double")) - total / F.length(x)).otherwise(0.0)

    suffix = F.element_at(F.split("host", r"\."), -1)
    stat = F.lit(prior)
    for name, share in sorted(suffixes.items()):
        stat = F.when(suffix == name, share).otherwise(stat)
    # Parameters stand behind the first question mark, before a fragment.
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    made = {
        "f_length": F.length(text), "f_host": F.length("host"), "f_path": F.length("path"), "f_depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
        "f_digits": digits(text), "f_host_digits": digits(F.col("host")), "f_entropy": entropy(text), "f_host_entropy": entropy(F.col("host")),
        "f_params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")), "f_suffix": stat,
    }
    keep = [c for c in df.columns if c not in made]
    # Through the generator each feature is worked out once, however many trees test it.
    return df.select(*keep, F.inline_outer(F.array(F.struct(*(made[f].cast("double").alias(f) for f in FEATURES)))))


@dataclass
class Node:
    """A leaf has no feature."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def sql(self) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"IF({FEATURES[self.feature]} <= {self.threshold!r}D, {self.left.sql()}, {self.right.sql()})"

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.predict(x), self.right.predict(x))


@dataclass
class UrlModel:
    """Boosted trees over FEATURES, with the suffix statistic that they were fitted with."""

    start: float
    trees: list[Node]
    suffixes: dict[str, float]
    prior: float

    def score(self) -> Column:
        """The probability of block."""
        margin = F.lit(self.start)
        for tree in self.trees:
            margin = margin + F.expr(tree.sql())
        return 1 / (1 + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(t.predict(x) for t in self.trees))))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Node:
    leaf = Node(float(-RATE * g[rows].sum() / (h[rows].sum() + 1.0)))
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return leaf
    gs, hs = g[rows].sum(), h[rows].sum()
    best, where = 1e-6, None
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v = x[order, f]
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= LEAST_LEAF) & (len(rows) - cut - 1 >= LEAST_LEAF)]
        if not len(cut):
            continue
        gl, hl = np.cumsum(g[order])[cut], np.cumsum(h[order])[cut]
        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, where = float(gain[k]), (f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if where is None:
        return leaf
    goes = x[rows, where[0]] <= where[1]
    return Node(leaf.value, *where, _grow(x, g, h, rows[goes], depth - 1), _grow(x, g, h, rows[~goes], depth - 1))


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked") -> UrlModel:
    """Trees from labelled rows (label 1: block, 0: allow); of more than about TRAIN_ROWS rows those with small hashes."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    rows = rows.where(F.xxhash64("url") <= F.lit(common.least_hash(TRAIN_ROWS / max(rows.count(), 1))))
    suffix = F.element_at(F.split("host", r"\."), -1)
    stats = rows.groupBy(suffix.alias("s")).agg(F.sum("y").alias("bad"), F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(MOST_SUFFIXES).collect()
    n, bad = sum(r["n"] for r in stats), sum(r["bad"] for r in stats)
    prior = bad / n if n else 0.0
    suffixes = {r["s"]: (r["bad"] + PRIOR * prior) / (r["n"] + PRIOR) for r in stats}
    frame = with_features(rows, suffixes, prior).select(*FEATURES, "y", "url").toPandas().sort_values(["url", "y"])
    x, y = frame[FEATURES].to_numpy(float), frame["y"].to_numpy(float)
    start = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    trees: list[Node] = []
    if len(y) and 0 < y.mean() < 1:
        margin = np.full(len(y), start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(x, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
            trees.append(tree)
            margin += tree.predict(x)
    return UrlModel(start, trees, suffixes, prior)


def labelled_urls(spark: SparkSession, n: int = 8000, seed: int = 11) -> DataFrame:
    """n URLs with blocked: even rows are ordinary, odd ones are link spam."""
    rng = np.random.default_rng(seed)
    number = lambda least, most: int(rng.integers(least, most + 1))
    pick = lambda *of: of[number(0, len(of) - 1)]
    letters = lambda of, k: "".join(of[number(0, len(of) - 1)] for _ in range(k))
    # Words alternate consonants and vowels, unlike random strings.
    word = lambda least=1, most=4: "".join(letters("bcdfghjklmnprstvw", 1) + letters("aeiou", 1) + letters("nrst", number(0, 1)) for _ in range(number(least, most)))
    slug = lambda least, most: "-".join(word(1, 3) for _ in range(number(least, most)))
    token = lambda least, most: letters("abcdefghijklmnopqrstuvwxyz0123456789" if rng.random() < 0.6 else "abcdef0123456789", number(least, most))
    values = lambda least, most, value: "&".join(f"{pick(word(1, 2), letters('abcdefgxyz', 1))}={value()}" for _ in range(number(least, most)))

    def ordinary() -> str:
        host = pick("", "", "www.", "www.", "blog.", "news.", word(1, 2) + ".") + pick(word(2, 4), word(2, 4), slug(2, 2), slug(2, 3), word(1, 2) + str(number(1, 99)))
        if rng.random() < 0.25:
            host += ".example"
        kind = number(0, 7)
        path = [
            "", "/", f"/{number(1998, 2026)}/{number(1, 12):02}/{number(1, 28):02}/{slug(3, 8)}", "/" + "/".join(word(1, 3) for _ in range(number(1, 6))) + pick("", "/", ".html"),
            f"/{word(1, 2)}/{number(1, 3000000)}", f"/{word(1, 2)}/{slug(2, 7)}{pick('', '-' + str(number(1, 99999)), '.html')}", f"/search?q={'+'.join(word(1, 3) for _ in range(number(1, 4)))}" + pick("", f"&page={number(1, 40)}", f"&lang={pick('en', 'de', 'fr')}&sort={word(1, 2)}&page={number(1, 9)}"),
            f"/{word(1, 2)}?id={number(1, 99999)}{pick('', '&ref=' + word(1, 2), '&utm_source=' + word(1, 2) + '&utm_medium=' + word(1, 2))}",
        ][kind]
        suffix = rng.choice(["com", "org", "net", "edu", "de", "fr", "uk", "io", "info", "ru", "xyz", "top"], p=[0.38, 0.2, 0.1, 0.05, 0.07, 0.06, 0.04, 0.04, 0.02, 0.02, 0.01, 0.01])
        return f"{host}.{suffix}{path}{pick('', '', '', '#' + word(1, 2))}"

    def spam() -> str:
        kind = number(0, 3)
        host = [pick(word(2, 4), "www." + word(2, 3), slug(2, 2)), token(8, 24), slug(3, 6) + pick("", str(number(1, 9999))), word(1, 3) + str(number(10, 99999))][kind]
        path = [
            f"/{pick(word(1, 1), token(2, 6))}?" + values(4, 12, lambda: token(6, 24)), "/" + "/".join(token(4, 20) for _ in range(number(1, 4))) + pick("", "?" + values(1, 5, lambda: token(4, 16))),
            "/" + slug(4, 10) + pick("", f"/{slug(3, 6)}.html", f"-{number(100, 9999999)}.html", "?" + values(2, 5, lambda: word(1, 2))), "/" + "/".join(letters("abcxyz", 1) if rng.random() < 0.5 else word(1, 2) for _ in range(number(0, 3))) + pick("", "?" + values(1, 6, lambda: str(number(1, 99999)))),
        ][kind]
        suffix = rng.choice(["com", "net", "org", "info", "top", "xyz", "club", "ru", "de", "io"], p=[0.24, 0.08, 0.04, 0.14, 0.17, 0.14, 0.08, 0.06, 0.03, 0.02])
        return f"{host}.{suffix}{path}"

    return spark.createDataFrame([(f"http{'s' if rng.random() < 0.6 else ''}://{spam() if i % 2 else ordinary()}", i % 2) for i in range(n)], "url string, blocked int")


def judge(pages: DataFrame, model: UrlModel, rules: dict[str, str] | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score (the method's probability of block) and verdict."""
    inner, back = common.inner_names(pages.drop("host", "path", "rule", "score", "verdict"), url)
    split = inner.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    scored = with_features(split, model.suffixes, model.prior, url).withColumn("score", model.score())
    rule, verdict = rule_of(RULES if rules is None else rules)
    named = scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= CUT, "block").otherwise("allow")))
    return named.select(*back, "host", "path", "rule", "verdict", "score")


def query(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_urls(spark))).drop("url")
