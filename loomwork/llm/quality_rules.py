r"""Quality rules: ordered threshold conjunctions learned by sequential covering and run as one Spark conditional.

``text_statistics`` adds the counts that rules read; ``learn`` grows rules on labelled statistics (each rule adds the
threshold of the best information gain until it covers no good row of the growing part, then drops final conditions
while that improves it on the pruning part, and is kept if it is precise there); ``DecisionList.verdict`` is a
``CASE WHEN rule THEN 'drop' ... ELSE 'keep'`` column. Statistics are built-in expressions over the whole text; only the
learning, on at most ``train_rows`` labelled rows (in expectation, chosen by hash), happens on the driver. Which rows grow and
which prune is decided by hash too, so that the list depends on the rows, not on their order or files.

Words are runs of ``[^\x20\x09-\x0D]``. Defined results: null text has no words, hence ``n_words`` 0 and base_failed;
repeated or tied rows are judged one by one; without labels of both kinds the list is empty and keeps what passes the base
rules; very long texts are counted whole; an empty table gives no rows; input columns named like a statistic are replaced
(clean_documents keeps all), others are kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in a window that counts as repeated text.
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Expected number of labelled rows that learn() reads at most.
TRAIN_ROWS = 6000
#: What rules may test: shares of the counts, 0 where there are no words.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper (A to Z), all long."""
    made = [*BASE, "n_upper"]
    inner, back = common.inner_names(docs.drop(*made))
    keep, whole = inner.columns, F.coalesce(F.col(inner.columns[docs.drop(*made).columns.index(text)]), F.lit(""))
    bare = F.btrim(whole, F.lit(common.SPACE_CHARS))
    words = F.when(F.length(bare) > 0, F.split(bare, f"{common.SPACE}+")).otherwise(F.array().cast("array<string>"))
    count = lambda pattern: (F.size(F.split(whole, pattern)) - 1).cast("long")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(common.SPACE_CHARS))) > 0)
    one = inner.select(*keep, words.alias("_w"), lines.alias("_l"), count(r"[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_upper"))
    two = one.select(
        *keep, "n_symbols", "n_upper", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # Windows of 2, 4 and 8 words, each from two halves: _h[i] is then the hash of words i to i + 7.
    span = 1
    while span < WINDOW:
        shifted = F.slice("_h", F.lit(span + 1), F.greatest(F.size("_h"), F.lit(1)))
        two = two.withColumn("_h", F.zip_with("_h", shifted, lambda a, b: F.xxhash64(a, b)))
        span *= 2
    windows = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0)))
    three = two.withColumn("_h", windows)
    # Only texts in which some window is found twice go on; the others have an empty array here.
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    numbered = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.withColumn("_s", F.when(twice, numbered)).drop("_h")
    same = lambda x, k: F.get("_s", k)["h"] == x["h"]
    found = F.filter("_s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    at = F.array_sort(F.transform(found, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    repeated = F.when(F.col("_s").isNull(), F.lit(0).cast("long")).otherwise(covered)
    # Through the generator no filter on a statistic is pushed down, which would work it out anew for each use.
    out = four.select(*keep, F.inline_outer(F.array(F.struct(*(repeated.alias(c) if c == "n_repeat_words" else F.col(c) for c in made)))))
    return out.select(*back, *made)


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.expr(FEATURES[self.feature])
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold drops the row, and what none fits stays."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """'drop' or 'keep', over the columns of text_statistics()."""
        out: Column | None = None
        for rule in self.rules:
            holds = rule[0].column()
            for c in rule[1:]:
                holds = holds & c.column()
            out = F.when(holds, "drop") if out is None else out.when(holds, "drop")
        return F.lit("keep") if out is None else out.otherwise("keep")

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """True where a rule drops: verdict() on arrays."""
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def __str__(self) -> str:
        return "\n".join([*(f"IF {' AND '.join(map(str, r))} THEN drop" for r in self.rules), "ELSE keep"])


def _gain(bad: np.ndarray, good: np.ndarray, bad0: int, good0: int) -> np.ndarray:
    """Bad rows that stay times the bits by which their share grew."""
    share = np.log2(np.maximum(bad, 1e-9) / np.maximum(bad + good, 1e-9))
    return np.where(bad > 0, bad * (share - np.log2(bad0 / (bad0 + good0))), -np.inf)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    best: tuple[float, Condition | None] = (0.0, None)
    n_bad, n_good = int(bad[rows].sum()), int((~bad[rows]).sum())
    for name, values in x.items():
        order = rows[np.argsort(values[rows], kind="stable")]
        v, b = values[order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_bad = np.cumsum(b)[cut]
        below_good = cut + 1 - below_bad
        for above, pb, pg in ((False, below_bad, below_good), (True, n_bad - below_bad, n_good - below_good)):
            gains = _gain(pb, pg, n_bad, n_good)
            k = int(np.argmax(gains))
            if gains[k] > best[0] + 1e-12:
                best = (float(gains[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best


def grow_rules(x: dict[str, np.ndarray], bad: np.ndarray, prune_part: np.ndarray | None = None, precision: float = 0.95, support: int = 5, most: int = 12) -> DecisionList:
    """Sequential covering: grows on the rows that are not in prune_part (by default every third), prunes on the rest, stops when a rule isn't precise there."""
    out = DecisionList()
    left = np.arange(len(bad))
    prune_part = left % 3 == 0 if prune_part is None else prune_part
    while len(out.rules) < most:
        grow, prune = left[~prune_part[left]], left[prune_part[left]]
        if bad[grow].sum() < support:
            break
        rule: list[Condition] = []
        rows = grow
        while (~bad[rows]).any() and len(rule) < 6:
            gain, condition = _best_condition(x, bad, rows)
            if condition is None or gain <= 0:
                break
            rule.append(condition)
            rows = rows[condition.holds(x)[rows]]
        if not rule:
            break

        def worth(conditions: list[Condition], prune=prune) -> tuple[float, int]:
            covered = prune[np.logical_and.reduce([c.holds(x)[prune] for c in conditions])]
            b = int(bad[covered].sum())
            g = len(covered) - b
            return (b - g) / max(b + g, 1), b

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        score, caught = worth(rule)
        covered = left[np.logical_and.reduce([c.holds(x)[left] for c in rule])]
        if caught < 1 or (1 + score) / 2 < precision or bad[covered].mean() < precision:
            break
        out.rules.append(rule)
        left = np.setdiff1d(left, covered)
    return out


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **how) -> DecisionList:
    """A list learned from at most about train_rows labelled documents; labels: doc_id and quality (0 is bad)."""
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = usable.count()
    chosen = usable.where(F.xxhash64("doc_id") <= F.lit(common.least_hash(train_rows / max(total, 1))))
    # The sample's size is bounded by train_rows, so it may be broadcast.
    sample = text_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    prunes = (F.pmod(F.xxhash64(F.lit("prune"), F.col("doc_id")), F.lit(3)) == 0).alias("_prune")
    rows = sample.where(~base_failed()).select(F.col("quality").alias("_q"), prunes, *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items())).toPandas()
    x = {f: rows[f].to_numpy(float) for f in FEATURES}
    return grow_rules(x, (rows["_q"] == 0).to_numpy(bool), rows["_prune"].to_numpy(bool), **how) if len(rows) else DecisionList()


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with the statistics, base_failed and kept."""
    made = text_statistics(docs.drop("base_failed", "kept")).withColumn("base_failed", base_failed())
    return made.withColumn("kept", ~F.col("base_failed") & (rules.verdict() == "keep"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    return judge(docs.select("doc_id", "text"), learn(docs, labels)).select("doc_id", *BASE, "base_failed", "kept")


def clean_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that rules keep, with their columns."""
    inner, back = common.inner_names(docs, "text")
    return judge(inner, rules).where("kept").select(*back)


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
