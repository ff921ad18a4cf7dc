"""Language identification by language-bitmask n-gram filters.

For each language the character n-grams that are frequent in its labelled texts are learned. A bit-sliced Bloom filter holds
them all: each cell is a mask with a bit for each language, in words of 64 languages, an n-gram sets its language's bit in ``hashes`` cells, and the AND
of an n-gram's cells gives every language that has it at once. A text's language is that with the most hits after the hits
expected from false positives are taken away (a language's false positive rate is the share of set bits to the power of
``hashes``); ties go to the first language by name. The score is the winner's corrected share of
the text's n-grams.

N-grams are runs of three characters, lower-cased, with every non-letter as a space, that have a letter in the middle. The
filter's size follows from the number of kept n-grams, which ``min_share`` bounds by 1/min_share a language, so it may be
broadcast. Learning reads at most about ``train_rows`` labelled rows of each language, chosen by hash (however many rows there
are, the share that is read never becomes nothing).

Defined results: null texts and texts without a letter are ``und`` with score 0; a text without any known n-gram gets the
language with most labelled rows and score 0; if nothing is learned all are ``und``; repeated rows are judged one by one;
very long texts are worked through whole, in slices; an empty table gives no rows; input columns named ``lang_pred`` or
``score`` are replaced, others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Characters in an n-gram.
N = 3
#: Expected number of labelled rows that a language is learned from, at most.
TRAIN_ROWS = 4000
#: Least share of a language's n-grams that a kept n-gram has, and least share of the largest share among languages.
MIN_SHARE, MIN_RATIO = 2e-5, 0.1
#: Cells in the filter for each kept n-gram, and hash functions.
CELLS_EACH, HASHES = 12, 3
#: Languages in a word of a cell, at most; a cell has as many words as the languages need.
WORD_BITS = 64
UNKNOWN = "und"
_U = np.uint64
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


#: Characters of one text that are worked on at a time.
SLICE = 1 << 20


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of code points, the first and last of which are no middles: hashes, places of the middles, and which are letters."""
    letter = letter_table()[points]
    p = np.where(letter, points, 32).astype(_U)
    middle = np.flatnonzero(letter[1:-1]) + 1
    return tokens.mix((p[middle - 1] << _U(42)) | (p[middle] << _U(21)) | p[middle + 1]), middle, letter


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams, the row of each, and whether each row has a letter."""
    lowered = [t.lower() for t in texts]
    # Texts are parted by two spaces, so that no n-gram with a letter in its middle crosses them.
    h, middle, letter = _grams(_points("".join(f" {t} " for t in lowered)))
    row = np.repeat(np.arange(len(texts)), np.array([len(t) + 2 for t in lowered], np.int64))
    has = np.zeros(len(texts), bool)
    has[row[letter]] = True
    return h, row[middle], has


def slices(text: str, size: int | None = None) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams, in pieces of at most size n-grams; the pieces together are those of text_grams()."""
    low, size = f" {text.lower()} ", size or SLICE
    for at in range(1, len(low) - 1, size):
        yield _grams(_points(low[at - 1 : min(at + size, len(low) - 1) + 1]))[0]


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    """Whole texts in lists of about a million characters."""
    part, size = [], 0
    for t in column.to_pylist():
        if part and len(t or "") >= 1 << 20:  # by itself
            yield part
            part, size = [], 0
        part.append(t or "")
        size += len(part[-1])
        if size >= 1 << 20:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter over n-gram hashes, a bit for each language."""

    languages: list[str]
    cells: np.ndarray
    false_positive: np.ndarray
    usual: int

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray], usual: int) -> LanguageFilter:
        most = max([len(g) for g in grams], default=0)
        bits = max(12, int(most * CELLS_EACH).bit_length())
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.dtype(k).itemsize * 8), np.uint64)
        cells = np.zeros((max(1, -(-len(languages) // WORD_BITS)), 1 << bits), kind)
        for i, g in enumerate(grams):
            for at in _places(g, bits):
                cells[i // WORD_BITS][at] |= kind(1 << i % WORD_BITS)
        rate = np.array([float(((cells[i // WORD_BITS] >> kind(i % WORD_BITS)) & kind(1)).mean()) for i in range(len(languages))])
        return cls(languages, cells, rate**HASHES, usual)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that have each n-gram, in words of WORD_BITS languages."""
        places = _places(grams, int(self.cells.shape[1]).bit_length() - 1)
        out = self.cells[:, next(places)]
        for at in places:
            out &= self.cells[:, at]
        return out

    def counts(self, grams: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hits by language and n-grams of each of n texts."""
        masks, one = self.masks(grams), self.cells.dtype.type(1)
        got = [np.bincount(row, weights=(masks[i // WORD_BITS] >> self.cells.dtype.type(i % WORD_BITS)) & one, minlength=n) for i in range(len(self.languages))]
        return np.stack(got), np.bincount(row, minlength=n)

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        if n == 1:  # a text that may be very long
            found, total = np.zeros((len(self.languages), 1)), np.zeros(1, np.int64)
            for grams in slices(texts[0]):
                more = self.counts(grams, np.zeros(len(grams), np.int64), 1)
                found, total = found + more[0], total + more[1]
            has = total > 0
        else:
            grams, row, has = text_grams(texts)
            found, total = self.counts(grams, row, n)
        hits = np.empty((len(self.languages), n))
        for i, rate in enumerate(self.false_positive):
            hits[i] = np.maximum(0, found[i] - rate * total) / (1 - rate) if rate < 1 else 0
        best = hits.argmax(axis=0)
        score = np.clip(hits[best, np.arange(n)] / np.maximum(total, 1), 0, 1)
        best = np.where(score > 0, best, self.usual)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0)


def _places(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (grams >> _U(32)) | _U(1)
    for k in range(HASHES):
        yield (grams + _U(k) * step) & _U((1 << bits) - 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task, by language."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = batch.column(0).to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for part in _chunks(pa.array(own, pa.string())):
                for grams in slices(part[0]) if len(part) == 1 else [text_grams(part)[0]]:
                    h, c = np.unique(grams, return_counts=True)
                    if lang in total:
                        both, where = np.unique(np.concatenate((total[lang][0], h)), return_inverse=True)
                        h, c = both, np.bincount(where, weights=np.concatenate((total[lang][1], c))).astype(np.int64)
                    total[lang] = h, c
    for lang, (h, c) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageFilter:
    """A filter from labelled rows with a doc_id; of each language about train_rows are read at most."""
    rows = labelled.where(F.col(lang).isNotNull()).select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilter.build([], [], 0)
    languages = sorted(counts)
    bounds = labelled.sparkSession.createDataFrame([(x, common.least_hash(train_rows / n)) for x, n in counts.items()], "lang string, bound long")
    chosen = rows.join(F.broadcast(bounds), "lang").where("text is not null").where(F.xxhash64("doc_id", "text") <= F.col("bound")).select("text", "lang")
    counted = chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = common.stored(counted, common.work_folder(labelled.sparkSession, "language") + "/grams")
    sums = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # What is collected is bounded: min_share keeps 1/min_share n-grams a language at most.
    least = labelled.sparkSession.createDataFrame([(x, max(2.0, n * MIN_SHARE)) for x, n in sums.items()], "lang string, least double")
    found = grams.join(F.broadcast(least), "lang").where("n >= least").select("lang", "gram", "n").toPandas()
    found["share"] = found["n"] / found["lang"].map(sums)
    found = found[found["share"] >= MIN_RATIO * found.groupby("gram")["share"].transform("max")]
    lists = [found["gram"][found["lang"] == x].to_numpy(np.int64).view(_U) for x in languages]
    return LanguageFilter.build(languages, lists, max(range(len(languages)), key=lambda i: (counts[languages[i]], -i)))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in _chunks(column):
            found, score = shared.value.decide(part)
            names += found
            scores.append(score)
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    judge = F.arrow_udf(run, "lang_pred string, score double")
    base, back = common.inner_names(docs.drop("lang_pred", "score"), text)
    return base.withColumn("_found", judge(F.col(text))).select(*back, "_found.lang_pred", "_found.score")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that aren't held out."""
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
