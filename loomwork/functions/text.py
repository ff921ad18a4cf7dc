"""Text functions as columns: tokens, normal forms, titles, visible text, number lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters; runs of word characters (letters, digits, underscore).
LETTERS, WORDS = r"\p{L}+", r"[\p{L}\p{N}_]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: str | Column, pattern: str = LETTERS) -> Column:
    """Lower-cased matches of pattern in order; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), F.lit(0)), F.lower)


def normalize(text: str | Column) -> Column:
    """Joins words broken by a hyphen at a line's end, other characters than words to one space, digits set apart."""
    joined = F.regexp_replace(_col(text), r"-\n", "")
    spaced = F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", " ")
    apart = F.regexp_replace(spaced, r"([0-9]+)", " $1 ")
    return F.trim(F.regexp_replace(apart, " +", " "))


def fold_letters(text: str | Column) -> Column:
    """Cyrillic io becomes ie, underscores go, ends are trimmed."""
    return F.trim(F.translate(_col(text), "ё_", "е"))


def title(html: str | Column) -> Column:
    """The first title element of the lower-cased page; empty if there is none."""
    return F.trim(F.regexp_extract(F.lower(_col(html)), r"(?s)<title>(.*?)</title>", 1))


def visible_text(html: str | Column) -> Column:
    """The page without head, scripts, styles, comments and tags, with single spaces."""
    bare = F.regexp_replace(_col(html), r"(?is)<!--.*?-->|<head.*?</head>|<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def stem(words: str | Column, stemmer: Callable[[str], str] | None = None) -> Column:
    """Words put through a stemmer by an Arrow function; without one they stay."""
    if stemmer is None:
        return _col(words)
    import numpy as np
    import pyarrow as pa

    def run(lists):

        # Each distinct word of a batch goes through the stemmer once.
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        stems = pa.array([None if w is None else stemmer(w) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int32)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=None)
        return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=lists.is_null())

    return F.arrow_udf(run, "array<string>")(_col(words))


def float_list(text: str | Column) -> Column:
    """Numbers of a bracketed, blank-separated list that may span lines."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"[-+0-9.eE]+"), F.lit(0)), lambda x: x.cast("double"))
