r"""Line deduplication by a log-template tree: recurring line templates are dropped from all documents.

A line's tokens are its runs of other than white space, those with a digit masked as ``<*>``. The tree has a fixed depth: a
line goes to the leaf of its token count and its first ``depth`` masked tokens. Within a leaf a token is constant at its
position if lines of at least ``min_docs`` documents have it there; all others are variable fields, ``<*>``. A line is an
instance of a recurring template if ``similarity`` of its tokens behind the leading ones are constant, or if the line itself
(masked) is in ``min_docs`` documents; such lines are dropped wherever they stand, the first time too. Lines of more than
``long_tokens`` tokens are passages rather than furniture and need only ``long_docs`` documents. A document counts once,
however many of its lines have a token.

Texts are masked once: lines are stored with their hashes and leaf, and from then on only hashes move, but for the lines of
leaves that recur without all being the same. Counts are summed on the map side, joins that a frequent line, leaf or token may
make uneven have stored tables on both sides, which Spark can split. Everything is built-in expressions.

Defined results: null text stays null (no lines); blank lines never are dropped and keep their place; very long texts are
lines like any other; repeated rows count as documents and are cleaned alike; ties don't arise, as all lines of a template go;
an empty table gives no rows; input columns named ``n_lines`` or ``n_dropped`` are replaced, others keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Leading tokens in the tree; documents that a token or line recurs in; share of constant tokens behind the leading ones.
DEPTH, MIN_DOCS, SIMILARITY = 3, 20, 0.6
#: Lines of more tokens are passages, which recur from LONG_DOCS documents on.
LONG_TOKENS, LONG_DOCS = 50, 2
FIELD = "<*>"


def masked_lines(text: str) -> Column:
    """Each line with single spaces between its tokens and FIELD for those with a digit; blank lines are empty."""

    def mask(line: Column) -> Column:
        bare = F.btrim(line, F.lit(common.SPACE_CHARS))
        tidy = F.when(bare.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(bare, f"{common.SPACE}+", " ")).otherwise(bare)
        return F.when(tidy.rlike("[0-9]"), F.regexp_replace(tidy, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(tidy)

    return F.transform(F.split(F.col(text), "\n"), mask)


def hashed_lines(docs: DataFrame, keys: list[str], text: str = "text", depth: int = DEPTH) -> DataFrame:
    """keys and, for each line that isn't blank: _no, line (masked), l1 and l2 (its hashes), n (tokens), leaf, new (not seen before in its text)."""
    own = docs.select(*keys, F.inline_outer(F.array(F.struct(masked_lines(text).alias("_all")))))
    numbered = F.transform("_all", lambda x, i: F.struct(F.xxhash64(F.lit(1), x).alias("l1"), F.xxhash64(F.lit(2), x).alias("l2"), i.alias("_no")))
    filled = F.filter(numbered, lambda x: F.get("_all", x["_no"]) != "")
    own = own.select(*keys, "_all", F.inline_outer(F.array(F.struct(filled.alias("_s")))))
    repeats = F.size(F.array_distinct(F.transform("_s", lambda x: x["l1"]))) < F.size("_s")
    own = own.select(*keys, "_all", F.inline_outer(F.array(F.struct(F.when(repeats, F.array_sort("_s")).otherwise(F.col("_s")).alias("_s")))))
    before = lambda k: F.get("_s", k - 1)
    same = lambda x, k: F.coalesce((before(k)["l1"] == x["l1"]) & (before(k)["l2"] == x["l2"]), F.lit(False))
    made = F.transform("_s", lambda x, k: F.struct(x["l1"].alias("l1"), x["l2"].alias("l2"), x["_no"].alias("_no"), F.get("_all", x["_no"]).alias("line"), (~same(x, k)).alias("new")))
    lines = own.select(*keys, F.inline(made))
    tokens = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("n", tokens).withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", depth)))


def _documents_over(parts: DataFrame, several: DataFrame, need: Column) -> DataFrame:
    """leaf, pos and token of parts(..., m) in at least need documents; several(id, ...): what documents with more than one line in a leaf have."""
    keys = ["leaf", "n", "pos", "token"]
    sums = parts.groupBy(*keys).agg(F.sum("m").alias("_m")).where(F.col("_m") >= need)
    again = several.groupBy("id", *keys).agg((F.count("*") - 1).alias("_n")).where("_n > 0").groupBy(*keys).agg(F.sum("_n").alias("_n"))
    return sums.join(again, keys, "left").where(F.col("_m") - F.coalesce("_n", F.lit(0)) >= need).select("leaf", "pos", "token")


def recurring_lines(lines: DataFrame, folder: str, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS) -> DataFrame:
    """l1, l2: hashes of the lines of recurring templates, stored below folder; lines as hashed_lines() gives, stored, with id, a number for each document."""
    need = F.when(F.col("n") > long_tokens, long_docs).otherwise(min_docs)
    new = lines.where("new")
    counted = common.stored(new.groupBy("l1", "l2", "leaf", "n").agg(F.count("*").alias("m")), f"{folder}/counted")
    # A leaf of one line, or whose lines all recur as they are, needs no more.
    leaves = counted.groupBy("leaf", "n").agg(F.sum("m").alias("_m"), F.min("m").alias("_least"), F.count("*").alias("_lines"))
    mixed = common.stored(leaves.where((F.col("_lines") > 1) & (F.col("_m") >= need) & (F.col("_least") < need) & (F.col("n") > depth)).select("leaf"), f"{folder}/mixed")
    inner = common.stored(new.select("id", "leaf", "n", "l1", "l2", "line").join(mixed, "leaf", "left_semi"), f"{folder}/inner")
    token = F.posexplode(F.split("line", " ")).alias("pos", "token")
    field = (F.col("pos") >= depth) & (F.col("token") != FIELD)
    distinct = inner.groupBy("leaf", "n", "l1", "l2", "line").agg(F.count("*").alias("m"))
    parts = distinct.select("leaf", "n", "l1", "l2", "m", token).where(field)
    twice = inner.groupBy("id", "leaf").agg(F.count("*").alias("_n")).where("_n > 1").select("id", "leaf")
    several = inner.join(twice, ["id", "leaf"], "left_semi").select("id", "leaf", "n", token).where(field)
    constant = common.stored(_documents_over(parts, several, need), f"{folder}/constant")
    kept = parts.where(F.col("m") < need).join(constant, ["leaf", "pos", "token"], "left_semi").groupBy("l1", "l2", "n").agg(F.count("*").alias("_kept"))
    alike = counted.where(F.col("m") >= need).select("l1", "l2")
    return common.stored(alike.union(kept.where(F.col("_kept") >= similarity * (F.col("n") - depth)).select("l1", "l2")), f"{folder}/gone")


def drop_recurring(docs: DataFrame, text: str = "text", depth: int = DEPTH, **how) -> DataFrame:
    """docs with the recurring templates' lines cut from text, n_lines (before) and n_dropped; how as in recurring_lines()."""
    folder = common.work_folder(docs.sparkSession, "templates")
    base, back = common.inner_names(docs.drop("n_lines", "n_dropped"), text)
    keyed = base.select("*", *common.row_key(*[c for c, kind in base.dtypes if not kind.startswith(("map", "variant"))]))
    numbered = keyed.select("_k1", "_k2", text, F.monotonically_increasing_id().alias("id"))
    lines = common.stored(hashed_lines(numbered, ["id", "_k1", "_k2"], text, depth), f"{folder}/lines")
    gone = recurring_lines(lines, folder, depth, **how)
    hits = lines.select("_k1", "_k2", "_no", "l1", "l2").join(gone, ["l1", "l2"], "left_semi")
    # Repeated rows have the same key, and so the same lines, which count once.
    by_row = common.stored(hits.groupBy("_k1", "_k2").agg(F.collect_set("_no").alias("_gone")), f"{folder}/rows")
    common.delete(docs.sparkSession, f"{folder}/lines")
    joined = keyed.join(by_row, ["_k1", "_k2"], "left")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    # Through the generator a text is split once, and only if it loses lines.
    split = F.when(F.col("_gone").isNotNull(), F.split(F.col(text), "\n"))
    out = joined.select(*base.columns, "_gone", n_lines.cast("long").alias("n_lines"), F.inline_outer(F.array(F.struct(split.alias("_lines")))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    left = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    out = out.withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)).select(*back, "n_lines", "n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("clean_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
raw AS (SELECT k, unnest(generate_series(1, len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
tidy AS (SELECT k, no, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM raw),
masked AS (SELECT k, no, line, regexp_replace(t, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS t FROM tidy),
u AS (SELECT t, count(DISTINCT k) AS m, len(string_split(t, ' ')) AS n, CASE WHEN len(string_split(t, ' ')) > 50 THEN 2 ELSE 20 END AS need,
             CAST(len(string_split(t, ' ')) AS VARCHAR) || ' ' || array_to_string(string_split(t, ' ')[1:3], ' ') AS leaf
      FROM masked WHERE t <> '' GROUP BY t),
busy AS (SELECT leaf FROM u GROUP BY leaf, need HAVING sum(m) >= need AND count(*) > 1),
parts AS (SELECT t, m, n, need, leaf, unnest(generate_series(1, n)) AS pos, unnest(string_split(t, ' ')) AS token FROM u WHERE leaf IN (SELECT leaf FROM busy)),
const AS (SELECT p.leaf, p.pos, p.token FROM parts p JOIN (SELECT DISTINCT k, t FROM masked) x ON x.t = p.t
          WHERE p.pos > 3 AND p.token <> '<*>' GROUP BY p.leaf, p.pos, p.token, p.need HAVING count(DISTINCT x.k) >= p.need),
alike AS (SELECT p.t FROM parts p JOIN const c ON c.leaf = p.leaf AND c.pos = p.pos AND c.token = p.token GROUP BY p.t, p.n HAVING count(*) >= 0.6 * (p.n - 3)),
gone AS (SELECT t FROM u WHERE m >= need UNION SELECT t FROM alike),
clean AS (
  SELECT k, count(*) AS n_lines, count(g.t) AS n_dropped,
         coalesce(string_agg(x.line, chr(10) ORDER BY x.no) FILTER (WHERE g.t IS NULL), '') AS text
  FROM masked x LEFT JOIN gone g ON g.t = x.t GROUP BY k)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped, sha256(c.text) AS clean_sha256
FROM d LEFT JOIN clean c USING (k)
"""
