"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks.

1. Targets: sources in order of code points (null last) carry the weights in turn, share ``epochs`` times all tokens, stop at
   ``cap`` times their own, and the excess is shared again by weight until none is above (solved at once: sources cap in
   order of size over weight).
2. Blocks: each source's documents, shuffled by hash, are laid end to end and cut into blocks of equal size (within one
   token), at most ``block_tokens``.
3. Schedule: point i of the golden-ratio sequence falls into the cumulative weights of the sources and gives slot i to one;
   slots are ranked within their source, slots over its quota go and missing ones are appended, and rank r takes block
   ``r mod blocks`` in pass ``r div blocks``.
4. Slots join the pieces of documents that lie in their block.

Ranks and running sums are worked out in two steps (within buckets of bounded size, then over bucket totals), so no source's
rows meet in one task; the list of sources, a row each, is ordered in one. Everything is built-in expressions; only the number
of slots reaches the driver.

Defined results: null or wordless texts have size 0 and are never taken; a null source is one source, the last; repeated rows
are documents of their own (which of them a cut falls on is arbitrary, the set of results is not); an empty table gives no
rows; very long texts are cut over many blocks and come back whole but for a source's last; ``mixed_documents`` keeps other columns as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Production parameters: weights by order of source, tokens to take against all tokens, most passes over a source.
WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
CAP = 2
#: Most tokens in a block.
BLOCK_TOKENS = 128
#: The golden ratio's fractional part in units of 2^-40, odd so that no point repeats before 2^40 slots.
GOLDEN_BITS = 40
GOLDEN = int((5**0.5 - 1) / 2 * 2**GOLDEN_BITS) | 1
#: Cells of the unit interval by which points find their source.
CELLS = 4096


def sized_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size (words), _h (the shuffle's order) and _uid (a number for each row)."""
    base = docs.drop("size", "_h", "_uid")
    return base.select("*", common.word_count(F.col(text)).alias("size"), F.xxhash64("doc_id", text).alias("_h"), F.monotonically_increasing_id().alias("_uid"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size), a row for each source, with _sid (its place in order), weight and target."""
    # One row for each source: the windows over all of them are as small as the list of sources.
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    numbered = sizes.withColumn("_sid", F.row_number().over(by_name) - 1)
    weighed = numbered.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("_sid", F.lit(len(weights)))).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "_sid").rowsBetween(Window.unboundedPreceding, -1)
    # In this order sources reach their cap one after the other; the first that doesn't sets the rate for all that follow.
    left = epochs * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavier = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ruled = weighed.select("*", (left / heavier).alias("_rate"))
    free = F.col("source_size") * cap >= F.col("weight") * F.col("_rate")
    rate = F.min(F.when(free, F.struct((F.col("source_size") / F.col("weight")).alias("r"), "_sid", "_rate"))).over(every)["_rate"]
    most = F.col("source_size") * float(cap)
    return ruled.withColumn("_all", rate).select("_sid", "source", "source_size", "weight", F.coalesce(F.least(F.col("weight") * F.col("_all"), most), most).alias("target"))


def plan_sources(sized: DataFrame, block_tokens: int = BLOCK_TOKENS, **how) -> DataFrame:
    """Each source with its target, _block (tokens in a block), _blocks and _quota (slots that it gets)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    planned = targets(sizes.drop("_docs"), **how)
    block = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_tokens)))).cast("long")
    planned = planned.withColumn("_block", block).withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_block")).cast("long"))
    passes = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.round((F.col("target") - passes * F.col("source_size")) / F.col("_block")).cast("long")
    quota = passes * F.col("_blocks") + F.least(rest, F.col("_blocks"))
    return planned.withColumn("_quota", F.least(quota, F.col("_blocks") * int(how.get("cap", CAP))).cast("long"))


def schedule(planned: DataFrame) -> DataFrame:
    """slot, _sid, block and pass in training order; planned as plan_sources() gives, stored."""
    spark = planned.sparkSession
    live = planned.where("_quota > 0").select("_sid", "_quota", "_blocks")
    total = int(live.agg(F.coalesce(F.sum("_quota"), F.lit(0))).first()[0])
    n = max(total, 1)
    until = F.sum("_quota").over(Window.orderBy("_sid"))
    spans = live.select("_sid", (until - F.col("_quota")).alias("_lo"), until.alias("_hi"))
    cell = lambda x: F.floor(x * (CELLS / n)).cast("long")
    cells = spans.select("*", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi") - 1))).alias("_cell"))
    half = GOLDEN_BITS // 2
    i = F.col("id")
    wrapped = F.pmod(i * F.lit(GOLDEN >> half), F.lit(1 << half)) * F.lit(1 << half) + i * F.lit(GOLDEN & ((1 << half) - 1))
    x = F.floor(F.pmod(wrapped, F.lit(1 << GOLDEN_BITS)).cast("double") * (n / float(1 << GOLDEN_BITS))).cast("long")
    # Chunks of about the square root of all slots keep both steps of the ranking small.
    chunk = max(1024, int(n**0.5))
    points = spark.range(total).select(F.col("id").alias("slot"), x.alias("_x")).select("slot", "_x", cell(F.col("_x")).alias("_cell"), F.floor(F.col("slot") / chunk).alias("_chunk"))
    given = points.join(cells, "_cell").where("_x >= _lo and _x < _hi").select("slot", "_sid", "_chunk")
    counts = given.groupBy("_sid", "_chunk").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_sid").orderBy("_chunk")) - F.col("_n")
    offsets = counts.select("_sid", "_chunk", earlier.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_sid", "_chunk").orderBy("slot")) - 1
    ranked = given.withColumn("_in", place).join(offsets, ["_sid", "_chunk"]).select("slot", "_sid", (F.col("_before") + F.col("_in")).alias("_rank"))
    # Slots over a source's quota go, missing ones follow at the end.
    had = counts.groupBy("_sid").agg(F.sum("_n").alias("_had"))
    short = live.join(had, "_sid", "left").select("_sid", "_quota", F.coalesce("_had", F.lit(0)).alias("_had")).where("_had < _quota")
    added = short.select((F.lit(total) + F.col("_sid")).alias("slot"), "_sid", F.explode(F.sequence(F.col("_had"), F.col("_quota") - 1)).alias("_rank"))
    every = ranked.unionByName(added).join(live, "_sid").where("_rank < _quota")
    return every.select("slot", "_sid", (F.col("_rank") % F.col("_blocks")).alias("block"), F.expr("_rank div _blocks").alias("pass"))


def pieces(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """_uid, _sid, block, and the piece's words in the document from _from to _to: each document laid out over blocks."""
    n = max(1, sized.count())
    buckets = max(64, int(n**0.5))
    plan = planned.select("_sid", F.col("source").alias("_s"), "_block")
    rows = sized.where("size > 0").select("_uid", "_h", "size", "source").join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("_uid", "_h", "size", "_sid", "_block")
    rows = rows.withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    totals = rows.groupBy("_sid", "_bucket").agg(F.sum("size").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_sid").orderBy("_bucket")) - F.col("_n")
    offsets = totals.select("_sid", "_bucket", earlier.alias("_before"))
    own = F.sum("size").over(Window.partitionBy("_sid", "_bucket").orderBy("_h", "_uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = rows.withColumn("_own", own).join(offsets, ["_sid", "_bucket"]).withColumn("_lo", F.col("_before") + F.col("_own"))
    cut = laid.select("_uid", "_sid", "_lo", "size", "_block", F.explode(F.sequence(F.expr("_lo div _block"), F.expr("(_lo + size - 1) div _block"))).alias("block"))
    first = F.greatest(F.col("block") * F.col("_block"), F.col("_lo")) - F.col("_lo")
    end = F.least((F.col("block") + 1) * F.col("_block"), F.col("_lo") + F.col("size")) - F.col("_lo")
    return cut.select("_uid", "_sid", "block", first.alias("_from"), end.alias("_to"))


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, planned sources (both stored) and the mix: slot, pass, _uid, _from, _to for each piece of each slot."""
    spark = docs.sparkSession
    folder = common.work_folder(spark, "mixing")
    sized = common.stored(sized_documents(docs), f"{folder}/sized")
    planned = common.stored(plan_sources(sized, block_tokens, **how), f"{folder}/sources")
    taken = schedule(planned).join(pieces(sized, planned), ["_sid", "block"])
    return sized, planned, taken.select("slot", "pass", "_uid", "_from", "_to")


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    slim = docs.select("doc_id", "text", "source")
    folder = common.work_folder(docs.sparkSession, "mixing")
    sized = common.stored(sized_documents(slim).drop("text"), f"{folder}/sized")
    planned = common.stored(plan_sources(sized, **how), f"{folder}/sources")
    taken = schedule(planned).join(pieces(sized, planned), ["_sid", "block"]).groupBy("_uid").agg(F.sum(F.col("_to") - F.col("_from")).alias("_taken"))
    plan = planned.select(F.col("source").alias("_s"), "source_size", "target")
    out = sized.join(taken, "_uid", "left").join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs: one for each pass over a document, its text cut to the words that the pass takes.

    A pass takes a source's blocks from the first on, so that all but a few rows (one for each source and pass) hold whole
    texts, unchanged; a cut text has its words joined by spaces. ``n_chars``, where there is one, follows the cut text.
    """
    inner, back = common.inner_names(docs, "doc_id", "text", "source", "n_chars")
    sized, _, taken = mix(inner, **how)
    parts = taken.groupBy("_uid", "pass").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    joined = sized.join(parts, "_uid")
    whole = (F.col("_from") == 0) & (F.col("_to") == F.col("size"))
    words = F.split(F.btrim("text", F.lit(common.SPACE_CHARS)), f"{common.SPACE}+")
    part = F.array_join(F.slice(words, (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")), " ")
    out = joined.withColumn("_cut", ~whole).withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*back)


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
