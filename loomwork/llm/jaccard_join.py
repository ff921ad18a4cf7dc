r"""N-gram Jaccard join by parity sketches: XOR sketches per size band, a pigeonhole join of their cells, verification.

A document's set holds the hashes of its distinct shingles (``n`` consecutive words ``[^\x20\x09-\x0D]+``, A to Z in lower
case; the whole sequence where there are fewer words). Linked sets A and B (similarity 3/4 or more) differ in at most
``d = (|A| + |B|) / 7`` shingles.

1. Equal sets form one class; from here on classes are compared, so exact copies cost one row each.
2. Cells: in each band of sizes (a factor of 2; sets at the lower end also serve the band below) shingles are hashed to a fixed
   number of cells and a filled cell keeps the XOR of its shingles' hashes. Two sets differ in at most as many cells as
   shingles, so of any d + 1 filled cells of one the other has at least one. (Sets with no more than d filled cells have the
   band's common key besides, under which they meet.)
3. Cells are counted over all sets, and a set keeps its d + 1 rarest (by count, then key): as the order is the same for all, the
   rarest cell that two linked sets share is among those of both. Cells that nobody else has come first and make no pairs, so
   that documents that share a passage, but not most of their text, don't meet at all.
   Of cells that the same classes keep, one stays, with their number.
4. In a bucket of equal cells every class is first paired with the first by three orders of keys only; pairs whose 1024-bit
   parity sketches (each shingle flips one bit) differ in more than d bits are dropped, since that distance is a lower bound
   of the symmetric difference; of what is left each class keeps, by order, the partner that it shares most buckets with,
   those pairs are verified on the whole sets, and links are joined to components. (Large sets, for which 1024 bits say
   little, have a sketch of as many bits as shingles besides.)
5. What remains are buckets whose classes are in different components: there all pairs across components whose sketches
   pass are verified too. So no link is lost, though a group of near copies never expands into all its pairs. Two classes may
   share hundreds of buckets: each has a list of its largest, in an order that is the same for all, and where two lists have a
   bucket in common, the pair is made in the first such only.

A cell, hub, class or text that a third of the rows share is summed on the map side, and joined from stored tables on both
sides, which Spark splits; no window runs over a cell. Cells are counted in two halves, so that only half of them are in a
shuffle at once. Intermediate tables are stored in the shared folder; only check sums, the number of classes
and whether a table is empty reach the driver.

Defined results: null and wordless texts have empty sets, linked with nothing; repeated ids are compared by their text and
share the component of either; a row without id links others like any row, and its component is null if no id is reachable;
very long texts are compared whole; ties don't arise; an empty table gives no rows; other columns, whatever their names,
are not looked at, and one_of_each() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens
from .components import connected_components

#: Words in a shingle.
SHINGLE = 5
#: Cells of a band for each shingle of its largest sets, and at least.
CELLS_EACH, LEAST_CELLS = 0.5, 64
#: Bits of the parity sketch, in 64-bit words.
SKETCH_WORDS = 16
_U = np.uint64
#: Sets of more shingles have a wide sketch besides, of as many bits as shingles, rounded up to a power of two.
WIDE_FROM = 64 * SKETCH_WORDS
#: Orders of classes by which hubs are chosen: that of k1 XOR each of these.
ORDERS = (0, -1, 0x5555555555555555)
#: Buckets in the list by which a pair is made once.
FIRST = 8
FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, tag long, allow array<int>, sketch array<long>, wide array<long>, cells array<long>"


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values = tokens.space_table()
    for first, end, data, offsets in tokens.slices(column):
        w = tokens.Words(data, offsets, values)
        grams, bounds = w.grams(n), w.bounds()
        for row in range(end - first):
            i, j = int(bounds[row]), int(bounds[row + 1])
            if j - i >= n:
                yield np.unique(grams[i : j - n + 1])
            else:
                yield tokens.gram_hashes(w.hash[i:j], j - i) if j > i else np.zeros(0, _U)


def key_of(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    if not len(grams):
        return 0, 0
    a, b = tokens.mix(grams), tokens.mix(grams ^ _U(0x5851F42D4C957F2D))
    two = np.array([a.sum(dtype=_U), np.bitwise_xor.reduce(b)]) + _U(len(grams))
    return tuple(tokens.mix(two).view(np.int64).tolist())


def sketch_of(grams: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity bits in a power of two of 64-bit words; the halves of a sketch XOR to the sketch of half the words."""
    bits = np.bincount((grams >> _U(7)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch_of(grams: np.ndarray) -> np.ndarray | None:
    return sketch_of(grams, 1 << (len(grams) - 1).bit_length() - 6) if len(grams) > WIDE_FROM else None


def _filled(grams: np.ndarray, band: int, most: int) -> np.ndarray:
    """Keys of the set's filled cells in a band, whose lowest bit is the band's; with the band's common key if there are no more than most."""
    count = max(LEAST_CELLS, int(CELLS_EACH * ((2 << band) - 1)) + 1)
    cell = ((grams >> _U(33)) * _U(count)) >> _U(31)
    order = np.argsort(cell, kind="stable")
    cell, ordered = cell[order], grams[order]
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    # A filled cell may XOR to nothing: it then equals an empty one, so its number alone makes the key.
    keys = tokens.mix(np.bitwise_xor.reduceat(ordered, start) ^ tokens.mix(cell[start] * _U(64) + _U(band)))
    if len(start) <= most:
        keys = np.concatenate((keys, tokens.mix(np.array([band], _U) ^ _U(0x2545F4914F6CDD1D))))
    return (keys << _U(1)) | _U(band & 1)


def cells_of(grams: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Keys of a set's cells in its band, and in the band below if a linked set may lie there; by lowest bit of the key (the two
    bands differ in it) how many cells the set keeps, less all that it has."""
    size = len(grams)
    if not size:
        return np.zeros(0, np.int64), [0, 0]
    band = size.bit_length() - 1
    least, allow = 1 << band, [0, 0]
    # The largest set that this one may be linked with has 4/3 of its shingles, and comes down to this band if it is of the next.
    most = (size + 4 * size // 3) // 7
    keys = _filled(grams, band, most)
    allow[band & 1] = most + 1 - len(keys)
    if 3 * size <= 4 * (least - 1):
        most = (size + least - 1) // 7
        below = _filled(grams, band - 1, most)
        allow[1 - (band & 1)] = most + 1 - len(below)
        keys = np.concatenate((keys, below))
    return keys.view(np.int64), allow


def _features(n: int):
    """A function for mapInArrow over doc_id, text, tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), longs, longs, longs]
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for grams in sets_of(batch.column(1), n):
                key = key_of(grams)
                made = (len(grams), *key, None, None, None, None)
                # Cells of a set that this task has emitted, of late, would only repeat.
                if len(grams) and key not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(key)
                    cells, allow = cells_of(grams)
                    made = (*made[:3], allow, sketch_of(grams), wide_sketch_of(grams), cells)
                for own, x in zip(rows, made, strict=True):
                    own.append(x)
            columns = [pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:3], batch.column(2), *columns[3:]], names=[f.split()[0] for f in FEATURES.split(", ")])

    return run


def _links(n: int):
    """Pairs (a, b, a_text, b_text) whose sets have a similarity of 3/4 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            a = batch.column(0).to_pylist()
            keep = []
            for i, other in enumerate(sets_of(batch.column(3), n)):
                if last is None or last[0] != a[i]:  # rows come sorted by a
                    last = a[i], next(sets_of(batch.column(2).slice(i, 1), n))
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= 75 * (len(last[1]) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_link(a: str, b: str) -> Column:
    """Sizes and sketches allow a similarity of 3/4; a and b prefix n and s0, s1, ..."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    distance = F.lit(0)
    for i in range(SKETCH_WORDS):
        distance = distance + F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}")))
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * distance <= n + m)


def _wide_allows() -> Column:
    """The wide sketches of a and b (a wider one folded to the other's width) allow a similarity of 3/4."""
    def half(x: str) -> Column:
        m = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), m), F.slice(x, m + 1, m), lambda p, q: p.bitwiseXOR(q))

    a = F.when(F.size("a_wide") > F.size("b_wide"), half("a_wide")).otherwise(F.col("a_wide"))
    b = F.when(F.size("b_wide") > F.size("a_wide"), half("b_wide")).otherwise(F.col("b_wide"))
    distance = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
    return F.col("a_wide").isNull() | F.col("b_wide").isNull() | (7 * distance <= F.col("a_n") + F.col("b_n"))


def _across(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components in a bucket that sizes and sketches allow, as a rule once each.

    list is the beginning of a class's buckets in one order, so no bucket before the first that two lists have in common is shared.
    """
    side = lambda p: rest.select("cell", *(F.col(x).alias(f"{p}{x}") for x in rest.columns if x != "cell"))
    first = F.get(F.array_intersect("a_list", "b_list"), F.lit(0))
    here = first.isNull() | (first == F.col("cell"))
    met = side("a_").join(side("b_"), "cell").where((F.col("a_c") != F.col("b_c")) & (F.col("a_k1") < F.col("b_k1")) & _may_link("a_", "b_") & here)
    return met.select(F.col("a_k1").alias("a"), F.col("b_k1").alias("b"))


def _may_be_among(rows: DataFrame, keys: DataFrame, key: str, path: str) -> DataFrame:
    """rows without most of those whose key, an even 64-bit hash, is not among keys: by a table of bits, at least 8 for each of keys up to 8 MB."""
    power = min(26, max(12, (8 * keys.count()).bit_length()))
    place = F.shiftrightunsigned(key, 64 - power)
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    filled = keys.select(word.alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("id").agg(F.bit_or("_bit").alias("_bits"))
    every = rows.sparkSession.range(1 << power - 6).join(filled, "id", "left").select(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    table = common.stored(every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("_bits")), path)
    held = F.call_function("shiftright", F.get("_bits", word.cast("int")), bit).bitwiseAND(F.lit(1)) == 1
    return rows.crossJoin(F.broadcast(table)).where(held).drop("_bits")


def _sketched(pairs: DataFrame, classes: DataFrame, narrow: bool = True) -> DataFrame:
    """Those of pairs(a, b, ...) that sizes and sketches allow."""
    words = [f"s{i}" for i in range(SKETCH_WORDS)] if narrow else []
    side = lambda p: classes.select(F.col("k1").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ["n", "wide", *words]))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return (met.where(_may_link("a_", "b_")) if narrow else met).where(_wide_allows()).select(*pairs.columns)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, path: str) -> DataFrame:
    """Those of pairs(a, b) whose sets have a similarity of 3/4 or more, stored."""
    side = lambda p: texts.select(F.col("k1").alias(p), F.col("text").alias(f"{p}_text"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text")
    return common.stored(both.mapInArrow(_links(n), "a long, b long").distinct(), path)


def _met_cells(raw: DataFrame, folder: str) -> DataFrame:
    """cell, k1 and m (emitted so often) of all cells that are emitted more than once."""
    cells = raw.where("cells is not null").select("k1", F.explode("cells").alias("cell"))
    halves = []
    for half in range(2):
        part = cells.where(F.col("cell").bitwiseAND(F.lit(2)) == 2 * half)
        often = common.stored(part.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1"), f"{folder}/often{half}")
        halves.append(common.stored(part.join(often.hint("shuffle_hash"), "cell").select("cell", "k1", "m"), f"{folder}/met{half}"))
    return halves[0].union(halves[1])


def _rarest(met: DataFrame, raw: DataFrame) -> DataFrame:
    """cell and k1: of each class the rarest cells that it keeps, less those that nobody else has."""
    allow = raw.where("cells is not null").select("k1", F.col("allow")[0].alias("_a0"), F.col("allow")[1].alias("_a1")).dropDuplicates(["k1"])
    bit = F.col("cell").bitwiseAND(F.lit(1))
    own = met.repartition("k1").distinct().join(allow, "k1").withColumn("_bit", bit)
    in_band = Window.partitionBy("k1", "_bit")
    ranked = own.withColumn("_place", F.row_number().over(in_band.orderBy("m", "cell"))).withColumn("_met", F.count("*").over(in_band))
    return ranked.where(F.col("_place") <= F.col("_met") + F.when(F.col("_bit") == 0, F.col("_a0")).otherwise(F.col("_a1"))).select("cell", "k1")


def linked_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Features of each document (doc_id, n_shingles, k1, k2) and the component of each class that has links (k1, component)."""
    spark = docs.sparkSession
    folder = common.work_folder(spark, "jaccard")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text, F.col(doc_id).cast("long")).alias("tag"))
    raw = common.stored(base.mapInArrow(_features(n), FEATURES), f"{folder}/raw")
    kept = common.stored(_rarest(_met_cells(raw, folder), raw), f"{folder}/kept")
    # The cells were the bulk of the features and have done their work.
    features = common.stored(raw.withColumn("is_first", F.col("cells").isNotNull()).drop("cells", "allow"), f"{folder}/features")
    for name in ("raw", "often0", "often1", "met0", "met1"):
        common.delete(spark, f"{folder}/{name}")
    ordered = lambda i, k1="k1": F.col(k1).bitwiseXOR(F.lit(ORDERS[i]).cast("long"))
    firsts = [F.min(ordered(i)).alias(f"h{i}") for i in range(len(ORDERS))]
    buckets = kept.groupBy("cell").agg(F.count("*").alias("_m"), F.bit_xor(F.xxhash64("k1")).alias("_own"), *firsts).where("_m > 1")
    buckets = buckets.groupBy("_m", "_own", *(f"h{i}" for i in range(len(ORDERS)))).agg(F.min("cell").alias("cell"), F.count("*").alias("cells"))
    buckets = common.stored(buckets.select("cell", "cells", *(ordered(i, f"h{i}").alias(f"hub{i}") for i in range(len(ORDERS)))), f"{folder}/buckets")
    live = common.stored(kept.join(buckets, "cell"), f"{folder}/live")
    # Classes that share a cell with another, with their sketch and the text of one document.
    sketches = features.where("is_first").select("k1", "tag", F.col("n_shingles").alias("n"), "wide", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)))
    classes = common.stored(sketches.join(live.select("k1").distinct(), "k1", "left_semi").dropDuplicates(["k1"]), f"{folder}/classes")
    # Most texts have no class, and stay where they are.
    texts = common.stored(_may_be_among(base.select("tag", "text"), classes.select("tag"), "tag", f"{folder}/tags").join(classes.select("tag", "k1"), "tag").select("k1", "text").dropDuplicates(["k1"]), f"{folder}/texts")
    # By each order the hub of a class is that first member of its buckets with which it shares most of them.
    hubs = [f"hub{i}" for i in range(len(ORDERS))]
    met = live.select(F.col("k1").alias("b"), "cells", *hubs).repartition("b").withColumn("a", F.explode(F.array_distinct(F.array(*hubs)))).where("a <> b")
    counted = met.groupBy("a", "b").agg(*(F.sum(F.when(F.col(h) == F.col("a"), F.col("cells"))).alias(f"m{i}") for i, h in enumerate(hubs)))
    most = F.array(*(F.max(F.when(F.col(f"m{i}").isNotNull(), F.struct(F.col(f"m{i}").alias("m"), "a"))) for i in range(len(ORDERS))))
    best = _sketched(counted, classes).groupBy("b").agg(most.alias("most")).select("b", F.explode("most").alias("hub")).where("hub is not null")
    best = best.select(F.least("hub.a", "b").alias("a"), F.greatest("hub.a", "b").alias("b"))
    stars = common.stored(best.distinct(), f"{folder}/stars")
    first = common.stored(connected_components(_verified(stars, texts, n, f"{folder}/links"), f"{folder}/cc1"), f"{folder}/first")
    # Buckets that still hold several components: one row for each class in them.
    named = common.stored(live.join(first.select(F.col("id").alias("k1"), "component"), "k1", "left").select("cell", "k1", F.coalesce("component", "k1").alias("c")), f"{folder}/named")
    several = common.stored(named.groupBy("cell").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.count("*").alias("m")).where("_low < _high").select("cell", "m"), f"{folder}/several")
    shared = common.stored(named.join(several, "cell"), f"{folder}/shared")
    largest = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("o"), "cell"))), 1, FIRST)
    first_cells = shared.groupBy("k1").agg(F.transform(largest, lambda x: x["cell"]).alias("list"))
    rest = common.stored(shared.drop("m").join(classes.drop("tag", "wide").join(first_cells, "k1"), "k1"), f"{folder}/open")
    across = common.stored(_across(rest).distinct().join(stars, ["a", "b"], "left_anti"), f"{folder}/across")
    more = _verified(_sketched(across, classes, narrow=False), texts, n, f"{folder}/more")
    if more.isEmpty():
        return features.select("doc_id", "n_shingles", "k1", "k2"), first.select(F.col("id").alias("k1"), "component")
    both = first.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)
    components = common.stored(connected_components(both, f"{folder}/cc2"), f"{folder}/components")
    return features.select("doc_id", "n_shingles", "k1", "k2"), components.select(F.col("id").alias("k1"), "component")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    features, linked = linked_classes(docs, text, doc_id, n)
    # The least id goes from rows to classes (both hashes tell sets apart) to components and back, so that rows of a group never meet.
    classes = features.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_m")).join(linked, "k1", "left")
    folder = common.work_folder(docs.sparkSession, "components")
    classes = common.stored(classes.where("_m > 1 or component is not null"), f"{folder}/classes")
    smallest = common.stored(classes.where("component is not null").groupBy("component").agg(F.min("_least").alias("_first")), f"{folder}/smallest")
    named = common.stored(classes.join(smallest, "component", "left").select("k1", "k2", F.coalesce("_first", "_least").alias("_id")), f"{folder}/named")
    return features.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose group has a smaller doc_id; of rows with the same id one stays.

    Rows without id or without words all stay.
    """
    gone = common.stored(components(docs).where("doc_id <> component_id").select("doc_id").distinct(), common.work_folder(docs.sparkSession, "copies"))
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    columns = [f"`{c}`" for c in docs.columns]
    if twice.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    single = docs.join(gone.union(twice), "doc_id", "left_anti")
    keys = common.row_key(*(f"`{c}`" for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))))
    # Summed on the map side, however often an id repeats.
    repeated = docs.join(twice, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct(*keys)).alias("_row")).select("_row.*")
    return single.select(*columns).union(repeated.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))


#: For small tables: it compares all pairs of sets that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS gram
  FROM (SELECT k, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
sets AS (SELECT k, md5(string_agg(gram, chr(10) ORDER BY gram)) AS s FROM g GROUP BY k),
reps AS (SELECT s, min(k) AS r FROM sets GROUP BY s),
gr AS (SELECT g.k, g.gram FROM g WHERE g.k IN (SELECT r FROM reps)),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM gr a JOIN gr b ON a.gram = b.gram AND a.k < b.k GROUP BY ALL),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)
  UNION ALL SELECT r.r, s.k FROM sets s JOIN reps r USING (s) WHERE r.r <> s.k),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (k)
JOIN (SELECT r.a AS k, min(x.doc_id) AS c FROM reach r JOIN d x ON x.k = r.b GROUP BY r.a) m ON m.k = d.k
"""
