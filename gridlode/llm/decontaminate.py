"""Benchmark decontamination with SimHash windows, in DataFrame expressions only.

1. Windows    of each text as long as the items (in words), one set of windows for each length that occurs. A window can
              only pass if enough of its shingles are shingles of items of its length; a text without so many is done
              with after one scan that shuffles nothing. The search below knows nothing of which item that might be.
2. SimHash    two 64-bit fingerprints for each window and item: one weights a shingle by its count, the other takes each
              distinct shingle once, so that neither a run of one token nor its loss hides a leak. All windows of a
              text come from one running sum: a shingle enters at the first window that holds it and leaves after the last.
3. Blocks     fingerprints within RADIUS bits agree in at least one of RADIUS + 1 blocks (pigeonhole): windows meet items by
              equality of (length, fingerprint's kind, block, value), and the Hamming distance is checked.
4. Verify     exact weighted similarity (sum of minima over sum of maxima) of shingle counts, at least THRESHOLD, for all
              windows of the pair by one more running sum. Occurrence number k of a shingle adds to a window's
              overlap if the item has k of it from the window's start on, which is a range of starts.

Time and rows are linear in the lengths of texts and items. At similarity 0.8 two fingerprints differ in 9.7 bits on average
(standard deviation 2.9); RADIUS 23 is 4.6 standard deviations above. What is broadcast is measured and at most
BROADCAST_BYTES; beyond that the joins shuffle. Equal texts are searched once, told by SHA-256.

Words are lower-cased runs of ``[^\\x20\\x09-\\x0D]``; a shingle is five words, and a shorter item is one shingle of
its length; a text shorter than an item is one window. Defined results: null or empty texts and items match nothing; equal items are
all reported; rows that repeat a doc_id are reported once for each item with their best window; ties go to the earliest
window; items of 2**20 words or more are refused with a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BROADCAST_BYTES = 32 << 20
_SEPARATORS = "[\\x20\\x09-\\x0D]+"
BITS = 64
#: Bits of a long are counted three at a time in lanes of this width.
LANE = 21
LANES = tuple(tuple(range(k, min(k + 3, BITS))) for k in range(0, BITS, 3))
KINDS = ("counts", "distinct")


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for null, empty or blank texts."""
    low = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(low != "", F.split(low, _SEPARATORS)).otherwise(F.array().cast("array<string>"))


def _shingle_hashes(words: Column, size: Column, first: Column, last: Column) -> Column:
    """Hash of each run of ``size`` words that begins at first, ..., last."""
    return F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.slice(words, i + 1, size)))


def _spread(hash_: str) -> list[Column]:
    """The bits of a hash, three to a long and each in a lane of its own, so that a sum counts them all. Written as SQL: one call for each long."""
    one = lambda lane, k: f"shiftleft(getbit({hash_}, {k}), {lane * LANE})" if lane else f"getbit({hash_}, {k})"
    as_long = lambda lane, k: one(lane, k).replace(f"getbit({hash_}, {k})", f"CAST(getbit({hash_}, {k}) AS BIGINT)")
    return [F.expr(" + ".join(as_long(lane, k) for lane, k in enumerate(bits))).alias(f"b{j}") for j, bits in enumerate(LANES)]


def _print(kind: str) -> Column:
    """The fingerprint from the sums of a kind: a bit is set if more than half of the weight has it."""
    ones = lambda j, lane: f"(shiftrightunsigned({kind}{j}, {lane * LANE}) & {(1 << LANE) - 1}L)"
    bits = [f"shiftleft(CAST({ones(j, lane)} * 2 > {kind} AS BIGINT), {k})" for j, lane_bits in enumerate(LANES) for lane, k in enumerate(lane_bits)]
    return F.expr(" | ".join(bits))


def _block_values(print_: Column, radius: int) -> Column:
    """radius + 1 structs (block, value) that cover the 64 bits."""
    parts = radius + 1
    cuts = [BITS * k // parts for k in range(parts + 1)]
    one = lambda k: F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(print_, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long")).alias("value"))
    return F.array(*[one(k) for k in range(parts)])


def _held(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast, if its rows of that many bytes are within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _item_tables(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, length, size, shingles, hash, times) and (item_id, length, kind, print)."""
    listed = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("length", F.size("words"))
    listed = listed.withColumn("size", F.least("length", F.lit(n))).withColumn("shingles", F.col("length") - F.col("size") + 1)
    hashed = listed.select("item_id", "length", "size", "shingles", F.explode(_shingle_hashes(F.col("words"), F.col("size"), F.lit(0), F.col("shingles") - 1)).alias("hash"))
    counted = materialize(hashed.groupBy("item_id", "length", "size", "shingles", "hash").agg(F.count(F.lit(1)).alias("times")), "items")
    if (counted.agg(F.max("length")).first()[0] or 0) >= 1 << LANE - 1:
        raise ValueError("an item has 2**20 words or more")
    sums = counted.select("item_id", "length", "times", *_spread("hash")).groupBy("item_id", "length").agg(*_weighted("times", "1L"))
    return counted, materialize(_prints(sums, ["item_id", "length"]), "prints")


def _weighted(counts: str, distinct: str) -> list[Column]:
    """Sums of the spread bits and of the weights, for both kinds of fingerprints."""
    weight = dict(zip(KINDS, (counts, distinct), strict=True))
    return [F.expr(f"sum(b{j} * {w})").alias(f"{k}{j}") for k, w in weight.items() for j in range(len(LANES))] + [F.expr(f"sum({w})").alias(k) for k, w in weight.items()]


def _prints(sums: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each kind of fingerprint, from columns counts0, ..., counts, distinct0, ..., distinct."""
    each = [F.struct(F.lit(k).alias("kind"), _print(k).alias("print")) for k in KINDS]
    return sums.select(*keys, F.explode(F.array(*each)).alias("f")).select(*keys, "f.kind", "f.print")


def _needed(threshold: float) -> Column:
    """So many shingles at least a window must share with an item of its length."""
    return (F.col("shingles") + F.col("held")) * (threshold / (1 + threshold)) - 1e-9


def _regions(source: DataFrame, wanted: DataFrame, threshold: float, n: int) -> DataFrame:
    """(key, length, size, shingles, held, first, last): the window starts of texts in which a window might pass.

    One scan of the texts; split, hash and look up run in one generated loop, without a lambda.
    """
    small = (wanted.agg(F.sum(48 + 8 * F.size("lengths"))).first()[0] or 0) <= BROADCAST_BYTES
    out = None
    for size in sorted(r["size"] for r in wanted.select("size").distinct().collect()):  # n sizes at most
        at = source.select("key", "words", F.posexplode_outer("words").alias("at", "word"))
        hashed = at.select("key", "at", F.size("words").alias("count"), F.xxhash64(F.slice("words", F.col("at") + 1, size)).alias("hash"))
        here = wanted.where(F.col("size") == size).select("hash", "lengths")
        hit = hashed.join(F.broadcast(here) if small else here, "hash").select("key", "at", "count", F.explode("lengths").alias("length"))
        hit = hit.groupBy("key", "length", "count").agg(F.count_distinct("at").alias("hits"), F.min("at").alias("low"), F.max("at").alias("high"))
        hit = hit.withColumn("size", F.lit(size)).withColumn("shingles", F.col("length") - size + 1).withColumn("all", F.col("count") - size + 1).withColumn("held", F.least("shingles", "all"))
        first, last = F.greatest(F.lit(0), F.col("low") - F.col("shingles") + 1), F.least("high", F.greatest(F.lit(0), F.col("all") - F.col("shingles")))
        hit = hit.where(F.col("hits") >= _needed(threshold)).select("key", "length", "size", "shingles", "held", "all", F.least(first, last).alias("first"), last.alias("last"))
        out = hit if out is None else out.unionByName(hit)
    return out


def _positions(source: DataFrame, regions: DataFrame) -> DataFrame:
    """The shingles (at, hash) of the regions' windows."""
    keys = regions.select("key").distinct()
    texts = source.join(_held(keys, 100), "key", "left_semi").dropDuplicates(["key"])
    joined = texts.join(regions, "key")
    stop = F.least(F.col("all"), F.col("last") + F.col("shingles")) - 1
    each = F.posexplode(_shingle_hashes(F.col("words"), F.col("size"), F.col("first"), stop)).alias("i", "hash")
    return joined.select("key", "length", "shingles", "held", "first", "last", each).withColumn("at", F.col("i") + F.col("first")).drop("i")


def _window_prints(positions: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """(key, length, at, kind, print) of the windows that hold enough shingles of items of their length."""
    known = wanted.select("hash", F.explode("lengths").alias("length")).withColumn("known", F.lit(1).cast("long"))
    rows = positions.join(_held(known, 64), ["hash", "length"], "left")
    before = F.lag("at").over(Window.partitionBy("key", "length", "hash").orderBy("at"))
    rows = rows.withColumn("known", F.coalesce("known", F.lit(0).cast("long"))).withColumn("enters", F.greatest("first", F.col("at") - F.col("shingles") + 1)).withColumn("before", before)
    event = lambda at, counts, distinct: F.struct(at.cast("int").alias("s"), F.lit(counts).cast("long").alias("c"), F.lit(distinct).cast("long").alias("d"))
    events = F.array(event(F.col("enters"), 1, 0), event(F.greatest("enters", F.coalesce(F.col("before") + 1, F.lit(0))), 0, 1), event(F.col("at") + 1, -1, -1))
    rows = rows.select("key", "length", "shingles", "held", "last", "hash", "known", F.explode(events).alias("e")).where(F.col("e.s") <= F.col("last"))
    facts = ["key", "length", "shingles", "held", "last"]
    names = [f"{k}{j}" for k in KINDS for j in range(len(LANES))] + [*KINDS, "hits"]
    rows = rows.select(*facts, F.col("e.s").alias("at"), F.col("e.c").alias("c"), F.col("e.d").alias("d"), "known", *_spread("hash"))
    sums = rows.groupBy(*facts, "at").agg(*_weighted("c", "d"), F.expr("sum(known * c)").alias("hits"))
    running = Window.partitionBy("key", "length").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*facts, "at", *[F.sum(c).over(running).alias(c) for c in names])
    return _prints(sums.where(F.col("hits") >= _needed(threshold)), ["key", "length", "at"])


def _near(windows: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(key, length, item_id, hamming): pairs of which two fingerprints of one kind are within the radius."""
    keyed = windows.select("key", "length", "kind", "print", F.explode(_block_values(F.col("print"), radius)).alias("b")).select("key", "length", "kind", "print", "b.block", "b.value")
    listed = prints.select("item_id", "length", "kind", F.col("print").alias("of"), F.explode(_block_values(F.col("print"), radius)).alias("b")).select("item_id", "length", "kind", "of", "b.block", "b.value")
    met = keyed.join(_held(listed, 80), ["length", "kind", "block", "value"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("of"))))
    return met.where(F.col("hamming") <= radius).groupBy("key", "length", "item_id").agg(F.min("hamming").alias("hamming"))


def _verified(positions: DataFrame, near: DataFrame, counted: DataFrame, threshold: float) -> DataFrame:
    """(key, item_id, window_start, window_words, similarity, hamming): the best window of each pair."""
    pair = ["key", "item_id", "length", "hamming", "shingles", "held", "first", "last"]
    shared = positions.join(near, ["key", "length"]).join(counted.select("item_id", "hash", "times"), ["item_id", "hash"])
    # all places of one shingle in one text's region
    places = shared.groupBy(*pair, "hash", "times").agg(F.sort_array(F.collect_list("at")).alias("places"))
    each = places.select(*pair, "times", "places", F.posexplode("places").alias("k", "at"))
    # place k counts as long as the window begins after place k - times
    after = F.when(F.col("k") >= F.col("times"), F.get("places", (F.col("k") - F.col("times")).cast("int")) + 1).otherwise(F.lit(0))
    enters = F.greatest("first", F.col("at") - F.col("shingles") + 1, after)
    events = F.array(F.struct(enters.alias("s"), F.lit(1).alias("d")), F.struct((F.col("at") + 1).alias("s"), F.lit(-1).alias("d")))
    each = each.select(*pair, F.explode(events).alias("e")).where(F.col("e.s") <= F.col("last"))
    steps = each.groupBy(*pair, F.col("e.s").alias("at")).agg(F.sum("e.d").alias("d"))
    running = Window.partitionBy("key", "item_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overlap = F.sum("d").over(running)
    scored = steps.select(*pair, "at", overlap.alias("overlap")).withColumn("similarity", F.col("overlap") / (F.col("shingles") + F.col("held") - F.col("overlap")))
    best = scored.where(F.col("similarity") >= threshold).groupBy("key", "item_id", "length", "hamming").agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"))).alias("b"))
    return best.select("key", "item_id", (-F.col("b.back")).alias("window_start"), F.col("length").alias("window_words"), F.col("b.similarity").alias("similarity"), "hamming")


def leaked_texts(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """(key, item_id, window_start, window_words, similarity, hamming) for each text, by its SHA-256, and item that it holds."""
    counted, prints = _item_tables(items, n)
    wanted = materialize(counted.groupBy("hash", "size").agg(F.collect_set("length").alias("lengths")), "wanted")
    source = docs.select(text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    regions = _regions(source, wanted, threshold, n)
    if regions is None:  # no items
        return docs.sparkSession.createDataFrame([], f"key string, item_id {counted.schema['item_id'].dataType.simpleString()}, window_start int, window_words int, similarity double, hamming int")
    regions = materialize(regions, "regions")
    positions = materialize(_positions(source, regions), "positions")
    near = materialize(_near(_window_prints(positions, wanted, threshold), prints, radius), "near")
    return materialize(_verified(positions, near, counted, threshold), "leaks")


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, window_start, window_words, similarity, hamming): the best window of each leaked item.

    docs has doc_id and text, items has item_id and text; other columns are ignored.
    """
    leaks = leaked_texts(docs, items, threshold, radius, n)
    found = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(_held(leaks, 150), "key")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("window_start")).alias("back"), F.col("window_words").alias("words"), "hamming")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("window_start"), F.col("b.words").alias("window_words"), F.col("b.similarity").alias("similarity"), F.col("b.hamming").alias("hamming"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose own text holds no item, with all their columns."""
    leaked = materialize(leaked_texts(docs, items, threshold).select("key").distinct(), "leaked")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, text_key(F.col("text")).alias("key"))
    return keyed.join(_held(leaked, 100), "key", "left_anti").select("row.*")
