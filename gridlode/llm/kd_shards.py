"""Sharding by a K-d tree over document metadata.

The points are groups of equal texts (so copies share a shard), with dimensions taken from the group: language and
source as hashed codes, and size. A node that must give k shards is split at the weighted median
(more exactly: at floor(k / 2) / k of its bytes) along its widest dimension, until each leaf is one shard, whose bytes
are then the target (shards = bytes / target, see ``shards_for``). Widths compare dimensions on one scale: the share of
the node's bytes outside the largest group of equal values, so a dimension in which nothing can be cut has width 0.

Medians are distributed. A point's place in a dimension is a 62-bit key: the dimension's value in the upper bits and the
text's hash in the lower, so that ties are cut too. A level of the tree is one pass that sums bytes by (node, dimension,
value), which gives widths and the value in which each median lies, and three passes that narrow the median down inside its value,
SLICE_BITS bits each. Sums are added up by windows over the sums; the driver gets three rows for each node.

A group of more than OVERSIZE of a shard's target is cut into its documents, in the order of doc_id hashes, because
shards could not come out even otherwise. Slots are gapless within a shard: rows are counted in (shard, part) cells of
bounded size, and a cell's rows are numbered after the cells before it.

Defined results: null text has size 1 and the checksum of the empty text; null lang and source are values of their own;
repeated rows are rows of their own; fewer groups than shards leave shards empty; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .skew import join_counted
from .store import materialize, tidy

SHARDS = 8
SLICE_BITS = 14
OVERSIZE = 0.5
SLOT_ROWS = 100_000
KEY_BITS, VALUE_BITS = 62, 20
DIMENSIONS = ("d_lang", "d_source", "d_size")


def _points(docs: DataFrame, shards: int) -> DataFrame:
    """One row a document: doc_id, size, crc, hash, group's dimensions, all fixed-width."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    rows = materialize(rows, "rows")
    groups = rows.groupBy("h", "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("lang").alias("g_lang"), F.min("source").alias("g_source"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    whole = F.col("copies") * F.col("size") <= OVERSIZE * total / shards
    positive = lambda c: F.shiftrightunsigned(c, 1)
    low = F.when(whole, positive("h")).otherwise(positive(F.xxhash64("h", "doc_id")))
    code = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
    value = {
        "d_lang": F.shiftright(code("g_lang"), 63 - VALUE_BITS),
        "d_source": F.shiftright(code("g_source"), 63 - VALUE_BITS),
        "d_size": F.least(F.floor(F.log2(F.col("size").cast("double")) * 16), F.lit((1 << VALUE_BITS) - 1)).cast("long"),
    }
    out = join_counted(rows, materialize(groups, "groups"), ["h", "text_crc32", "size"], "copies", rows.count()).select("doc_id", "size", "text_crc32", low.alias("low"), *[v.alias(k) for k, v in value.items()])
    return materialize(out, "points")


def _key(dimension: str) -> Column:
    """62 bits: VALUE_BITS of the value, the others of the text's hash."""
    return F.shiftleft(F.col(dimension), KEY_BITS - VALUE_BITS) + F.shiftright(F.col("low"), 63 - (KEY_BITS - VALUE_BITS))


def _chosen_key() -> Column:
    """The key in the dimension that ``dimension`` numbers."""
    out = _key(DIMENSIONS[0])
    for k, d in enumerate(DIMENSIONS[1:], 1):
        out = F.when(F.col("dimension") == k, _key(d)).otherwise(out)
    return out


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers as a table of the plan: no Python on the executors."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    listed = ", ".join("struct(" + ", ".join(f"CAST({v} AS {kind}) AS {name}" for v, name, kind in zip(row, names, kinds, strict=True)) + ")" for row in rows)
    return spark.range(1).select(F.expr(f"inline(array({listed}))"))


def place(points: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """``points`` with ``node``: a join with each level's cuts (node, dimension, at, left, right), which are fewer than the shards."""
    placed = points.withColumn("node", F.lit(0))
    for level in levels:
        cuts = _rows(points.sparkSession, level, "node int, dimension int, at long, left_node int, right_node int")
        side = F.when(_chosen_key() >= F.col("at"), F.col("right_node")).otherwise(F.col("left_node"))
        joined = placed.join(F.broadcast(cuts), "node", "left")
        placed = joined.select(*points.columns, F.when(F.col("at").isNull(), F.col("node")).otherwise(side).alias("node"))
    return placed


def _first_reaching(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Of sums (keys, slot, b, want) the first slot at which the running sum reaches ``want``: (keys, all, top, slot, before, b)."""
    running = F.sum("b").over(Window.partitionBy(*keys).orderBy("slot"))
    reached = F.col("through") >= F.col("want")
    at = F.struct("slot", (F.col("through") - F.col("b")).alias("before"), "b")
    out = sums.withColumn("through", running).groupBy(*keys).agg(F.sum("b").alias("all"), F.max("b").alias("top"), F.min(F.when(reached, at)).alias("at"))
    return out.select(*keys, "all", "top", "at.slot", "at.before", "at.b")


def _cuts(placed: DataFrame, due: dict[int, int]) -> list[tuple[int, int, int]]:
    """(node, dimension, at) for each node that has points: the left side gets its share of bytes as nearly as can be."""
    spark = placed.sparkSession
    shares = _rows(spark, list(due.items()), "node int, k int")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(d).alias("slot")) for k, d in enumerate(DIMENSIONS)])).alias("p")
    sums = placed.join(F.broadcast(shares), "node").select("node", "k", "size", each).groupBy("node", "k", "p.dimension", "p.slot").agg(F.sum("size").alias("b"))
    total = F.sum("b").over(Window.partitionBy("node", "dimension"))
    sums = sums.withColumn("want", F.expr("CAST(floor(k / 2) AS bigint)") * total).withColumn("want", F.expr("want div k"))
    found: dict[int, dict] = {}
    for r in _first_reaching(sums, ["node", "dimension"]).collect():  # three rows a node
        width = 1 - r["top"] / r["all"]
        if r["node"] not in found or (width, -r["dimension"]) > (found[r["node"]]["width"], -found[r["node"]]["dimension"]):
            want = r["all"] * (due[r["node"]] // 2) // due[r["node"]]
            found[r["node"]] = {"width": width, "dimension": r["dimension"], "slot": r["slot"], "want": want - r["before"], "b": r["b"]}
    for known in range(KEY_BITS - VALUE_BITS, 0, -SLICE_BITS):
        if not found:
            break
        asked = _rows(spark, [(n, f["dimension"], f["slot"], f["want"]) for n, f in found.items()], "node int, dimension int, prefix long, want long")
        keyed = placed.join(F.broadcast(asked), "node").withColumn("key", _chosen_key()).where(F.shiftright("key", known) == F.col("prefix"))
        sums = keyed.groupBy("node", "want", F.shiftright("key", known - SLICE_BITS).alias("slot")).agg(F.sum("size").alias("b"))
        for r in _first_reaching(sums, ["node"]).collect():
            f = found[r["node"]]
            f["slot"], f["want"], f["b"] = r["slot"], f["want"] - r["before"], r["b"]
    # a single key is left: it goes to the nearer side of the cut
    return [(n, f["dimension"], f["slot"] + int(f["b"] - f["want"] <= f["want"])) for n, f in found.items()]


def kd_tree(points: DataFrame, shards: int = SHARDS) -> tuple[list[list[tuple]], list[int]]:
    """The cuts of each level (points with key >= at go right) and the leaves from left to right. The root is 0."""
    levels: list[list[tuple]] = []
    due, names = {0: shards}, 0
    below: dict[int, tuple[int, int]] = {}
    while any(k > 1 for k in due.values()):
        tidy(points.sparkSession)
        level = []
        open_ = {n: k for n, k in due.items() if k > 1}
        cut = {n: (d, at) for n, d, at in _cuts(place(points, levels), open_)}
        for n, k in open_.items():
            dimension, at = cut.get(n, (0, 0))  # a node without points
            level.append((n, dimension, at, names + 1, names + 2))
            below[n] = (names + 1, names + 2)
            due[names + 1], due[names + 2] = k // 2, k - k // 2
            names += 2
            del due[n]
        levels.append(level)

    def leaves(node: int) -> list[int]:
        return [x for side in below[node] for x in leaves(side)] if node in below else [node]

    return levels, leaves(0)


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """How many shards of about ``target_bytes`` (a text's UTF-8 bytes and 1 each) the documents make."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    return max(1, -(-total // target_bytes))


def _slots(rows: DataFrame, total: int) -> DataFrame:
    """Adds slot: 0, 1, ... within a shard, without sorting a shard in one task."""
    parts = max(1, -(-total // SLOT_ROWS))
    cell = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    counts = cell.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return cell.withColumn("place", place).join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long")).drop("part", "place", "before")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs`` (doc_id, text, lang, source; others ignored)."""
    spark, points = docs.sparkSession, _points(docs, shards)
    levels, leaves = kd_tree(points, shards)
    names = _rows(spark, [(n, i) for i, n in enumerate(leaves)], "node int, shard int")
    placed = place(points, levels).join(F.broadcast(names), "node").select("doc_id", "size", "text_crc32", "shard")
    placed = materialize(placed, "placed")
    return _slots(placed, placed.count())


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage_shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with the number of their shard in ``shard`` (a column of that name is replaced)."""
    done = shard(docs, shards).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("shard"))
    given = [c for c in docs.columns if c != "shard"]
    row = F.struct(*[F.col(c) for c in given]).alias("row")
    keyed = docs.select(row, F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"))
    joined = keyed.alias("l").join(done.alias("r"), F.expr("l.row.doc_id <=> r.doc_id and l.crc = r.text_crc32"), "left")
    return joined.select("l.row.*", F.col("r.shard").alias("shard"))
