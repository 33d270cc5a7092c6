"""Secret scanning in DataFrame expressions: base patterns and sliding-window entropy.

Base kinds, leftmost and non-overlapping for each kind: assign (a keyword, a separator and a value of 12 characters or
more), access (AKIA and 14 characters or more), hex (16 or more). A run of a class is matched whole, so for access and
hex a least length in the pattern says the same as dropping short matches afterwards; an assignment's value is
measured after the match, because a short match uses up its text.

The method adds kind entropy: candidate strings of 20 characters or more of one run; for the narrowest character class
that holds the whole candidate, a window of 20 characters moves over it. Counts change by one character in and one
out, and with them the sum of c * log2(c). The counts are packed in a few longs, five bits each, so a step costs two
additions and no recount, whatever the alphabet. A candidate is reported if some
window reaches its class's threshold, unless the allow-list suppresses it. Base findings are never suppressed.

Positions are code points, end exclusive. Positions come from one pass: matches are fenced with a private-use mark,
the text is split there and lengths are summed up, block by block, so that many findings cost no more each than few. A mark that occurs in the text is first replaced by its neighbour,
which no pattern can match either.

Defined results: null and empty texts have no findings; long texts are scanned whole; rows that repeat a doc_id are
scanned one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, OTHER = "\ue000", "\ue001"
WINDOW = 20
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, what a match must satisfy)
BASE = {
    "assign": (_ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 12),
    "access": (r"AKIA[A-Z0-9]{14,}", lambda m: F.lit(True)),
    "hex": (r"[0-9a-f]{16,}", lambda m: F.lit(True)),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class -> (all of the candidate, alphabet, bits a window must reach); the first that fits is used
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 2.9),
    "alphanumeric": (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.6),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
}
#: Candidates that are no secrets: plain numbers, UUIDs, placeholders. Words joined by dashes, underscores or slashes are
#: another: what is left without the words has no letter or digit (no repeated group, so long candidates need no deep stack).
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
    r"(?i:example|changeme|placeholder|dummy|lorem|xxxx|0123456789|abcdefghij)",
)
_PLAIN_WORD = r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?![A-Za-z0-9])"
_FINDING = "array<struct<start:int,end:int,kind:string,text:string>>"


def running_sums(lengths: Column, block: int = 128) -> Column:
    """Sum of the first 1, 2, ... numbers of an array, in blocks: arrays grow by ``block`` at most while they are summed."""
    grow = lambda numbers: F.aggregate(numbers, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    local = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(block)), lambda k: grow(F.slice(lengths, k, block)))
    before = lambda blocks: grow(F.transform(blocks, lambda sums: F.element_at(sums, -1)))
    joined = lambda blocks: F.flatten(F.zip_with(blocks, F.slice(before(blocks), 1, F.size(blocks)), lambda sums, n: F.transform(F.slice(sums, 2, block), lambda x: x + n)))
    return F.aggregate(F.array(local), F.array().cast("array<int>"), lambda _, blocks: joined(blocks))


def _matches(text: Column, kind: str, pattern: str, good) -> Column:
    """Findings of one kind: array<struct<start, end, kind, text>>."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)

    def findings(pieces: Column) -> Column:
        # every second piece is a match
        ends = running_sums(F.transform(pieces, lambda p: F.length(p)))
        zipped = F.zip_with(pieces, ends, lambda p, end: F.struct((end - F.length(p)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p.alias("text")))
        return F.filter(zipped, lambda f, k: (k % 2 == 1) & good(f["text"]))

    # an aggregate over one array binds the pieces, so that they are computed once
    return F.when(text.rlike(pattern), F.aggregate(F.array(pieces), F.array().cast(_FINDING), lambda _, found: findings(found))).otherwise(F.array().cast(_FINDING))


#: Five bits hold a count up to WINDOW; so many counts are packed in a long.
COUNT_BITS, A_LONG = 5, 12


def window_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of any ``window`` (31 at most) characters of ``text``, by incremental counts."""
    chars = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    longs = range(-(-len(alphabet) // A_LONG))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in longs], F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("seen"))
    place = lambda c: F.struct(F.floor(c / A_LONG).cast("int").alias("long"), (F.pmod(c, F.lit(A_LONG)) * COUNT_BITS).alias("shift"))
    pairs = F.zip_with(chars, F.concat(F.array_repeat(F.lit(-1), window), chars), lambda new, old: F.struct(new.alias("new"), place(new).alias("to"), old.alias("old"), place(old).alias("off")))
    pairs = F.filter(pairs, lambda p: p["new"].isNotNull())
    weight = lambda n: F.get(weights, n)
    shifted = lambda number, shift: F.call_function("shiftleft", F.lit(number).cast("long"), shift)

    def count(s: Column, at: Column) -> Column:
        chosen = s["c0"]
        for k in longs[1:]:
            chosen = F.when(at["long"] == k, s[f"c{k}"]).otherwise(chosen)
        return F.call_function("shiftrightunsigned", chosen, at["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")

    def step(s: Column, p: Column) -> Column:
        leaves = p["old"] >= 0
        gone = F.when(leaves, count(s, p["off"])).otherwise(F.lit(0))
        there = count(s, p["to"]) - (p["old"] == p["new"]).cast("int")
        less = F.when(leaves, weight(gone - 1) - weight(gone)).otherwise(F.lit(0.0))
        total = s["sum"] + less + weight(there + 1) - weight(there)
        none = F.lit(0).cast("long")
        counts = [(s[f"c{k}"] + F.when(p["to"]["long"] == k, shifted(1, p["to"]["shift"])).otherwise(none) - F.when(leaves & (p["off"]["long"] == k), shifted(1, p["off"]["shift"])).otherwise(none)).alias(f"c{k}") for k in longs]
        seen = s["seen"] + 1
        bits = F.when(seen >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        return F.struct(*counts, total.alias("sum"), F.greatest(s["best"], bits).alias("best"), seen.alias("seen"))

    return F.aggregate(pairs, zero, step, lambda s: s["best"])


def _random(candidate: Column) -> Column:
    suppressed = ~F.regexp_replace(candidate, _PLAIN_WORD, "").rlike("[A-Za-z0-9]")
    for pattern in ALLOWED:
        suppressed = suppressed | candidate.rlike(pattern)
    reached = None
    for fits, alphabet, bits in CLASSES.values():
        high = window_entropy(candidate, alphabet) >= bits
        reached = F.when(candidate.rlike(fits), high) if fits and reached is None else (reached.when(candidate.rlike(fits), high) if fits else reached.otherwise(high))
    return F.when(suppressed, F.lit(False)).otherwise(reached)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, findings: array<struct<start, end, kind, text>> by start and kind) for each row of ``docs``."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    kinds = [_matches(F.col("text"), kind, pattern, good) for kind, (pattern, good) in BASE.items()] + [_matches(F.col("text"), "entropy", CANDIDATE, _random)]
    # by start, then kind as listed: a stable order from the (start, number of the kind) in front
    order = {k: i for i, k in enumerate([*BASE, "entropy"])}
    ranked = [F.transform(found, lambda f, k=k: F.struct(f["start"].alias("start"), F.lit(k).alias("rank"), f["end"].alias("end"), f["kind"].alias("kind"), f["text"].alias("text"))) for k, found in zip(order.values(), kinds, strict=True)]
    found = docs.select("doc_id", text.alias("text")).select("doc_id", F.array_sort(F.concat(*ranked)).alias("findings"))
    return found.select("doc_id", F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind"), f["text"].alias("text"))).alias("findings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    label = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("findings", lambda f: f["kind"] != "entropy"), label), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("findings", label), ",").alias("spans"))
