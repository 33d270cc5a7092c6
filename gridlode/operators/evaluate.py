"""Extracted tables against ground truth: labels, columns, cells and whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .batches import listed, map_groups

LEAST_SCORE = 0.35


def label_token(label: Column) -> Column:
    """ASCII letters and digits of a label in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]", "")


def value_token(text: Column) -> Column:
    """A cell's text without white space, commas and currency signs, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s,$€£¥]", ""))


def loose_numbers(text: Column) -> Column:
    """All numbers of a text as doubles; a point may begin one, commas are no part of it."""
    found = F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), F.lit(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


def cell_matches(extracted: Column, number: Column, raw: Column, tolerance: float = 1e-3) -> Column:
    """Equal texts without blanks, the raw text inside the cell, or one of its numbers near enough (1e-3 or 1 %)."""
    bare = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))
    near = F.exists(loose_numbers(extracted), lambda x: F.abs(x - number) <= F.greatest(F.lit(tolerance), F.abs(number) * 0.01))
    there = F.trim(F.coalesce(extracted, F.lit(""))) != ""
    return F.coalesce(there & ((bare(extracted) == bare(raw)) | ((F.length(bare(raw)) >= 2) & F.contains(bare(extracted), bare(raw))) | near), F.lit(False))


def match_tables(scores: DataFrame) -> DataFrame:
    """(doc_id, truth_id, found_id, score) of scored pairs: in the order of truths each takes the best table that is left, from LEAST_SCORE on.

    A document's scored pairs are one small group; pairs below the least score are not shipped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}

    def run(pairs: list):
        by_truth: dict = {}
        for truth, found, score in pairs:
            by_truth.setdefault(truth, []).append((-score, found))
        used = set()
        for truth in sorted(by_truth):
            best = min((s for s in by_truth[truth] if s[1] not in used), default=None)
            if best:
                used.add(best[1])
                yield truth, best[1], -best[0]

    pairs = scores.select("doc_id", "truth_id", "found_id", F.col("score").cast("double").alias("score")).where((F.col("score") >= LEAST_SCORE) & F.col("truth_id").isNotNull())
    return map_groups(listed(spread(pairs, "doc_id"), ["doc_id"], ["truth_id", "found_id", "score"], "pairs"), ["doc_id"], ["pairs"], run, f"truth_id {kinds['truth_id']}, found_id {kinds['found_id']}, score double")


def column_map(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(table_id, want_idx, got_idx, how): which found column stands for a true one (table_id, col_idx, name).

    By equal clean names, else by equal leaves (after the last underscore), else by position.
    """
    clean = lambda c: value_token(c)
    leaf = lambda c: clean(F.substring_index(c, "_", -1))
    t = truth.select("table_id", F.col("col_idx").alias("want_idx"), clean(F.col("name")).alias("whole"), leaf(F.col("name")).alias("leaf"))
    f = found.select("table_id", F.col("col_idx").alias("got_idx"), clean(F.col("name")).alias("whole"), leaf(F.col("name")).alias("leaf"))
    # the found columns of a table are one array, and both sides are dealt by table over all tasks
    listed = spread(f, "table_id").groupBy("table_id").agg(F.collect_list(F.struct("got_idx", "whole", "leaf")).alias("found"))
    both = spread(t, "table_id").join(listed, "table_id", "left")
    first = lambda by: F.array_min(F.transform(F.filter("found", lambda x: (x[by] != "") & (x[by] == F.col(by))), lambda x: x["got_idx"]))
    place = F.when(F.exists("found", lambda x: x["got_idx"] == F.col("want_idx")), F.col("want_idx"))
    both = both.select("table_id", "want_idx", first("whole").alias("by_whole"), first("leaf").alias("by_leaf"), place.alias("by_place"))
    how = F.when(F.col("by_whole").isNotNull(), "name").when(F.col("by_leaf").isNotNull(), "leaf").when(F.col("by_place").isNotNull(), "place").otherwise("none")
    return both.select("table_id", "want_idx", F.coalesce("by_whole", "by_leaf", "by_place").alias("got_idx"), how.alias("how"))


def extraction_errors(truth: DataFrame, found: DataFrame, agreed: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tables, missed, truncated_rows, n_cells, n_wrong, value_error, false_agreements) of matched tables.

    truth: (doc_id, table_id, n_rows, n_cells, n_wrong); found: (doc_id, table_id, n_rows); agreed: (doc_id, table_id) that more than one
    extractor gave alike. A truncated table that was agreed on is a false agreement.
    """
    sure = (agreed.select("doc_id", "table_id").distinct() if agreed is not None else found.select("doc_id", "table_id").limit(0)).withColumn("sure", F.lit(True))
    got = found.groupBy("doc_id", "table_id").agg(F.max("n_rows").alias("got_rows"))
    both = truth.join(got, ["doc_id", "table_id"], "left").join(sure, ["doc_id", "table_id"], "left")
    lost = F.greatest(F.lit(0), F.col("n_rows") - F.coalesce("got_rows", F.lit(0)))
    gone = F.col("got_rows").isNull()
    wrong = F.when(gone, F.col("n_cells")).otherwise(F.col("n_wrong"))
    out = both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tables"), F.count_if(gone).alias("missed"), F.sum(lost).cast("long").alias("truncated_rows"), F.sum("n_cells").cast("long").alias("n_cells"), F.sum(wrong).cast("long").alias("n_wrong"), F.count_if(F.coalesce("sure", F.lit(False)) & ~gone & (lost > 0)).alias("false_agreements"))
    return out.withColumn("value_error", F.round(F.coalesce(F.try_divide("n_wrong", "n_cells"), F.lit(0.0)), 6))


def markdown_report(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, report): the rows of each group as a Markdown table in the order of the first column."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), " | "), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(columns[0]).alias("k"), line.alias("line")))).alias("lines"))
    return body.select(by, F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("report"))


def group_attributes(parts: DataFrame) -> DataFrame:
    """(group_id, page_idx, covered_pages, n_parts) of merged parts (group_id, page_idx): all pages in order, the first as its own."""
    pages = F.sort_array(F.collect_set("page_idx"))
    return parts.groupBy("group_id").agg(pages.alias("covered_pages"), F.count(F.lit(1)).alias("n_parts")).select("group_id", F.element_at("covered_pages", 1).alias("page_idx"), "covered_pages", "n_parts")


def custom_headers(headers: DataFrame, names: list[str]) -> DataFrame:
    """Headers (table_id, col_idx, name) with the given names; columns beyond them become Col0, Col1, ... by their place."""
    given = F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("col_idx").cast("int"))
    return headers.withColumn("name", F.coalesce(given, F.concat(F.lit("Col"), F.col("col_idx"))))


def select_tables(tables: DataFrame, which: str | int) -> DataFrame:
    """Tables (doc_id, table_idx, …): ``all``, the ``first`` of each document, or the one of that place."""
    if which == "all":
        return tables
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_idx"))
    return tables.withColumn("_place", place).where(F.col("_place") == (1 if which == "first" else int(which) + 1)).drop("_place")


def expected_labels(lines: DataFrame) -> DataFrame:
    """(doc_id, label, first_line, n_lines): each label that caption lines (doc_id, line_no, line, is_caption) declare."""
    from ..functions.text import canonical_label, find_label

    found = lines.where("is_caption").select("doc_id", "line_no", canonical_label(find_label(F.col("line"))).alias("label")).where("label <> ''")
    # a label in two languages is one table
    number = F.regexp_replace(F.lower("label"), "^(?:table|表) *", "")
    return found.withColumn("_n", number).groupBy("doc_id", "_n").agg(F.min_by("label", "line_no").alias("label"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines")).drop("_n")


def page_of_table(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """Adds page_idx to recognised tables (doc_id, table_idx, label): the page of the caption with that label, else of the caption of the same place in order."""
    by_label = captions.where("label <> ''").groupBy("doc_id", "label").agg(F.min("page_idx").alias("_labelled"))
    place = lambda by: F.row_number().over(Window.partitionBy("doc_id").orderBy(*by))
    ordered = captions.withColumn("_place", place(("page_idx", "line_no"))).select("doc_id", "_place", F.col("page_idx").alias("_ordered"))
    both = tables.withColumn("_place", place(("table_idx",))).join(by_label, ["doc_id", "label"], "left").join(ordered, ["doc_id", "_place"], "left")
    return both.select(*tables.columns, F.coalesce("_labelled", "_ordered").alias("page_idx"))


def subset_pages(tables: DataFrame, subsets: DataFrame) -> DataFrame:
    """Page numbers of tables (doc_id, page_idx, …) found in a subset of pages, as those of the whole document: ``pages`` lists the subset's.

    A document of which a page number is beyond the subset's length has whole numbers already.
    """
    both = tables.join(subsets.select("doc_id", "pages"), "doc_id", "left")
    whole = F.max(F.col("page_idx") >= F.size("pages")).over(Window.partitionBy("doc_id"))
    relative = F.col("pages").isNotNull() & ~F.coalesce(whole, F.lit(True))
    return both.withColumn("_relative", relative).withColumn("page_idx", F.when(F.col("_relative"), F.get("pages", F.col("page_idx").cast("int"))).otherwise(F.col("page_idx"))).drop("pages", "_relative")


def area_ratio(a: str, b: str) -> Column:
    """Larger over smaller area of two boxes (columns under the given prefixes); infinite without one of them."""
    area = lambda p: F.greatest(F.lit(1e-6), F.abs(F.col(f"{p}.x1") - F.col(f"{p}.x0")) * F.abs(F.col(f"{p}.y1") - F.col(f"{p}.y0")))
    given = F.lit(True)
    for p in (a, b):
        for c in ("x0", "y0", "x1", "y1"):
            given = given & F.col(f"{p}.{c}").isNotNull()
    return F.when(given, F.greatest(area(a), area(b)) / F.least(area(a), area(b))).otherwise(F.lit(float("inf")))


def table_tokens(cells: DataFrame, headers: DataFrame, reversed_too: bool = False) -> DataFrame:
    """(table_id, token): distinct lower-case pieces of names and cells, cut at white space, slashes, bars, commas and semicolons."""
    names = headers.where(~F.trim("name").rlike(r"(?i)^(?:unnamed: *[0-9]+|col_?[0-9]+|[0-9]+)$")).select("table_id", F.col("name").alias("text"))
    texts = cells.where(~F.lower(F.trim(F.coalesce("text", F.lit("")))).isin("nan", "none", "null")).select("table_id", "text")
    # pieces are distinct before names and cells meet
    pieces = lambda df: df.select("table_id", F.explode(F.split(F.lower("text"), r"[\s/|,;]+")).alias("token")).where("token <> ''").distinct()
    out = spread(pieces(texts).union(pieces(names)), "table_id")
    if reversed_too:
        out = out.union(out.where(F.length("token") >= 2).select("table_id", F.reverse("token")))
    return out.distinct()


def degraded_matches(containments: DataFrame) -> DataFrame:
    """Adds matches to (…, n_forth, forth, n_back, back, same_label): whether a garbled table is a clean one's version.

    Three tokens or more, of which 55 % (garbled in clean) or 65 % (clean in garbled) are contained; 50 % either way under one label.
    """
    forth, back = (F.col("n_forth") >= 3) & (F.col("forth") >= 0.55), (F.col("n_back") >= 3) & (F.col("back") >= 0.65)
    labelled = F.col("same_label") & (F.col("n_back") >= 3) & (F.greatest("forth", "back") >= 0.50)
    return containments.withColumn("matches", forth | back | labelled)


def index_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx): first rows that only number the columns, like (1) (2) (3); brackets must be there, blanks must not."""
    s = F.trim(F.coalesce("text", F.lit("")))
    number = F.regexp_extract(s, r"^[(\[]\s*([0-9]{1,6})\s*[)\]]$|^([0-9]{1,6})(?:\.0+)?$", 1)
    plain = F.regexp_extract(s, r"^([0-9]{1,6})(?:\.0+)?$", 1)
    n = F.coalesce(F.nullif(number, F.lit("")), F.nullif(plain, F.lit(""))).cast("int")
    off = n - F.col("col_idx")
    rows = cells.where("row_idx = 0").groupBy("table_id", "row_idx").agg(F.count(F.lit(1)).alias("n"), F.count(n).alias("numbers"), F.max(number != "").alias("bracketed"), F.min(off).alias("low"), F.max(off).alias("high"))
    return rows.where("n >= 3 AND numbers = n AND bracketed AND low = high AND low IN (0, 1)").select("table_id", "row_idx")


def names_with_probing(headers: DataFrame) -> DataFrame:
    """(table_id, col_idx, name): repeats get _1, _2, ... and skip names that are taken. A table's names are one small array."""
    named = headers.withColumn("name", F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.concat(F.lit("Col_"), F.col("col_idx") + 1)).otherwise(F.col("name")))
    listed = named.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("col_idx", "name"))).alias("cols"))

    def add(taken: Column, col: Column) -> Column:
        tries = F.concat(F.array(col["name"]), F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.concat_ws("_", col["name"], k.cast("string"))))
        return F.concat(taken, F.slice(F.filter(tries, lambda t: ~F.array_contains(taken, t)), 1, 1))

    names = F.aggregate("cols", F.array().cast("array<string>"), add)
    return listed.select("table_id", F.explode(F.zip_with("cols", names, lambda c, n: F.struct(c["col_idx"].alias("col_idx"), n.alias("name")))).alias("c")).select("table_id", "c.col_idx", "c.name")


def label_collisions(tables: DataFrame) -> DataFrame:
    """Adds action to tables (doc_id, label, table_idx, page_idx, is_continuation, columns, cells, priority): what a second one of a label becomes.

    Against the label's first table: a continuation is combined; two pages or more apart it gets a name with its page; with other columns (overlap under one half)
    it is a version of its own; else the one with more cells stays, and of equals the one of the higher priority.
    """
    first = Window.partitionBy("doc_id", "label").orderBy("page_idx", "table_idx")
    keep = lambda c: F.first(c).over(first)
    shared = F.size(F.array_intersect("columns", keep("columns"))) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct("columns")), F.size(F.array_distinct(keep("columns")))))
    better = F.struct("cells", "priority") > F.struct(keep("cells"), keep("priority"))
    action = (
        F.when((F.row_number().over(first) == 1) | (F.col("label") == ""), "keep").when(F.col("is_continuation"), "combine").when(F.col("page_idx") - keep("page_idx") >= 2, "page_name")
        .when(shared < 0.5, "version").when(better, "replace").otherwise("drop")
    )
    return tables.withColumn("action", action)
