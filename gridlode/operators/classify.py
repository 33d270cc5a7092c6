"""Classifiers with many rules: one wide profile by aggregation, then an ordered CASE that says the reason."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LABEL, NUMBER, is_data_value

# Words of article front matter and reference lists, and those of them that suffice alone.
FRONT_WORDS = (
    "收稿日期", "基金项目", "作者简介", "通信作者", "通讯作者", "中图分类号", "文献标志码", "文献标识码", "文章编号", "文献信息", "作者信息", "journal info", "copyright", "conflict of interest",
    "author", "authors", "email", "e-mail", "affiliation", "affiliations", "correspondence", "orcid", "contributor", "contributors", "doi", "published date", "publication date", "citation info", "document details",
    "题名", "出版机构", "出版年", "doi码", "注册时间", "同方知网", "link.cnki.net", "kns.cnki.net", "中国知网", "手机知网", "以下是您获得的url地址",
    "摘要", "关键词", "版权", "目录", "outline", "table of contents", "点击次数", "下载次数", "引用次数", "被引次数", "摘要点击", "全文链接",
)
FRONT_STRONG = ("收稿日期", "基金项目", "作者简介", "通信作者", "通讯作者", "中图分类号", "文献标志码", "文献标识码", "文章编号", "同方知网", "link.cnki.net", "kns.cnki.net", "以下是您获得的url地址")
FRONT_WEAK = tuple(w for w in FRONT_WORDS if w not in FRONT_STRONG)
CARD_NAMES = ("title", "authors", "journal", "volume", "issue", "date", "pages", "published date", "doi", "publisher")


def _has_word(text: Column, word: str) -> Column:
    # most cells lack the word's first letters, which is quicker to see than to search for the word
    return text.contains(re.split(r"\W", word)[0]) & text.rlike(rf"\b{word}\b") if word.isascii() else text.contains(word)


def metadata_tables(cells: DataFrame, headers: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(table_id, reason): why a table is front matter, a reference list, an index or prose; ``data`` if none of these.

    ``labels`` is (table_id, label): tables with a label are not taken for prose. All rules see the whole table.
    """
    # one number says which words were seen; a cell without any of them is not searched for each
    words = F.array(*[F.when(_has_word(F.col("low"), w), F.lit(1 << i).cast("long")) for i, w in enumerate(FRONT_WEAK)])
    cells = cells.select("table_id", "row_idx", "col_idx", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("low")).withColumn("found", F.when(reduce(or_, [F.col("low").contains(re.split(r"\W", w)[0]) for w in FRONT_WEAK]), F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.coalesce(x, F.lit(0).cast("long"))))))
    low, has = F.col("low"), ~F.col("low").isin("", "nan", "none")
    prose = low.rlike("[。；！？]") | ((F.length(low) > 30) & low.contains(" ") & low.rlike("[.;]"))
    number = low.rlike("[0-9]")
    strong_row = F.lit(False)
    for w in FRONT_STRONG:
        strong_row = strong_row | low.contains(w)
    body = cells.groupBy("table_id").agg(
        (F.max("row_idx") + 1).alias("rows"), (F.max("col_idx") + 1).alias("cols"), F.count_if(has).alias("filled"), F.count_if(has & prose).alias("prose"), F.count_if(has & number).alias("numbers"),
        F.max(F.length(low)).alias("longest"), F.sum(F.when(has, F.length(low))).alias("chars"), F.count_distinct(F.when(strong_row, F.col("row_idx"))).alias("strong_rows"),
        F.count_if((F.col("col_idx") == 0) & low.rlike(r"^\[[0-9]+\]")).alias("cited"), F.count_if((F.col("col_idx") == 0) & has).alias("firsts"), F.sum(F.regexp_count(low, F.lit(r"\b(?:19|20)[0-9]{2}\b"))).alias("years"),
        F.sum(F.regexp_count(low, F.lit(r"\bet\s+al\.|\bpp\.|\bvol\.|\bjournal\b|\bthesis\b"))).alias("citations"), F.count_if(has & is_data_value(low)).alias("values"),
        F.max(low.rlike(r"table\s*s[0-9]+\s*[:：-]").cast("int")).alias("toc_a"), F.max(low.rlike(r"supplementary\s+table\s*[0-9]+\s*[:：-]").cast("int")).alias("toc_b"), F.max(low.rlike(r"description\s+of\s+(?:samples|table)").cast("int")).alias("toc_c"),
        F.max(F.when((F.col("row_idx") < 2) & (F.length(low) >= 15), low.rlike(r"^(?:fig(?:ure|\.)?|图\s*[0-9]+|plate\s*[0-9]+|photo\s*[0-9]+)\s*[:.\s0-9]").cast("int"))).alias("figure"), F.bit_or("found").alias("found"),
    )
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    strong_name, weak_names = F.lit(False), F.lit(0)
    for w in FRONT_STRONG:
        strong_name = strong_name | name.contains(w)
    for w in FRONT_WEAK:
        weak_names = weak_names + _has_word(name, w).cast("int")
    one_of = lambda *words: F.max(name.isin(*words))
    head = headers.groupBy("table_id").agg(
        F.max(strong_name).alias("strong_name"), F.sum(weak_names).alias("weak_names"), F.count_distinct(F.when(name.isin(*CARD_NAMES), name)).alias("card"), one_of("作者").alias("h_author"), one_of("单位", "机构", "affiliation", "email", "e-mail").alias("h_unit"),
        one_of("author", "authors", "name").alias("h_name"), one_of("affiliation", "affiliations", "lead role", "supporting role").alias("h_aff"), one_of("email", "e-mail", "correspondence").alias("h_mail"), one_of("filename", "file name").alias("h_file"),
        one_of("description", "file size", "page count").alias("h_size"), F.count_if((name != "") & ~name.rlike(r"^(?:[0-9]+|col.*|unnamed.*)$")).alias("named"),
    )
    t = body.join(head, "table_id", "left")
    t = t.join(labels.select("table_id", (F.col("label") != "").alias("labelled")), "table_id", "left") if labels is not None else t.withColumn("labelled", F.lit(False))
    t = t.na.fill(False).na.fill(0)
    weak_hits = F.bit_count("found")
    c = F.col
    prose_share, number_share = c("prose") / F.greatest(F.lit(1), c("filled")), c("numbers") / F.greatest(F.lit(1), c("filled"))
    reason = (
        F.when((c("h_author") & c("h_unit")) | (c("h_name") & c("h_aff") & c("h_mail")), "authors").when((c("card") >= 4) & (c("rows") <= 3), "citation_card").when(c("h_file") & c("h_size"), "file_list")
        .when(c("strong_name") | ((c("weak_names") >= 2) & ((c("rows") <= 3) | (c("numbers") == 0))), "front_matter")
        .when(~c("labelled") & (c("cols") <= 2) & (c("rows") <= 3) & (c("figure") == 1), "figure_caption")
        .when(((c("years") >= 5) | (c("citations") >= 3)) & (c("rows") >= 4) & (c("cols") <= 3) & ~c("labelled") & (c("values") < 0.15 * c("rows") * c("cols")), "references")
        .when((c("rows") >= 3) & (c("cols") >= 2) & ~c("labelled") & (((prose_share >= 0.40) & ((number_share < 0.15) | (c("cols") <= 2))) | ((prose_share > 0.25) & (number_share < 0.15))), "prose")
        .when((c("strong_rows") >= 1) & ((c("rows") <= 3) | (c("strong_rows") * 2 >= F.least(c("rows"), F.lit(8)))), "front_matter").when((weak_hits >= 3) & ~c("labelled") & ((c("rows") <= 3) | (c("numbers") == 0)), "front_matter")
        .when((c("firsts") > 2) & (c("cited") * 2 > c("firsts")), "references").when((c("cols") <= 3) & (c("rows") >= 3) & (c("toc_a") + c("toc_b") + c("toc_c") >= 2), "index")
        .when((c("rows") <= 1) & (c("cols") <= 1), "single_cell").when((c("rows") <= 3) & (c("cols") <= 2) & (c("numbers") == 0) & (c("longest") > 30), "prose").otherwise("data")
    )
    return t.select("table_id", reason.alias("reason"))


# Header words that betray text that was read backwards.
_FORWARD = (
    "sample", "table", "total", "mean", "depth", "element", "elements", "ratio", "error", "value", "values", "group", "method", "source", "location", "station", "rock", "mineral", "isotope", "grade", "level", "index", "count",
    "weight", "mass", "temp", "time", "date", "year", "area", "type", "unit", "note", "notes", "age", "ppm", "ppb",
)


def read_backwards(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, backwards): at least two words are reversed header words or reversed title case."""
    texts = cells.select("table_id", "text").unionByName(headers.where(~F.col("name").rlike(r"(?i)^(?:unnamed.*|col_?[0-9]+|[0-9]+)$")).select("table_id", F.col("name").alias("text")))
    words = texts.select("table_id", F.explode(F.split(F.trim(F.coalesce("text", F.lit(""))), r"[\s/|,;]+")).alias("w")).where(F.col("w").rlike("[A-Za-z]"))
    low = F.lower("w")
    hit = F.col("w").rlike(r"^[a-z]{3,}[A-Z]$") | low.rlike(r"^(?:mpp|bpp)_") | ((F.length(low) >= 4) & ~low.isin(*_FORWARD) & F.reverse(low).isin(*_FORWARD))
    out = words.groupBy("table_id").agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return out.select("table_id", ((F.col("hits") >= 2) | ((F.col("hits") == 1) & (F.col("n") <= 3))).alias("backwards"))


# Words of summary rows.
SUMMARY_WORDS = ("total", "mean", "avg", "average", "sum", "min", "max", "sd", "std", "median", "n", "count", "note", "notes", "source", "合计", "总计", "平均", "均值", "小计", "注", "备注")


def _cell_kind(s: Column) -> Column:
    """number, summary, word or other."""
    number = F.translate(F.regexp_replace(s, "%$", ""), ",", "").rlike(rf"^[-+]?{NUMBER}$")
    return F.when(number, "number").when(F.lower(s).isin(*SUMMARY_WORDS), "summary").when(s.rlike("[A-Za-z一-龥]"), "word").otherwise("other")


def upside_down(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, upside_down): numbers for names, and names in the last row.

    At least half of two or more real names are numbers (or none of the names is a word), and the last of two or more rows has words
    in at least half of two or more cells and no number. One count of kinds by table and side.
    """
    last = F.max("row_idx").over(Window.partitionBy("table_id"))
    bottom = cells.withColumn("last", last).where((F.col("row_idx") == F.col("last")) & (F.col("last") >= 1)).select("table_id", F.lit("row").alias("side"), F.trim(F.coalesce("text", F.lit(""))).alias("s"))
    bottom = bottom.where(~F.lower("s").isin("", "nan", "none", "-", "—"))
    names = headers.select("table_id", F.lit("name").alias("side"), F.trim(F.coalesce("name", F.lit(""))).alias("s")).where((F.col("s") != "") & ~F.col("s").rlike(r"(?i)^(?:unnamed.*|col_?[0-9]+)$"))
    n = lambda side, *kinds: F.count_if((F.col("side") == side) & (F.col("kind").isin(*kinds) if kinds else F.lit(True)))
    both = names.unionByName(bottom).withColumn("kind", _cell_kind(F.col("s")))
    counts = both.groupBy("table_id").agg(n("name").alias("names"), n("name", "number").alias("numbers"), n("name", "word", "summary").alias("words"), n("row").alias("cells"), n("row", "number").alias("bottom_numbers"), n("row", "word").alias("bottom_words"))
    turned_head = F.expr("names >= 2 AND numbers >= 1 AND (2 * numbers >= names OR words = 0)")
    turned_row = F.expr("cells >= 2 AND bottom_numbers = 0 AND bottom_words >= 2 AND bottom_words >= (cells + 1) div 2")
    found = counts.select("table_id", (turned_head & turned_row).alias("turned"))
    return cells.select("table_id").distinct().join(found, "table_id", "left").select("table_id", F.coalesce("turned", F.lit(False)).alias("upside_down"))


def merged_rows(cells: DataFrame) -> DataFrame:
    """(table_id, merged): at most three rows, and line feeds in more than 30 % of the cells."""
    return cells.groupBy("table_id").agg(((F.max("row_idx") <= 2) & (F.count_if(F.contains("text", F.lit("\n"))) > 0.30 * F.count(F.lit(1)))).alias("merged"))


def truncated_online(cells: DataFrame) -> DataFrame:
    """(table_id, truncated): hardly any cells, a density under 0.25, or a last row that only points on."""
    s = F.trim(F.coalesce("text", F.lit("")))
    has = s != ""
    out = cells.groupBy("table_id").agg(F.count_if(has).alias("n"), F.count(F.lit(1)).alias("all"), F.max_by(F.lower(s), F.struct(F.when(has, F.col("row_idx")), F.when(has, -F.col("col_idx")))).alias("last"))
    return out.select("table_id", ((F.col("n") < 4) | (F.col("n") < 0.25 * F.col("all")) | F.col("last").rlike(r"^(?:\.{3}|…|see full table.*)$")).alias("truncated"))


def layout_shell(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_id, shell): an unlabelled single column with a long cell or page furniture in it."""
    s = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    out = cells.groupBy("table_id").agg(F.max("col_idx").alias("c"), F.max(F.length(s)).alias("longest"), F.max(s.rlike(r"\b(?:download|menu|search|sign in|cookies|previous article|next article|view all)\b")).alias("furniture")).join(labels, "table_id", "left")
    return out.select("table_id", ((F.col("c") == 0) & (F.coalesce("label", F.lit("")) == "") & ((F.col("longest") > 80) | F.col("furniture"))).alias("shell"))


def document_class(pages: DataFrame, first: int = 5) -> DataFrame:
    """(doc_id, n_pages, chars, doc_class): scanned, thesis, double_column or single_column, of (doc_id, page_idx, chars, x_spread)."""
    out = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.when(F.col("page_idx") < first, F.col("chars"))), F.lit(0)).alias("chars"), F.max("x_spread").alias("spread"))
    return out.select("doc_id", "n_pages", "chars", F.when(F.col("chars") < 100, "scanned").when(F.col("n_pages") >= 40, "thesis").when(F.col("spread") > 150, "double_column").otherwise("single_column").alias("doc_class"))


# Words after which a table is only referred to, and marks that end a sentence.
REFERRING = ("in", "see", "shown", "presented", "supp", "suppl", "supplementary", "fig", "figure")
SENTENCE_ENDS = (".", "!", "?", ":")


def wrapped_references(lines: DataFrame) -> DataFrame:
    """Adds wrapped to (doc_id, line_no, line): a caption-like line that goes on with the sentence above it.

    It does after more than 120 characters of text above; else, unless a title of more than 10 characters follows the label, if the line above
    ends with a referring word or is over 35 characters long and ends no sentence. Below an empty line it never does.
    """
    above = Window.partitionBy("doc_id").orderBy("line_no")
    known = lines.withColumn("_above", F.coalesce(F.rtrim(F.lag("line").over(above)), F.lit(""))).withColumn("_chars", F.coalesce(F.sum(F.length("line")).over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    label = F.regexp_extract(F.ltrim("line"), "^" + LABEL, 0)
    title = F.trim(F.regexp_replace(F.substr(F.ltrim("line"), F.length(label) + 1), "^[ .:—–-]+", ""))
    word = F.lower(F.regexp_extract("_above", "([A-Za-z]+)$", 1))
    goes_on = word.isin(*REFERRING) | ((F.length("_above") > 35) & ~F.right("_above", F.lit(1)).isin(*SENTENCE_ENDS))
    wrapped = (F.col("_above") != "") & ((F.col("_chars") > 120) | ((F.length(title) <= 10) & goes_on))
    return known.withColumn("wrapped", wrapped).drop("_above", "_chars")


def token_containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, n, containment): share of the left side's tokens (pair_id, token) that the right side has, whole or as a part of at least three letters."""
    a, b = left.distinct(), right.distinct()
    exact = a.join(b, ["pair_id", "token"], "left_semi").withColumn("hit", F.lit(1))
    rest = a.join(b, ["pair_id", "token"], "left_anti")
    # only tokens that are not found whole are compared as parts, within their pair
    part = rest.alias("a").join(b.alias("b"), F.expr("a.pair_id = b.pair_id and ((length(a.token) >= 3 and contains(b.token, a.token)) or (length(b.token) >= 3 and contains(a.token, b.token)))"), "left_semi").withColumn("hit", F.lit(1))
    hits = exact.unionByName(part).groupBy("pair_id").agg(F.sum("hit").alias("hits"))
    return a.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).join(hits, "pair_id", "left").select("pair_id", "n", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("containment"))


def truth_scores(pairs: DataFrame) -> DataFrame:
    """Adds score to (…, label_match, page_match, later_page, cols, truth_cols, shared, recall, jaccard, cross_validated).

    .40 label, .20 page (.10 a later page), .20 columns, .40 numbers, .05 if cross-validated; at most .30 without a label or
    enough shared numbers.
    """
    c = F.col
    overlap = 0.5 * c("recall") + 0.5 * c("jaccard")
    raw = F.when(c("label_match"), 0.40).otherwise(0.0) + F.when(c("page_match"), 0.20).when(c("later_page"), 0.10).otherwise(0.0)
    raw = raw + F.when((c("cols") > 0) & (c("truth_cols") > 0), 0.20 * F.least("cols", "truth_cols") / F.greatest("cols", "truth_cols")).otherwise(0.0) + 0.40 * F.least(F.lit(1.0), overlap) + F.when(c("cross_validated"), 0.05).otherwise(0.0)
    return pairs.withColumn("score", F.when(c("label_match") | (c("shared") >= 3) | (overlap >= 0.20), raw).otherwise(F.least(raw, F.lit(0.30))))


def join_split_rows(pairs: DataFrame) -> DataFrame:
    """(pair_id, merged, row): last and first rows over a page break (pair_id, last: array, first: array) as one row, if they are one.

    They are if the first row has no key of its own and goes on where the last one breaks off, and no two numbers meet.
    """
    blank = lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("", "nan", "none", "-", "—")
    zipped = F.zip_with("last", "first", lambda a, b: F.struct(F.trim(F.coalesce(a, F.lit(""))).alias("a"), F.trim(F.coalesce(b, F.lit(""))).alias("b")))
    rows = pairs.select("pair_id", "last", zipped.alias("z"))
    key_gone = blank(F.get("z", F.lit(0))["b"]) | (F.get("z", F.lit(0))["a"].rlike("[-—]$") & F.get("z", F.lit(0))["b"].rlike("^[a-z]"))
    broken = F.exists("z", lambda p: (p["a"] != "") & (p["b"] != "") & (p["a"].rlike(r"(?:[-—,±~(（]|\b(?:and|with|of|in))$") | (p["b"].rlike("^[a-z]") & ~p["b"].isin("b.d.", "n.d.", "wt%", "ppm", "ppb"))))
    fills = F.exists(F.slice("z", 2, F.greatest(F.lit(0), F.size("z") - 1)), lambda p: p["b"] != "")
    clash = F.exists("z", lambda p: (p["a"] != "") & (p["b"] != "") & ~p["a"].rlike("[-—]$") & (is_data_value(p["a"]) | is_data_value(p["b"])))
    joined = F.transform("z", lambda p: F.when(p["b"] == "", p["a"]).when(p["a"] == "", p["b"]).when(p["a"].rlike("[-—]$"), F.concat(F.regexp_replace(p["a"], "[-—]$", ""), p["b"])).otherwise(F.concat_ws(" ", p["a"], p["b"])))
    ok = F.coalesce(key_gone & (broken | (blank(F.get("z", F.lit(0))["b"]) & fills)) & ~clash, F.lit(False))
    # the verdict is a column of its own: it is found once a pair, not once for itself and once for the row
    return rows.withColumn("merged", ok).select("pair_id", "merged", F.when(F.col("merged"), joined).otherwise(F.col("last")).alias("row"))


_RUN = r"\^\{[^}]+\}|_\{[^}]+\}|<su[pb][^>]*>[^<]*</su[pb]>|\^(?:[+-]?[0-9]+[+-]?|[+-]|[A-Za-z])|(?<![a-z]{3})_[0-9]+[+-]?|[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ]+|[₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎]+"


def script_runs(text: Column) -> Column:
    """array<struct<chunk, align>>: pieces of a text that stand on the line, above it or below it; ``table_1`` is one piece."""
    fence = ""
    pieces = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({_RUN})", f"{fence}$1{fence}"), fence), lambda p: p != "")

    def run(p: Column) -> Column:
        raised, lowered = p.rlike(r"^(?:\^|<sup|[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ])"), p.rlike(r"^(?:_\{|_[0-9]|<sub|[₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎])")
        bare = F.regexp_replace(F.regexp_replace(p, r"^(?:\^\{|_\{|<su[pb][^>]*>|\^|_(?=[0-9]))|(?:\}|</su[pb]>)$", ""), "\x00", "")
        plain = F.translate(F.translate(bare, "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "0123456789+-=()n"), "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()")
        return F.when(p.rlike(f"^(?:{_RUN})$") & raised, F.struct(plain.alias("chunk"), F.lit("superscript").alias("align"))).when(p.rlike(f"^(?:{_RUN})$") & lowered, F.struct(plain.alias("chunk"), F.lit("subscript").alias("align"))).otherwise(F.struct(p.alias("chunk"), F.lit(None).cast("string").alias("align")))

    return F.transform(pieces, run)


def plan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, year, publisher, scanned, online_viable) of (doc_id, title, url, chars): what to try for a document."""
    from ..functions.text import publisher, year

    out = docs.select("doc_id", year(F.coalesce("title", F.lit(""))).alias("year"), publisher(F.col("url")).alias("publisher"), (F.coalesce("chars", F.lit(0)) < 200).alias("scanned"))
    return out.withColumn("online_viable", ~F.col("publisher").isin("none", "cnki"))
