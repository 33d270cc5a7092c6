"""Text functions as Column builders: JVM expressions only, so they stay in generated code and push into scans."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense: ASCII, no-break space, ideographic space.
SPACE = "[\\s\u00a0\u3000]"


def squeeze_space(text: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def drop_controls(text: Column) -> Column:
    """Control characters go, line feeds and tabs stay; ends are trimmed."""
    return F.trim(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))


def drop_nul(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\x00"), F.lit("")))


# Digits below and above the line, and what LaTeX commands stand for.
SUBSCRIPTS, SUPERSCRIPTS, DIGITS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
LATEX = {
    "\\pm": "±", "\\times": "×", "\\cdot": "·", "\\leq": "≤", "\\geq": "≥", "\\le": "≤", "\\ge": "≥", "\\neq": "≠", "\\approx": "≈", "\\sim": "~", "\\delta": "δ", "\\Delta": "Δ",
    "\\sigma": "σ", "\\Sigma": "Σ", "\\alpha": "α", "\\beta": "β", "\\gamma": "γ", "\\mu": "μ", "\\lambda": "λ", "\\circ": "°", "\\permil": "‰",
}


def latex_symbols(text: Column) -> Column:
    """LaTeX commands to the characters they stand for, longest command first."""
    for command in sorted(LATEX, key=len, reverse=True):
        text = F.replace(text, F.lit(command), F.lit(LATEX[command]))
    return text


def clean_markup_noise(text: Column) -> Column:
    """LaTeX shells, scripts and white space of one line of recognised text."""
    text = latex_symbols(F.replace(text, F.lit("$"), F.lit("")))
    text = F.regexp_replace(text, r"\\(?:mathrm|text|mathbf|textbf|mathit)\s*\{([^{}]*)\}", "$1")
    for opener, target in (("_", SUBSCRIPTS), ("^", SUPERSCRIPTS)):
        for digit, small in zip(DIGITS, target, strict=True):
            text = F.replace(text, F.lit(f"{opener}{{{digit}}}"), F.lit(small))
    text = F.regexp_replace(text, r"\\[ ,;!]", " ")
    return F.array_join(F.transform(F.split(text, "\n"), squeeze_space), "\n")


#: A number without sign: digits, a point, an exponent.
NUMBER = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def guarded_number(text: Column) -> Column:
    """The number that a cell is typed as, or null: codes with leading zeros and integers over 15 digits are text."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    number = plain.rlike(rf"^[+-]?{NUMBER}$")
    code = plain.rlike(r"^[+-]?0[0-9]+$") | (plain.rlike(r"^[+-]?[0-9]+$") & (F.length(F.regexp_replace(plain, "^[+-]+", "")) > 15))
    return F.when(number & ~code, plain.try_cast("double"))


def number_kind(text: Column) -> Column:
    """int, float, text or empty."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    kind = F.when(F.lower(plain).contains("e") | plain.contains("."), "float").otherwise("int")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(guarded_number(text).isNotNull(), kind).otherwise("text")


def escape_formula(text: Column, numbers_pass: bool = True) -> Column:
    """A quote before texts that a spreadsheet would run; with ``numbers_pass``, numbers are left alone."""
    risky = text.rlike("^[=+@-]")
    if numbers_pass:
        risky = risky & guarded_number(text).isNull()
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


#: White space as Python's \s has it, and decimal digits beyond ASCII.
_WIDE_SPACE = "[\\s\\x1c-\\x1f\\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")


def canonical_number(token: Column) -> Column:
    """A token of ``numeric_tokens`` with six significant digits, spelled as ``%g`` of C does; the double itself is rounded, half to even."""
    value = token.cast("double")

    def spell(s: Column) -> Column:
        power = F.substring_index(s, "E", -1).cast("int")
        fixed = F.regexp_replace(s.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
        far = F.concat(F.substring_index(s, "E", 1), F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        return F.when((power < -4) | (power > 5), far).otherwise(fixed)

    def halve(full: Column) -> Column:
        """DecimalFormat goes up from the middle; doubles that lie on it exactly go to the even digit."""
        m = F.translate(F.substring_index(full, "E", 1), "-.", "").cast("double")
        k = F.substring_index(full, "E", -1).cast("int") - 6
        exact = F.when(k < 0, m % F.pow(F.lit(5.0), -k) == 0).otherwise(m * F.pow(F.lit(5.0), k) < 2.0**53)
        down = full.rlike(r"^-?[0-9]\.[0-9]{4}[02468]5E") & exact
        return F.when(down, F.regexp_replace(full, r"\.?0*5E", "E")).otherwise(F.call_function("format_number", value, F.lit("0.#####E0")))

    sign = F.when(token.startswith("-"), "-").otherwise("")
    usual = bind(bind(F.call_function("format_number", value, F.lit("0.####################E0")), halve), spell)
    return F.when(value == 0, F.concat(sign, F.lit("0"))).when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(usual)


def numeric_tokens(text: Column) -> Column:
    """Array of all numbers of a text in canonical spelling: no thousands commas, ranges as two numbers, with sign and exponent."""
    s = F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, _OTHER_DIGITS, "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS))).otherwise(text)
    s = F.regexp_replace(s, "(?<=[0-9]),(?=[0-9])", "")
    s = F.regexp_replace(s, f"(?<=[0-9]){_WIDE_SPACE}*[-–~至到]{_WIDE_SPACE}*(?=[0-9])", " ")
    return F.transform(F.regexp_extract_all(s, F.lit(r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"), F.lit(0)), canonical_number)


MISSING_KEYS = ("", "nan", "none", "null", "-", "—", "infinity", "inf")


def merge_key(text: Column) -> Column:
    """One spelling for keys that are equal: 25.0 = 25, 13.00 = 13; 007 and 01 stay as they are."""
    s = F.trim(F.coalesce(text, F.lit("")))
    whole = F.regexp_replace(F.regexp_replace(s, r"^\+", ""), r"^-0+$", "0")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\+", ""), r"0+$", ""), r"\.$", "")
    plain = F.regexp_replace(plain, r"^(-?)0+(?=[0-9])", "$1")
    plain = F.regexp_replace(plain, r"^(-?)(?=\.)", "$10")
    return (
        F.when(F.lower(s).isin(*MISSING_KEYS), "").when(s.rlike(r"^[+-]?0[0-9]+$"), F.lower(F.regexp_replace(s, r"^\++", ""))).when(s.rlike(r"^[+-]?[0-9]+$"), whole)
        .when(s.rlike(r"^[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)$"), F.when(plain.isin("", "-", "-0"), "0").otherwise(plain)).otherwise(F.lower(s))
    )


# What counts as a measured value although it is no number, marks of errors.
MISSING_MARKS = ("-", "—", "–", "n.d.", "nd", "bdl", "b.d.l.", "b.d.", "n/a", "na", "n.a.", "tr", "trace", "loq", "lod", "dl", "nil", "none", "below detection")
SIGMA_WORDS = ("1σ", "2σ", "1s", "2s", "±", "1sigma", "2sigma", "±1σ", "±2σ")


def _value_forms() -> str:
    """One pattern for all spellings of a measured value, in lower case."""
    plain, sign = r"[0-9]+(?:\.[0-9]+)?", "-?"
    power, error, level = r"(?:e[+-]?[0-9]+)?", rf" *± *{plain}", "[12](?:σ|s|sigma)"
    forms = {
        "number": sign + plain + power,
        "limit": "[<>≤≥~] *" + sign + plain + power,
        "with error": sign + plain + error,
        "error in last digits": sign + plain + r" *\([0-9]+\)",
        "with level": sign + plain + f"(?:{error})? *" + level,
    }
    return f"^(?:{'|'.join(forms.values())})$"  # one anchor in front: a text that is no value is tried once and not at each of its characters


def is_data_value(text: Column) -> Column:
    """Numbers, limits, ranges of error and marks of missing values, but no formulas, units or element symbols."""

    def judge(s: Column) -> Column:
        low = F.lower(s)
        # a text of one of the forms begins with no capital and has no unit: it is no formula
        return (low.isin(*MISSING_MARKS, *SIGMA_WORDS) & ~s.isin("Na", "Nd")) | low.rlike(_value_forms())

    return bind(F.trim(F.coalesce(text, F.lit(""))), judge)


# Units that may stand in brackets after a column's name.
BRACKET_UNITS = ("wt", "wt%", "wt.", "wt.%", "ppm", "ppb", "%", "‰", "ma", "ga", "ka", "℃", "°c")


def column_key(name: Column) -> Column:
    """A column's name without case, scripts, units and punctuation; levels of error are spelled out."""
    units = "|".join(u.replace(".", "\\.") for u in sorted(BRACKET_UNITS, key=len, reverse=True))
    small = F.translate(F.lower(F.trim(name)), SUBSCRIPTS + SUPERSCRIPTS + "±", DIGITS * 2 + "+")
    spelled = F.regexp_replace(small, r"([12]) *(?:sigma|σ|s\b)", "$1sigma")
    return F.regexp_replace(spelled, rf"[(\[{{](?:{units})[)\]}}]|[\s_()（）\[\]{{}}./:-]", "")


# Words that begin a table's label, and digits of Chinese numbers.
LABEL_WORDS = ("附表", "附录表", "补充表", "表", "Supplementary\\s+Table", "Supplemental\\s+Table", "Extended\\s+Data\\s+Table", "Appendix\\s+Table", "Table", "Tab(?:\\.|\\b)")
HAN_DIGITS = "一二三四五六七八九十百千万零壹贰叁肆伍陆柒捌玖拾"
_DASH = "\\-\u2010-\u2015_~"


def _label_pattern() -> str:
    """A word and a number of parts, joined by dashes or points, with a letter at the end or in brackets."""
    roman = r"\b(?=[IVXL])(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\b"  # below a hundred
    part = "(?:" + "|".join(("[A-Za-z]?[0-9]+", "[\u2160-\u217f]+", roman, f"[{HAN_DIGITS}]+", r"\b[A-Za-z]\b")) + ")"
    joint = rf"(?:\s*[{_DASH}]\s*|\.(?!\s))"
    end = r"(?:[(（][A-Za-z0-9][)）]|[A-Za-z]\b)?"
    return rf"(?:{'|'.join(LABEL_WORDS)})\s*{part}(?:{joint}{part})*{end}"


LABEL = "(?i)" + _label_pattern()


def _plain_digits(text: Column) -> Column:
    return F.translate(F.translate(text, "\u00a0\u3000", "  "), "０１２３４５６７８９", DIGITS)


def find_label(text: Column) -> Column:
    """The first table label of a text as it stands there, or an empty string."""
    return F.regexp_extract(_plain_digits(F.coalesce(text, F.lit(""))), LABEL, 0)


def bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical_label(raw: Column) -> Column:
    """One spelling for labels: ``TABLE III. Results`` -> ``Table III``, ``表 2.3`` -> ``表2.3``, ``4.9`` -> ``表4.9``."""
    words = "|".join(LABEL_WORDS)
    whole = f"(?i)^(?:{LABEL[4:]})(?=[.:：—–\\s]|$)"

    def spell(s: Column) -> Column:
        number = F.regexp_extract(s, rf"(?i)^(?:{words})\s*(.*)$", 1)
        word = F.lower(F.regexp_replace(F.regexp_extract(s, rf"(?i)^({words})", 1), r"\s+", " "))
        dashed = F.regexp_replace(F.regexp_replace(F.regexp_replace(number, rf"[\s{_DASH}]", "-"), "-{2,}", "-"), "^-|-$", "")
        latin = F.concat_ws(" ", F.when(word.isin("table", "tab", "tab."), "Table").otherwise(F.initcap(word)), F.regexp_replace(number, "[—–_]", "-"))
        return F.when(s.rlike(r"^[0-9]+\.[0-9]+(?:\.[0-9]+)?$"), F.concat(F.lit("表"), s)).when((word == "") | (number == ""), s).when(word.isin("附表", "附录表", "补充表", "表"), F.concat(word, dashed)).otherwise(latin)

    trimmed = F.trim(_plain_digits(F.coalesce(raw, F.lit(""))))
    return bind(trimmed, lambda s: bind(F.coalesce(F.nullif(F.regexp_extract(s, whole, 0), F.lit("")), s), spell))


# Words of supplements.
SUPPLEMENT_WORDS = ("supplement", "suppl\\.?", "supporting\\s+info", "appendix", "extended\\s+data\\s+table", "\\badditional\\s+(?:file|table|data|material)", "\\bsupp_", "附表", "附录表", "补充表")


def is_supplementary(label: Column) -> Column:
    """A word of supplements, a number with S, or the tags SI and ESM in capitals before something."""

    def judge(s: Column) -> Column:
        pieces = F.split(s, r"[\s/\\]+")
        tag = lambda w: w.isin("SI", "ESM")
        joined = F.exists(pieces, lambda w: w.rlike("^(?:SI|ESM)[_-][A-Za-z0-9]"))
        apart = F.exists(F.zip_with(pieces, F.slice(pieces, 2, F.size(pieces)), lambda w, after: tag(w) & F.coalesce(after.rlike("^[A-Za-z0-9]"), F.lit(False))), lambda x: x)
        numbered = s.rlike(r"^S[0-9]+(?:[.-][0-9]+)*$") | s.rlike(r"(?i)(?:\btab(?:le|\.)?|表)\s*S[0-9]")
        return s.rlike("(?i)" + "|".join(SUPPLEMENT_WORDS)) | numbered | joined | apart

    return bind(F.trim(F.coalesce(label, F.lit(""))), judge)


def first_match(text: Column, patterns: Iterable[str], group: int = 1) -> Column:
    """Group of the first pattern that matches, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def arxiv_id(text: Column) -> Column:
    """The id in a DOI, in a link to an abstract, page or file, after the prefix, or alone; with its version."""
    new, old = "[0-9]{4}\\.[0-9]{4,5}", "[a-z-]+/[0-9]{7}"
    before = ("10\\.48550/arxiv\\.", "arxiv\\.org/(?:abs|html|pdf)/", "\\barxiv: *")
    led = rf"(?i)(?:{'|'.join(before)})((?:{new}|{old})(?:v[0-9]+)?)"
    return first_match(F.trim(text), (led, rf"(?i)^((?:{new}|{old})(?:v[0-9]+)?)$"))


def pmc_id(text: Column) -> Column:
    return F.upper(first_match(text, (r"(?i)\b(PMC[0-9]{5,9})\b",)))


def doi(text: Column) -> Column:
    return F.regexp_replace(first_match(text, (r"(10\.[0-9]{4,9}/[^\s\"<>]+)",)), r"[.,)]$", "")


def year(text: Column) -> Column:
    return first_match(text, (r"((?:19|20)[0-9]{2})",)).cast("int")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


#: Publisher class -> parts of the host; the first that fits.
PUBLISHERS = {"cnki": ("cnki.net", "cnki.com.cn"), "elsevier": ("sciencedirect.com", "elsevier.com"), "springer": ("springer.com", "springerlink", "nature.com"), "wiley": ("wiley.com",)}


def publisher(url: Column) -> Column:
    at = host(url)
    out = F.when(at == "", "none")
    for name, parts in PUBLISHERS.items():
        fits = F.lit(False)
        for part in parts:
            fits = fits | at.contains(part)
        out = out.when(fits, name)
    return out.otherwise("general")


def looks_like_pdf(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^?#]*)", 1)).rlike(r"\.pdf$")


def full_text_url(url: Column) -> Column:
    """Bare DOI hosts become resolver links, abstract pages of known hosts full text."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^https?://(10\.[0-9]{4,9}/\S+)$", "https://doi.org/$1")
    known = F.lower(bare).rlike("onlinelibrary\\.wiley\\.com|tandfonline\\.com|sagepub\\.com|geoscienceworld\\.org|lyellcollection\\.org|pubs\\.acs\\.org")
    return F.when(known, F.regexp_replace(bare, "^(.*?)/doi/abs/", "$1/doi/full/")).otherwise(bare)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def word_set(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, and each Chinese character as a word of its own."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "([\u4e00-\u9fa5])", " $1 ")
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9\u4e00-\u9fa5]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def safe_file_name(name: Column, longest: int = 120) -> Column:
    return F.trim(F.substring(F.regexp_replace(squeeze_space(name), r'[\\/*?:"<>|]', "_"), 1, longest))


def parse_page_ranges(text: Column) -> Column:
    """``1-3,5`` -> [0, 1, 2, 4]: zero-based, distinct, ascending."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike("^[0-9]+(?:-[0-9]+)?$"))
    first = lambda p: F.substring_index(p, "-", 1).cast("int")
    last = lambda p: F.substring_index(p, "-", -1).cast("int")
    ordered = F.filter(parts, lambda p: first(p) <= last(p))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ordered, lambda p: F.sequence(first(p) - 1, last(p) - 1)))))
