"""Normal forms, tokens, folds and shapes of text as Column expressions. Null stays null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once per row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def says(c: Column, *words: str) -> Column:
    """Whether a text has one of some lower-case words in any case: cheap, so it is asked before a pattern that needs one of them."""
    low = F.lower(c)
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])


# ---- fixed values: glyphs that scans confuse, titles, plates ------------------------------------------------------

#: Letters and the digits they are read for, in identifiers, in claim ids (lower case) and in code payloads.
ID_GLYPHS = ("OQDILZSBG", "000112586")
CLAIM_GLYPHS = ("oqdiltjzsbg", "00011112586")
CODE_GLYPHS = ("ODQILZASGTB", "00011245678")
#: Round, stem, arch and tail glyphs, each group folded to its first.
PRINT_GLYPHS = ("eouljthrqy", "ccciiinngv")
#: In a GSTIN: letters where digits belong, and digits where letters belong.
GSTIN_DIGITS = ("OQILTSBZGAH", "00117582649")
GSTIN_LETTERS = ("0158267", "OISBZGT")
#: In other identifiers.
SHAPE_DIGITS = ("OILSBZ", "011582")
SHAPE_LETTERS = ("01582", "OISBZ")
DASHES = "[‐-―−]"
HONORIFICS = ["mr", "mrs", "ms", "shri", "smt", "sri", "thiru", "dr", "master", "kum", "m/s", "ms/", "lt", "late"]
MOHAMMED = ["md", "mohd", "mohammed", "mohammad", "mohamed", "muhammad", "muhammed"]
STATES = "AN AP AR AS BR CH CG DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UK UA UP WB BH".split()

# ---- normal forms ------------------------------------------------------------------------------------------------


def normalized(c: Column) -> Column:
    """Lower case, ASCII letters and digits only; also the form of labels and headers."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def upper_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def without_separators(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s.\-]", "")


def sorted_words(c: Column) -> Column:
    """Distinct printings of one set of words, in any order and punctuation, are one value."""
    return F.array_join(F.array_sort(F.array_remove(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), r"\s+"), "")), " ")


def id_form(c: Column) -> Column:
    """An identifier as a scan can't tell it from others."""
    return F.translate(F.regexp_replace(F.upper(c), r"[\s.\-/]", ""), *ID_GLYPHS)


def claim_form(c: Column) -> Column:
    return F.translate(normalized(c), *CLAIM_GLYPHS)


def code_form(c: Column) -> Column:
    return F.translate(upper_key(c), *CODE_GLYPHS)


def print_form(c: Column) -> Column:
    """A word as print can't be told from other print."""
    return F.translate(F.replace(F.replace(F.lower(c), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w")), *PRINT_GLYPHS)


def gstin_form(c: Column) -> Column:
    """Each place folded to its kind: digits at 1, 2, 8 to 11 and 13, letters else, and the last as it is."""
    part = lambda a, n, glyphs: F.translate(F.substring(c, a, n), *glyphs)
    return F.concat(part(1, 2, GSTIN_DIGITS), part(3, 5, GSTIN_LETTERS), part(8, 4, GSTIN_DIGITS), part(12, 1, GSTIN_LETTERS), part(13, 1, GSTIN_DIGITS), part(14, 1, GSTIN_LETTERS), F.substring(c, 15, 1_000_000))


def plain_dashes(c: Column) -> Column:
    return F.regexp_replace(c, DASHES, "-")


def plate(c: Column) -> Column:
    """A vehicle number as state, two digits, series letters and four digits; null for anything else.

    In the two digits an O is a zero. Without series letters the parts can't be told apart.
    """
    bare = F.regexp_replace(F.upper(c), r"[\s.\-]", "")
    group = lambda k: F.regexp_extract(bare, r"\A([A-Z]{2})([0-9O]{1,3})([A-Z]{1,3})([0-9]{1,4})\z", k)
    area = F.translate(group(2), "O", "0").try_cast("int")
    parts = F.concat(group(1), F.when(area < 100, F.lpad(area.cast("string"), 2, "0")).otherwise(area.cast("string")), group(3), F.lpad(group(4), 4, "0"))
    return F.when(group(1).isin(STATES), parts)


def normal_value(field: Column, c: Column) -> Column:
    """The key under which a value of a field is compared, cut to 255: dates by day, names and addresses by their words."""
    day = lambda k: F.regexp_extract(F.trim(c), r"\A([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})\z", k)
    year = day(3).try_cast("int")
    full = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    date = F.concat_ws("-", day(1).try_cast("int").cast("string"), day(2).try_cast("int").cast("string"), full.cast("string"))
    key = F.when((field == "DOB") & (day(1) != ""), date).when(field.isin("ADDRESS", "NAME", "RELATION_FATHER"), sorted_words(c)).when(field == "VEHICLE_NO", F.coalesce(plate(c), upper_key(c))).otherwise(upper_key(c))
    return F.substring(key, 1, 255)


# ---- names and words ---------------------------------------------------------------------------------------------


def name_tokens(c: Column) -> Column:
    """Lower-case words without titles; the spellings of one common given name are one."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z\s.]", " "), r"[\s.]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(HONORIFICS))
    return F.transform(kept, lambda w: F.when(w.isin(MOHAMMED), "mohd").otherwise(w))


def without_honorific(c: Column) -> Column:
    titles = "M/S|MS/|MRS|MR|MS|SHRI|SMT|SRI|THIRU|DR|MASTER|KUM|LATE|LT"
    return F.trim(F.regexp_replace(c, rf"(?i)\A(?:{titles})(?![A-Za-z])[_.\s]*", ""))


def word_candidates(c: Column) -> Column:
    """Whole runs of three or more letters, not followed by a digit or an apostrophe."""
    return F.regexp_extract_all(c, F.lit("(?<![A-Za-z])[A-Za-z]{3,}(?![A-Za-z0-9'’])"), 0)


def plural_stems(c: Column) -> Column:
    """What a word may be the plural of."""
    w = F.lower(c)
    return F.array_compact(F.array(
        F.when(w.rlike(r"ies\z"), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y"))),
        F.when(w.rlike(r"(?:ch|sh|s|x|z)es\z"), F.substr(w, F.lit(1), F.length(w) - 2)),
        F.when(w.rlike(r"[^s]s\z"), F.substr(w, F.lit(1), F.length(w) - 1)),
    ))


def mention(text: Column, name: str) -> Column:
    """Where a kind of document is first named as a whole word or phrase, from 0, or -1. Spellings of licence and Aadhaar vary."""
    special = "".join(rf"\{ch}" if ch in r".*+?^${}()|[]\\" else ch for ch in name.strip())
    for plain, pattern in (("licence", "licen[cs]e"), ("aadhar", "aad?haa?r")):
        at = special.lower().find(plain)
        if at >= 0:
            special = special[:at] + pattern + special[at + len(plain) :]
    pattern = r"\s+".join(special.split())
    if not pattern:
        return F.lit(-1)
    before = F.regexp_extract(text, rf"(?is)\A(.*?)(?:^|[^A-Za-z])(?:{pattern})(?:[^A-Za-z]|\z)", 1)
    return F.when(text.rlike(rf"(?i)(?:^|[^A-Za-z]){pattern}(?:[^A-Za-z]|\z)"), F.length(before)).otherwise(-1)


def file_has_token(name: Column, token: str) -> Column:
    """Whether a file name has a token as a word and not as letters inside one.

    It begins a word; a short one also ends it or runs into a suffix such as card; a long one may end a word, too.
    """
    words = F.array_remove(F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+"), "")
    if len(token) > 4:
        rest = lambda i: F.array_join(F.slice(words, i + 1, F.size(words)), "")
        begins = F.exists(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.startswith(rest(i), F.lit(token)))
        return begins | F.exists(words, lambda w: F.endswith(w, F.lit(token)) & (w != token))
    return F.exists(words, lambda w: w.rlike(rf"\A{token}(?:\z|card|book|no|number|copy|front|back|doc|scan|[0-9])"))


def read_score(words: Column, real: Column) -> Column:
    """How many words of five letters or more are real ones; real: array of known lower-case words."""
    return F.size(F.filter(words, lambda w: (F.length(w) >= 5) & F.array_contains(real, F.lower(w))))


# ---- shapes ------------------------------------------------------------------------------------------------------

#: The kinds of characters of identifiers, L for a letter and D for a digit.
SHAPES = {"PAN": "LLLLLDDDDL", "DL": "LL" + "D" * 13, "PASSPORT": "L" + "D" * 7, "EPIC": "LLL" + "D" * 7}


def has_shape(c: Column, kinds: str) -> Column:
    return c.rlike(r"\A" + "".join("[A-Z]" if k == "L" else "[0-9]" for k in kinds) + r"\z")


def misread_shape(c: Column, kinds: str) -> Column:
    """Whether a token of another shape has this one when up to eight confusable glyphs are read the other way."""
    s = F.upper(without_separators(c))
    places, at = [], 0
    while at < len(kinds):
        n = len(kinds[at:]) - len(kinds[at:].lstrip(kinds[at]))
        places.append(F.translate(F.substring(s, at + 1, n), *(SHAPE_LETTERS if kinds[at] == "L" else SHAPE_DIGITS)))
        at += n
    unsure = F.length(F.regexp_replace(s, "[^O0I1LS5B8Z2]", ""))
    return (F.length(s) == len(kinds)) & ~has_shape(s, kinds) & has_shape(F.concat(*places), kinds) & unsure.between(1, 8)


def is_mobile(c: Column) -> Column:
    return c.rlike(r"\A(?:[6-9][0-9]{9}|0[0-9]+|(?:1800|1860)[0-9]{6,7}|91[6-9][0-9]{9})\z")


# ---- pages and addresses on the web --------------------------------------------------------------------------------


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(F.parse_url(url, F.lit("HOST")), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")


def base64(c: Column) -> Column:
    """base64 in one line: Spark breaks it after 76 signs."""
    return F.translate(F.base64(c), "\r\n", "")


def url_token(url: Column) -> Column:
    """base64 of a URL that may itself stand in a path: - and _ for + and /, no padding."""
    return F.rtrim(F.translate(base64(F.encode(url, "utf-8")), "+/", "-_"), F.lit("="))


def rewritten_links(html: Column, prefix: str) -> Column:
    """Root-relative src, href and action values and CSS url() values, with a prefix before them."""
    quoted = F.regexp_replace(html, r"""(?i)\b(src|href|action)=(["'])/(?!/)""", rf"$1=$2{prefix}/")
    return F.regexp_replace(quoted, r"""(?i)url\((["']?)/(?!/)""", rf"url($1{prefix}/")


def labelled_span(html: Column, id_: str) -> Column:
    """The text of a span with an id, empty where there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, rf"""(?is)<span[^>]*\bid=["']{id_}["'][^>]*>(.*?)</span>""", 1), "<[^>]*>", ""))


#: The usual types of documents by extension.
MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "txt": "text/plain", "csv": "text/csv",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def mime_type(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))), F.lit("application/octet-stream"))


def guarded(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula, made text."""
    return F.when(c.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def any_of(c: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [c.rlike(p) for p in patterns])
