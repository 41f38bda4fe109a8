"""Checks of identifiers as Column expressions; nulls stay null, other shapes are false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _times(a: int, b: int) -> int:
    """The product in the dihedral group of order 10, whose elements 5 to 9 are the reflections."""
    return (a + b) % 5 + 5 * (b >= 5) if a < 5 else 5 * (b < 5) + (a - b) % 5


#: The first permutation of the Verhoeff scheme (fixed values); the others are its powers.
FIRST_PERMUTATION = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def verhoeff_ok(number: Column, digits: int = 12) -> Column:
    """Whether a number of so many digits has a right Verhoeff check digit, its last."""
    return F.when(number.isNull(), None).when(number.rlike(rf"\A[0-9]{{{digits}}}\z"), _verhoeff(number, digits, 0) == 0).otherwise(False)


def _verhoeff(number: Column, digits: int, start: int) -> Column:
    """The product of permuted digits from the right, the first of which has place `start`."""
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([FIRST_PERMUTATION[x] for x in powers[-1]])
    product = F.lit([_times(a, b) for a in range(10) for b in range(10)])
    permute = F.lit([x for row in powers for x in row])
    total: Column = F.lit(0)
    for i in range(digits):
        digit = F.substring(number, digits - i, 1).cast("int")
        total = F.get(product, total * 10 + F.get(permute, F.lit((i + start) % 8 * 10) + digit))
    return total


def verhoeff_digit(body: Column, digits: int = 11) -> Column:
    """The check digit of a number of so many digits without one: the product's inverse."""
    inverse = [next(b for b in range(10) if _times(b, a) == 0) for a in range(10)]
    return F.get(F.lit(inverse), _verhoeff(body, digits, 1)).cast("string")


def weighted_ok(code: Column, pattern: str, alphabet: str, check: Column) -> Column:
    return F.when(code.isNull(), None).when(code.rlike(pattern), F.substring(F.lit(alphabet), check + 1, 1) == F.substring(code, -1, 1)).otherwise(False)


def gstin_ok(code: Column) -> Column:
    """15 characters, of which the last checks the others modulo 36 with factors 1 and 2."""
    return weighted_ok(code, r"\A[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\z", BASE_36, _gstin_check(code))


BASE_36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _gstin_check(code: Column) -> Column:
    value = lambda i: F.instr(F.lit(BASE_36), F.substring(code, i, 1)) - 1
    parts = [value(i) * (1 if i % 2 else 2) for i in range(1, 15)]
    total = reduce(lambda a, b: a + b, [F.floor(p / 36) + p % 36 for p in parts])
    return ((36 - total % 36) % 36).cast("int")


def gstin_digit(body: Column) -> Column:
    """The check character of the first 14."""
    return F.substring(F.lit(BASE_36), _gstin_check(body) + 1, F.lit(1))


def mrz_digit(field: Column) -> Column:
    """The check digit of a machine-readable zone field: weights 7, 3, 1; A is 10, a filler 0."""
    values = F.transform(F.filter(F.split(F.upper(field), ""), lambda c: c != ""), lambda c: F.greatest(F.lit(0), F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1))
    weighted = F.transform(values, lambda v, i: v * F.element_at(F.lit([7, 3, 1]), i % 3 + 1))
    return F.aggregate(weighted, F.lit(0), lambda a, b: a + b) % 10


#: What the fourth letter of a PAN says of its holder.
PAN_HOLDERS = {"P": "Individual", "F": "Firm/LLP", "C": "Company", "H": "HUF", "A": "Association of Persons", "T": "Trust", "B": "Body of Individuals", "L": "Local Authority", "J": "Artificial Juridical Person", "G": "Government"}


def pan_ok(code: Column) -> Column:
    """Five letters, of which the fourth is a holder category, four digits and a letter."""
    return code.rlike(rf"\A[A-Z]{{3}}[{''.join(PAN_HOLDERS)}][A-Z][0-9]{{4}}[A-Z]\z")


def gstin_verified(raw: Column) -> Column:
    """Shape and check character hold once the confusable glyphs are read as their places want them."""
    from .text import gstin_form

    return (F.length(raw) == 15) & gstin_ok(gstin_form(raw))


# ---- machine-readable zones ---------------------------------------------------------------------------------------

#: The kinds of the 28 data characters of a passport's second line (letter, digit, digit or filler, as read).
MRZ_KINDS = "LDDDDDDDFDLLLDDDDDDDSDDDDDDD"
MRZ_LETTERS = ("012568$", "OIZSGBS")
MRZ_DIGITS = ("OQDILZS$GB", "0001125568")


def mrz(line: Column) -> Column:
    """A passport's second line as {data, folds, personal, final}; null where the line is none.

    Each of the 28 data characters is read as its place wants it; folds counts those that had to be changed, and a
    personal number that doesn't check or isn't whole.
    """
    from .text import let

    pattern = r"([A-Z0-9$]{8}[<0-9][0-9][A-Z]{3}[0-9A-Z$]{6}[0-9][MF<][0-9A-Z$]{6}[0-9])(?:([A-Z0-9<]{14}[0-9<])([0-9])|([<KL]{0,23})([0-9]))"
    bare = F.replace(F.regexp_replace(F.upper(line), r"\s+", ""), F.lit("\u00ab"), F.lit("<"))
    kinds = r"\A" + "".join({"L": "[A-Z]", "D": "[0-9]", "F": "[0-9<]", "S": "."}[k] for k in MRZ_KINDS) + r"\z"

    def place(c: Column, kind: str) -> Column:
        digit = F.translate(c, *MRZ_DIGITS)
        return {"L": F.translate(c, *MRZ_LETTERS), "D": digit, "F": F.when(c == "<", c).otherwise(digit), "S": c}[kind]

    def parts(g: Column) -> Column:
        long = g[2] != ""
        data = F.concat(*[place(F.substring(g[0], i + 1, 1), kind) for i, kind in enumerate(MRZ_KINDS)])
        personal = F.when(long & ~g[1].rlike(r"\A[<KL]*\z"), g[1]).otherwise("<" * 15)
        return F.struct(g[0].alias("raw"), data.alias("data"), personal.alias("personal"), F.when(long, g[1]).otherwise(g[3]).alias("tail"), F.when(long, g[2]).otherwise(g[4]).alias("final"))

    def read(p: Column) -> Column:
        changed = F.aggregate(F.sequence(F.lit(1), F.lit(28)), F.lit(0), lambda n, i: n + (F.substr(p["raw"], i, F.lit(1)) != F.substr(p["data"], i, F.lit(1))).cast("int"))
        last = F.substring(p["personal"], 15, 1)
        unsure = (p["tail"] != p["personal"]) | (mrz_digit(F.substring(p["personal"], 1, 14)).cast("string") != F.when(last == "<", "0").otherwise(last))
        got = F.struct(p["data"].alias("data"), (changed + unsure.cast("int")).alias("folds"), p["personal"].alias("personal"), p["final"].alias("final"))
        return F.when((p["raw"] != "") & p["data"].rlike(kinds), got)

    groups = let(bare, lambda x: F.array(*[F.regexp_extract(x, pattern, k) for k in range(1, 6)]))
    return let(let(groups, parts), read)


def mrz_failures(read: Column) -> Column:
    """Which parts of a line that was read don't agree with their check digits."""
    from .text import let

    def wrong(r: Column) -> Column:
        part = lambda a, n: F.substring(r["data"], a, n)
        test = lambda body, digit, name: F.when(mrz_digit(body).cast("string") != digit, F.lit(name))
        whole = F.concat(part(1, 10), part(14, 7), part(22, 7), r["personal"])
        return F.array_compact(F.array(test(part(1, 9), part(10, 1), "number"), test(part(14, 6), part(20, 1), "date of birth"), test(part(22, 6), part(28, 1), "expiry"), test(whole, r["final"], "whole line")))

    return let(read, wrong)
