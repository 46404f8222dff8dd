"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _folds(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Signs below U+2200 and Latin ligatures that a Unicode decomposition turns into others: one-to-one pairs, and one-to-many."""
    source, target, many = [], [], []
    for code in (*range(0x80, 0x2200), *range(0xFB00, 0xFB07)):
        sign = chr(code)
        folded = unicodedata.normalize(form, sign)
        kept = "".join(c for c in folded if not unicodedata.category(c).startswith("M"))
        if form == "NFKD":
            kept = kept.encode("ascii", "ignore").decode()
        if kept == sign or not kept:
            continue
        if len(kept) == 1:
            source.append(sign)
            target.append(kept)
        else:
            many.append((sign, kept))
    return "".join(source), "".join(target), tuple(many)


def _fold(c: Column, form: str) -> Column:
    source, target, many = _folds(form)
    # the one-to-many signs are rare: only rows that hold one walk the chain
    chain = c
    for sign, text in many:
        chain = F.replace(chain, F.lit(sign), F.lit(text))
    any_of = "[" + "".join(sign for sign, _ in many) + "]"
    return F.translate(F.when(c.rlike(any_of), chain).otherwise(c) if many else c, source, target)


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition, then only ASCII, lower case. Rows that are ASCII already skip the tables."""
    plain = F.lower(F.regexp_replace(_fold(c, "NFKD"), r"[^\x00-\x7F]", ""))
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(plain)


def strip_marks(c: Column) -> Column:
    """Without ® and ™ and without combining marks; letters that aren't ASCII stay."""
    bare = F.regexp_replace(c, "[®™]", "")
    return F.when(bare.rlike(r"^[\x00-\x7F]*$"), bare).otherwise(F.regexp_replace(_fold(bare, "NFD"), r"\p{M}", ""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"


def search_text(c: Column) -> Column:
    """Digits and letters set apart, all other signs to spaces, lower case."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), f"([0-9])([{LETTERS}])", "$1 $2")
    spaced = F.regexp_replace(spaced, f"([{LETTERS}])([0-9])", "$1 $2")
    return F.lower(squeeze(F.regexp_replace(spaced, f"[^0-9{LETTERS}]+", " ")))


def graph_text(c: Column) -> Column:
    """Lower case with only a-z, 0-9 and %./+-; each run of other signs becomes a space beside those that are there."""
    return F.trim(F.regexp_replace(F.lower(squeeze(F.coalesce(c, F.lit("")))), r"[^a-z0-9%./+\- ]+", " "))


DOSE = r"\b\d+(?:[.,]\d+)?\s*(?:mg|mcg|ug|g|ml|ui|iu|%)\b"


def dose_tokens(c: Column) -> Column:
    """Distinct doses in a text (as graph_text), without spaces, in order of first appearance."""
    found = F.regexp_extract_all(graph_text(c), F.lit(DOSE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


def ingredients(c: Column) -> Column:
    """Ingredients of a compound name: split at + / and the words Y and CON; upper case, distinct, in order."""
    parts = F.split(F.upper(squeeze(F.coalesce(c, F.lit("")))), r"\s*[+/]\s*|\s+Y\s+|\s+CON\s+")
    return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != ""))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def canonical_key(c: Column) -> Column:
    """`record-sequence` codes with both parts as integers and the second padded to two digits; other text as it is."""
    parts = F.split(F.trim(c), "-")
    left, right = (F.regexp_replace(F.get(parts, F.lit(k)), r"\D", "") for k in (0, 1))
    ok = (F.size(parts) == 2) & (left != "") & (right != "")
    return F.when(ok, F.format_string("%d-%02d", left.try_cast("bigint"), right.try_cast("bigint"))).otherwise(F.trim(c))


def row_key(*columns: Column) -> Column:
    """sha1 of the columns as text joined by bars; null counts as the empty text."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))
