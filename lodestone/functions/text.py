"""Text functions: folding, retrieval tokens, query checks, hashes and ids."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: A token, and what joins the parts of a compound one.
TOKEN, JOINT = r"[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*", "[._-]"
#: Fixed value: the namespace of point ids.
POINT_NAMESPACE = "9202dd18-24a1-5d8e-9bf1-626c51c77d1d"
#: Fixed value: the prefixes that embedding models put before texts.
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters that case folding changes into one other, those others, and what it changes into more than one."""
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c]
    single = [c for c in every if len(c.casefold()) == 1]
    return "".join(single), "".join(c.casefold() for c in single), {c: c.casefold() for c in every if len(c.casefold()) > 1}


def casefold(text: Column) -> Column:
    """Full Unicode case folding, as str.casefold(): lower() keeps ß and context-dependent forms."""
    old, new, many = _folds()
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    longer = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # ASCII, the usual case, takes neither table
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(F.translate(F.when(text.rlike("[" + "".join(many) + "]"), longer).otherwise(text), old, new))


@cache
def _late() -> str:
    """A class of the characters whose folding has to wait until tokens are found: it makes more characters, or others than
    letters and digits of them.  ß is left out; it becomes two letters wherever it stands."""
    old, new, many = _folds()
    odd = [c for c, d in zip(old, new) if c.isalnum() != d.isalnum()]
    return "[" + "".join(sorted({*many, *odd} - {"ß"})) + "]"


#: Up to here are the Latin letters; in this block lower() differs from folding at a few characters only.
_LATIN = 0x24F


def _latin(text: Column) -> tuple[Column, Column]:
    """(whether text is Latin and may be folded whole, its folding then)."""
    late, spans, begin = set(_late()[1:-1]), [], 0
    for c in [*range(_LATIN + 1), None]:
        if c is None or chr(c) in late:
            end = _LATIN if c is None else c - 1
            spans += [f"\\x{{{begin:x}}}-\\x{{{end:x}}}"] if begin <= end else []
            begin = end + 2
    folded = F.lower(text)
    for c in map(chr, range(_LATIN + 1)):
        if c not in late and c.lower() != c.casefold():
            folded = F.replace(folded, F.lit(c.lower()), F.lit(c.casefold()))
    return text.rlike("\\A[" + "".join(spans) + "]*\\z"), folded


def tokens(text: Column) -> Column:
    """The retrieval tokens of text, in order: each compound, then its parts if it has several; folded.

    Letters and digits are those of the JVM's Unicode tables.  A null text has none.  Texts are folded whole where that
    finds the same tokens, and tokens are looked through for parts only where the text has a compound.
    """
    text = F.coalesce(text, F.lit(""))
    old, new, _ = _folds()
    found = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    split = lambda w: F.when(w.rlike(JOINT), F.concat(F.array(w), F.split(w, JOINT))).otherwise(F.array(w))
    spread = lambda words: F.flatten(F.transform(words, split))
    compound = text.rlike(r"[\p{L}\p{N}][._-][\p{L}\p{N}]")
    is_latin, latin = _latin(text)
    other = F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), old, new)
    late = spread(F.transform(found(text), casefold))
    return (
        F.when(is_latin & ~compound, found(latin))
        .when(is_latin, spread(found(latin)))
        .when(text.rlike(_late()), late)
        .otherwise(spread(found(other)))
    )


def query_error(query: Column) -> Column:
    """Why a raw query is refused (blank, or with an embedding prefix of its own), or null."""
    bare = F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", F.lit("blank")).when(bare.rlike("(?i)^(query|passage):"), F.lit("prefixed"))


def query_text(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), text)


def passage_text(text: Column) -> Column:
    return F.concat(F.lit(PASSAGE_PREFIX), text)


def sha256(text: Column) -> Column:
    """The SHA-256 of text in UTF-8, or of binary, in lower-case hexadecimal digits."""
    return F.sha2(text.cast("binary"), 256)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """The version-5 UUID of name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def question_key(text: pd.Series) -> pd.Series:
    """What two questions share if they are the same text: NFKC, folded, single spaces."""
    return text.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip())


@F.pandas_udf(StringType())
def question_part(text: pd.Series) -> pd.Series:
    """A part of a rendered query: NFKC, single spaces."""
    return text.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip())


def fake_vector(dimension: int = 384):
    """A UDF from text to a fixed vector without meaning: SHAKE-256, four bytes a number, -1 to 1; not of unit length; null: null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def vector(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float] | None:
            if t is None:
                return None
            raw = hashlib.shake_256(t.encode()).digest(4 * dimension)
            return [int.from_bytes(raw[i : i + 4], "big") / 0xFFFFFFFF * 2.0 - 1.0 for i in range(0, len(raw), 4)]

        return text.map(one)

    return vector
