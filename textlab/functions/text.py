"""Text column functions: tokenising, span stripping, normalisation, n-grams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's for right results.
# Punctuation marks used by the stop-word filter (33 characters, including one space).
PUNCT = "!\"#$%&'()*+, -./:;<=>?@[\\]^_`{|}~"
# Words dropped before two frequency tables are compared.
COMPARE_EXCLUDE = ["<", ">", "</", "\n", " ", "discr"]

# Our tokeniser contract (the reference calls an external segmenter): a word is a
# run of letters, marks or digits; every other character is kept as its own token
# and whitespace runs are one token, so concatenating the tokens gives the text.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}]+"
TOKEN_PATTERN = r"([\p{L}\p{M}\p{N}]+|\s+|[^\p{L}\p{M}\p{N}\s])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, pattern: str = TOKEN_PATTERN, lower: bool = False) -> Column:
    """ARRAY<STRING> of the regex matches of ``pattern`` (group 1 if it has one)."""
    c = _col(text)
    if lower:
        c = F.lower(c)
    group = 1 if "(" in pattern.replace(r"\(", "") else 0
    return F.regexp_extract_all(c, F.lit(pattern), group)


def words(text, lower: bool = True) -> Column:
    """Word tokens only (letters, marks, digits)."""
    return tokens(text, WORD_PATTERN, lower=lower)


def strip_spans_col(text, tag: str) -> Column:
    """Remove every ``<tag>...</tag>`` span, shortest match, never across ``\\n``.

    ``(?d)`` (UNIX_LINES) makes ``.`` stop only at ``\\n`` as in Python and RE2;
    Java's default ``.`` would also stop at ``\\r``.
    """
    return F.regexp_replace(_col(text), F.lit(f"(?d)<{tag}>.*?</{tag}>"), F.lit(""))


def normalize_col(text, space_token: str | None = None, lower: bool = False,
                  collapse_repeats: bool = False) -> Column:
    """Text normalisation before modelling (our own contract, SURVEY K3).

    1 unescape the common HTML entities (``&amp;`` last); 2 drop empty bracket
    pairs; 3 newlines to spaces; 4 squeeze spaces and trim; 5 optional space
    token; 6 optional lower case; 7 optional: runs of 4+ equal characters to one.
    """
    c = _col(text)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    c = F.regexp_replace(c, F.lit(r"\(\)|\[\]|\{\}"), F.lit(""))
    c = F.regexp_replace(c, F.lit(r"[\r\n]+"), F.lit(" "))
    c = F.trim(F.regexp_replace(c, F.lit(" {2,}"), F.lit(" ")))
    if collapse_repeats:
        c = F.regexp_replace(c, F.lit(r"(.)\1{3,}"), F.lit("$1"))
    if space_token is not None:
        c = F.replace(c, F.lit(" "), F.lit(space_token))
    if lower:
        c = F.lower(c)
    return c


_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _gram_hashes(text: str, n: int):
    """Sorted distinct 64-bit hashes of the n-grams of ``text`` (vectorised).

    Each gram is its n code points mixed into 64 bits; a text shorter than n is
    padded with values above the largest code point, so it never equals a gram.
    """
    import numpy as np
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(cp) < n:
        cp = np.concatenate([cp, np.arange(0x110000, 0x110000 + n - len(cp), dtype=np.uint32)])
    size = len(cp) - n + 1
    h, t = np.full(size, np.uint64(n), dtype=np.uint64), np.empty(size, np.uint64)
    m0, m1, m2 = (np.uint64(x) for x in _MIX)

    def mix(shift: int) -> None:
        np.right_shift(h, np.uint64(shift), out=t)
        np.bitwise_xor(h, t, out=h)

    for j in range(n):
        np.bitwise_xor(h, cp[j:j + size], out=h)
        np.multiply(h, m0, out=h)
        mix(31)
    mix(30)
    np.multiply(h, m1, out=h)
    mix(27)
    np.multiply(h, m2, out=h)
    mix(31)
    grams = h.view(np.int64)
    grams.sort()  # np.unique takes many times as long
    first = np.empty(size, bool)
    first[0] = True
    np.not_equal(grams[1:], grams[:-1], out=first[1:])
    return grams[first]


def char_ngram_hashes(text, n: int = 5) -> Column:
    """Sorted distinct 64-bit hashes of the character n-grams of the whole text.

    A text no longer than ``n`` has one gram, itself (so it is never empty).
    An Arrow UDF: ``substring`` at a moving position inside a SQL lambda
    re-walks the UTF-8 string from its start, which is quadratic in the text
    length; slicing in Python is linear.
    """
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _gram_hashes(t, n) for t in texts])

    return grams(_col(text))


def char_ngram_count(text, n: int = 5) -> Column:
    """Number of ``char_ngram_hashes``, without the hashes."""
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else len(_gram_hashes(t, n)) for t in texts], dtype="Int64")

    return count(_col(text))
