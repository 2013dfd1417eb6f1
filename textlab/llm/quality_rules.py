r"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table: each row names a ratio over the measured counts and the closed range that passes.  ``compile_rules``
turns the whole table into one boolean column, ``measures`` gives the counts.  Everything is a built-in SQL function; no
row is shuffled.

Cases: a null or empty text has no words, so every count is 0, ``base_failed`` is true and the row is not kept.  Very long
texts are handled whole.  Other columns of the input, whatever their names, are passed through by ``apply_rules`` unless
they carry the name of a measure, in which case the measure wins.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import SPACES, WORD_RE

SYMBOLS = "#*$%&|<>"

#: Function words of the four languages; fixed values of the stop-word rule.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "was", "for", "that", "on", "with", "by", "from", "are", "this", "it", "be",
    "de", "la", "le", "les", "des", "et", "un", "une", "du", "pour", "dans", "qui", "que", "par", "est", "en", "au",
    "der", "die", "das", "und", "von", "zu", "den", "mit", "ist", "im", "ein", "eine", "nicht", "auf", "dem", "für",
    "el", "los", "las", "del", "y", "con", "por", "para", "una", "se", "su", "no", "al", "como", "lo",
]


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` over measures; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table (length, symbol, stop-word and line ratios).
RULES = [
    Rule("word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbol_words", "n_symbols", "n_words", high=0.25),
    Rule("shouted_letters", "n_upper", "word_chars", high=0.4),
    Rule("exclamations", "n_exclaims", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.01),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.4),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_stop_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are 64-bit hashes.  Only a text with a repeated window pays for the sort: windows sorted by (hash, place),
    those equal to a neighbour are kept, and the places they cover are summed as the gaps to the next one, at most 3."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = _let(ordered, lambda s: F.filter(s, lambda e, j: F.get(s, j - 1)["h"].eqNullSafe(e["h"]) | F.get(s, j + 1)["h"].eqNullSafe(e["h"])))
        places = F.array_sort(F.transform(repeats, lambda e: e["i"]))
        steps = _let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    repeated = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n >= 4, repeated).otherwise(F.lit(0))


def measures(text: Column) -> dict[str, Column]:
    """Name -> count (long) over the whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.translate(s, SPACES, "") != "")
    out = {
        "n_words": F.regexp_count(text, F.lit(WORD_RE)),
        "word_chars": _without(text, SPACES),
        "n_symbols": F.length(text) - _without(text, SYMBOLS),
        "n_dup_lines": _let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))),
        "n_repeat_words": _let(words, _repeat_words),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_exclaims": F.length(text) - _without(text, "!"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
    }
    return {k: v.cast("long") for k, v in out.items()}


def compile_rules(rules: list[Rule] | None = None) -> Column:
    """The table as one boolean column over the measures."""
    ok = F.lit(True)
    for r in RULES if rules is None else rules:
        top, bottom = F.col(r.numerator), F.col(r.denominator)
        if r.low is not None:
            ok = ok & ((bottom == 0) | (top >= F.lit(float(r.low)) * bottom))
        if r.high is not None:
            ok = ok & ((bottom == 0) | (top <= F.lit(float(r.high)) * bottom))
    return ok


def apply_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    taken = {*MEASURES, "base_failed", "kept"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in taken]
    measured = docs.select(*own, *[c.alias(k) for k, c in measures(F.col(f"`{text_col}`")).items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
