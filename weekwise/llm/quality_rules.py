"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in column expression over the whole text of a row,
so the operator is one narrow pass: no user function, no shuffle, no join.

Defined results
- null text is the empty text: no words, all counts 0, `base_failed`, not kept.
- repeated rows and ties: each row is judged alone and stays a row of its own.
- empty table: no rows, same columns.
- extra input columns are kept unless a result column has the same name
  (letter case ignored), in which case the result replaces them.
- very long texts: work and memory are in proportion to the row's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwise.llm.frames import with_results

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Common function words of the languages the rules are set up for.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von", "ein", "eine", "zu", "den", "für", "auf", "sich"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "las", "un", "una", "por", "con", "no", "se", "del"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "dans", "pour", "qui", "sur", "pas"),
}


@dataclass(frozen=True)
class Rule:
    """`measure` has to lie within [low, high]; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios: mean code points of a word; symbols per
#: word; share of words that are stop words of any listed language; share of
#: worded lines that repeat an earlier line; share of worded lines; share of
#: code points inside words.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("worded_line_ratio", 0.2, None),
    Rule("word_char_ratio", 0.5, None),
)


def _repeated_starts(order: Column) -> Column:
    """Starts of the windows that have an equal neighbour in (hash, start) order."""
    twice = F.filter(
        order,
        lambda x, i: F.coalesce(x["h"] == F.get(order, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(order, i + 1)["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(starts: Column, length: int) -> Column:
    """Words covered by windows of `length` words at sorted `starts`: each adds min(length, gap to the one before)."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-length).cast("int").alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(length), i - acc["last"])).cast("long").alias("n"),
            i.cast("int").alias("last"),
        ),
        lambda acc: acc["n"],
    )


def measure(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """Add the counts and ratios the rules refer to. Words are separated by white space only.

    A window is identified by a 64-bit hash of its words within one text.
    """
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    docs = docs.withColumns({"__whole": whole, "__words": words})
    n_words = F.size("__words").cast("long")
    w = F.col("__words")
    windows = F.when(
        n_words >= window,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - F.lit(window)),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(window)]).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))
    lines = F.split(F.col("__whole"), "\n", -1)
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.regexp_replace("__whole", SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count("__whole", F.lit(SYMBOLS)).cast("long"),
            "__lines": F.size(lines).cast("long"),
            "__worded": worded,
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long"),
            "__order": F.sort_array(windows),
        }
    )
    # A stored column of its own: inside a lambda an expression would be evaluated again for every element.
    docs = docs.withColumn("__starts", F.when(F.size("__order") > 1, _repeated_starts(F.col("__order"))).otherwise(F.array().cast("array<int>")))
    worded_n = F.size("__worded").cast("long")
    return docs.withColumns(
        {
            "n_dup_lines": worded_n - F.size(F.array_distinct("__worded")).cast("long"),
            "n_repeat_words": _covered(F.col("__starts"), window),
            "__worded_n": worded_n,
        }
    ).withColumns(
        {
            "mean_word_chars": F.try_divide("word_chars", "n_words"),
            "symbols_per_word": F.try_divide("n_symbols", "n_words"),
            "stop_word_ratio": F.try_divide("n_stop_words", "n_words"),
            "dup_line_ratio": F.try_divide("n_dup_lines", "__worded_n"),
            "worded_line_ratio": F.try_divide("__worded_n", "__lines"),
            "word_char_ratio": F.try_divide("word_chars", F.length("__whole")),
        }
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: every measure inside its bounds. A missing measure fails."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.col(rule.measure)
        if rule.low is not None:
            verdict = verdict & F.coalesce(value >= F.lit(float(rule.low)), F.lit(False))
        if rule.high is not None:
            verdict = verdict & F.coalesce(value <= F.lit(float(rule.high)), F.lit(False))
    return verdict


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """`docs` with its measures, `base_failed` and the verdict `kept`."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words"]
    ratios = [r.measure for r in RULES]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    results = {c: F.col(c) for c in [*own, *ratios]} | {"base_failed": failed}
    results["kept"] = ~failed & compile_rules(rules)
    return with_results(docs, text, lambda rows: measure(rows, "__text"), results)
