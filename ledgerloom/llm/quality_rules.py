"""Quality rules [native]: a threshold table compiled into one Spark projection.

Every measure of a text (length, symbols, stop words, line ratios, repetition) is a SQL
expression over the row; the thresholds are rows of RULES, and `compile_rules` turns them into
one boolean expression. No user function runs, nothing is shuffled, and a row never meets
another row, so the operator is a plain scan at any size.

Cases: a null text counts as empty (no words, so it fails the length rule); null ids pass
through; repeated rows each get their own row; an empty table gives an empty table; columns of
the input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import let

# Frequent function words of the corpus languages (en, fr, de, es).
STOP_WORDS = (
    "a and are as at be for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für ich ist mit nicht sich und von zu "
    "al con del el los las no por para se su una y"
).split()

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """metric must lie in [low, high]; a null metric (no words) breaks the rule."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=50),
    Rule("repetition", "repeat_ratio", high=0.5),
    Rule("mean_word", "mean_word_chars", low=2.0, high=20.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)
#: The rules whose verdict the contract calls base_failed.
BASE_RULES = ("length", "repetition")


def _covered(words: Column, n: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.

    A hash set over the windows tells most texts apart at once: no window repeats. For the rest
    the window hashes are sorted with their positions, so equal windows become neighbours: n
    log n for a text, however often it repeats itself. Marked positions, back in text order,
    each cover three words or as many as remain before the next marked one.
    """
    hashes = F.transform(
        F.slice(words, F.lit(1), n - 2),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def marked(s: Column) -> Column:
        # flags over sorted windows: equal to the one before or after
        hit = F.transform(
            s,
            lambda x, j: F.when(
                (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]
            ),
        )
        return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

    def spread(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
            lambda acc, x: F.struct(
                (acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum"), x.alias("last")
            ),
            lambda acc: acc["sum"],
        )

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(placed, lambda s: let(marked(s), spread))
        )

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, count))


def measures(text: Column) -> Column:
    """One struct of all measures of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            _covered(w, n).alias("n_repeat_words"),
        )

    words = F.array_remove(F.split(text, SPACE + "+"), "")
    return let(
        F.struct(
            let(words, of).alias("w"),
            let(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("long").alias("n"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                ),
            ).alias("l"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")))
            .cast("long")
            .alias("n_symbols"),
        ),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["l"]["dup"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["w"]["n_stop"].alias("n_stop"),
            m["l"]["n"].alias("n_lines"),
        ),
    )


def ratios(m: Column) -> dict[str, Column]:
    """The metrics a rule can name; null where a text has no words."""

    def over(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b.cast("double"))

    return {
        "n_words": m["n_words"].cast("double"),
        "repeat_ratio": over(m["n_repeat_words"], m["n_words"]),
        "mean_word_chars": over(m["word_chars"], m["n_words"]),
        "symbol_ratio": over(m["n_symbols"], m["n_words"]),
        "stop_ratio": over(m["n_stop"], m["n_words"]),
        "dup_line_ratio": over(m["n_dup_lines"], m["n_lines"]),
    }


def compile_rules(m: Column, rules=RULES) -> Column:
    """array<string> of the names of broken rules, in table order."""
    have = ratios(m)

    def broken(r: Rule) -> Column:
        x = have[r.metric]
        bad = x.isNull()
        if r.low is not None:
            bad = bad | (x < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (x > F.lit(float(r.high)))
        return F.when(bad, F.lit(r.name))

    return F.filter(F.array(*[broken(r) for r in rules]), lambda x: x.isNotNull())


def apply_rules(
    docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, the measures, failed_rules and kept for every row of docs."""
    m = F.col("_m")
    out = docs.select(
        F.col(id_col).alias("_id"),
        let(
            measures(F.col(text_col)),
            lambda x: F.struct(x.alias("m"), compile_rules(x, rules).alias("failed")),
        ).alias("_m"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_lines"]
    return out.select(
        F.col("_id").alias("doc_id"),
        *[m["m"][c].alias(c) for c in counts],
        m["failed"].alias("failed_rules"),
        F.exists(m["failed"], lambda x: x.isin(*BASE_RULES)).alias("base_failed"),
        (F.size(m["failed"]) == 0).alias("kept"),
    )


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """docs without the rows that break a rule."""
    failed = let(measures(F.col(text_col)), lambda x: compile_rules(x, rules))
    return docs.where(F.size(failed) == 0)
