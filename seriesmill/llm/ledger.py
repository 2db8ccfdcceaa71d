"""Quality rules as a ledger of failure bits: rules run once, policies are masks over the bits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, not once for each use."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three that occur twice or more in the array."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("i"))))
        repeated = _let(placed, lambda s: F.array_sort(F.filter(
            F.transform(s, lambda x, k: F.when(
                ((k > 0) & (F.get(s, k - 1)["key"] == x["key"])) | (F.get(s, k + 1)["key"] == x["key"]), x["i"])),
            lambda i: i.isNotNull(),
        )))
        # Each window adds the words up to the next one, three at most.
        return _let(repeated, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0), lambda total, x: total + x,
        ))

    counted = _let(hashes, lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(covered(keys)))
    return F.when(F.size(words) < 3, 0).otherwise(counted)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns of ``MEASURES`` (long).

    Words are runs of characters other than ASCII white space; null has none.  Columns of ``df`` with
    the same names are replaced.  Every value is computed in the row: nothing is shuffled.  Windows are
    compared by a 64-bit hash, within one text only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    # Each struct is used several times, so Spark computes it in a projection of its own.
    of_words = _let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct_words"),
    ))
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    ))
    count = lambda kept: F.char_length(F.regexp_replace(text, kept, ""))
    sources = {"n_lines": "__l", "n_dup_lines": "__l"}
    values = df.select("*", of_words.alias("__w"), of_lines.alias("__l"))
    plain = {"n_symbols": count(r"[^#*$%&|<>]+"), "n_upper": count(r"\P{Lu}+")}
    return values.withColumns({
        m: (plain[m] if m in plain else F.col(f"{sources.get(m, '__w')}.{m}")).cast("long") for m in MEASURES
    }).drop("__w", "__l")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measures; true sets the rule's bit."""

    name: str
    fails: str


# The bit of a rule is its place; new rules go to the end so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)"),
    Rule("upper_case", "n_words >= 10 AND 2 * n_upper > word_chars"),
    Rule("few_distinct", "n_words >= 50 AND n_words < 1000 AND 5 * n_distinct_words < n_words"),
)

# A policy is the list of rules that reject; versions stay so that older decisions can be repeated.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": tuple(rule.name for rule in RULES),
}


def ledger(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``bits`` (long): bit ``k`` is set where rule ``k`` fails.  Needs the columns of ``measure``."""
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        failed = F.when(F.coalesce(F.expr(rule.fails), F.lit(False)), F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bits.bitwiseOR(failed)
    return df.withColumn("bits", bits)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    place = {rule.name: k for k, rule in enumerate(rules)}
    return sum(1 << place[name] for name in names)


def passes(version: str, bits: str = "bits", rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[version], rules)).cast("long")) == 0


def ablations(df: DataFrame, version: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: rows it fails, rows only it fails (they come back without it).

    ``df`` is a ledger; rows are grouped by bits first, so at most one row per bit pattern is expanded.
    """
    chosen = mask(POLICIES[version], rules)
    patterns = df.groupBy(F.col("bits").bitwiseAND(F.lit(chosen).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    table = F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << place).cast("long").alias("bit"))
        for place, rule in enumerate(rules) if chosen >> place & 1
    ])
    each = patterns.select("bits", "n", F.explode(table).alias("r"))
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_only_this"),
    )
