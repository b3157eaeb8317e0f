"""Quality rules as a ledger of failure bits, in DataFrame operations only.

`ledger` evaluates every rule once and stores, for each document, one bit a rule (set: failed) and the
measurements behind it. A policy is a version and a mask of the rules it enforces; it is applied to the
stored bits, so a new policy needs no new look at the texts. `ablations` counts, from a histogram of the
bits, what each policy rejects as a whole and without each of its rules.

Defined cases: null has no words, fails the rule on length and nothing that divides by words; measures
are whole numbers, ratios are compared by multiplication; each row is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

_BLANK = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str  # SQL on the measurements


#: The place in the list is the bit. Never reorder: append.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("digits", "100 * n_digits > 40 * word_chars"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Versions of policies: the bits that reject.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["capitals"],
    "v2": (1 << len(RULES)) - 1,
}


def _count(text: Column, others: str) -> Column:
    """Characters left when all runs of others are gone."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and measurements. Words are runs of characters other than blank ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.btrim(text, F.lit(_BLANK)).alias("inner"))
    split = trimmed.select("id", "text", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", r"[ \x09-\x0D]+")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "").alias("lines"))
    n = F.size("w")
    # a long for each window of three words: its hash above, its place below in as many bits as the places need
    bits = F.length(F.bin(n))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    keyed = split.select("*", low.alias("low"), F.sort_array(F.transform(places, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(-F.lit(1).cast("long") - low).bitwiseOR(i.cast("long")))).alias("grams"))
    word = lambda x, j: F.get("w", (x.bitwiseAND(F.col("low")) + j).cast("int"))
    # equal hashes are checked on the words themselves
    same = lambda x, y: (F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.length(F.bin(F.size("w")))) == 0) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    twice = F.filter("grams", lambda x, j: ((j > 0) & same(x, F.get("grams", j - 1))) | F.coalesce(same(x, F.get("grams", j + 1)), F.lit(False)))
    found = keyed.select("id", "text", "w", "lines", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("low")))).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(a["to"], x)).alias("n"), (x + 3).alias("to")), lambda a: a["n"])
    return found.select(
        "id",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("text"), r"[^A-Z]+").alias("n_capitals"),
        _count(F.col("text"), r"[^0-9]+").alias("n_digits"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and `failed`, the bits of the rules that a document fails, as a stored table: each text is looked at once, whatever policies and filters follow."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return stored(measured(docs, id_col, text_col).withColumn("failed", bits))


def apply_policy(book: DataFrame, version: str) -> DataFrame:
    """The ledger with base_failed and kept under this version."""
    failed = F.col("failed")
    return book.withColumn("base_failed", failed.bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", failed.bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0)


def ablations(book: DataFrame) -> DataFrame:
    """policy, without (a rule's name or null), rejected, saved: documents kept only because the rule is left out."""
    histogram = book.groupBy("failed").agg(F.count("*").alias("docs"))  # at most 2 ** rules rows
    variants = [(version, rule, mask & ~BIT.get(rule, 0), mask) for version, mask in POLICIES.items() for rule in [None, *(r.name for r in RULES if mask & BIT[r.name])]]
    table = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(w).cast("string").alias("without"), F.lit(m).cast("long").alias("mask"), F.lit(x).cast("long").alias("whole")) for p, w, m, x in variants])
    pairs = histogram.select("failed", "docs", F.inline(table))
    sums = pairs.groupBy("policy", "without").agg(
        F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.col("mask")) != 0, F.col("docs"))), F.lit(0).cast("long")).alias("rejected"),
        F.coalesce(F.sum(F.when((F.col("failed").bitwiseAND(F.col("mask")) == 0) & (F.col("failed").bitwiseAND(F.col("whole")) != 0), F.col("docs"))), F.lit(0).cast("long")).alias("saved"),
    )
    return sums
