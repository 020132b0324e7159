"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document; the ledger keeps the measurements and one
bit per failed rule. Policies are versioned bit masks over the ledger, and ablations (what
a policy would keep without one of its rules) are sums over bitwise tests. All of it is
DataFrame expressions in one pass over the text, with no shuffle before the ablation sums.

Defined results: null or empty text has no words (it fails ``few_words``); a null doc_id is
passed through; repeated rows are judged one by one; other columns are not read. A text of
any length is one array of words and one sorted array of its 3-word windows, n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import let, plain_words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over MEASURES, never null. bit: its place in the ledger, for good."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 2 * n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("shouting", 4, "100 * n_upper > 40 * word_chars"),
    Rule("word_length", 5, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[n] for n in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def _windows(words: Column) -> Column:
    """Hash of each 3-word window, in order."""
    return F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.size(words) - 2)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash stands at two or more places.

    Windows are sorted by hash with their places; equal neighbours are repeats. Each repeated
    start covers three words, less what the next repeated start covers again.
    """
    repeated = lambda s: F.filter(
        s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False)
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.get(p, i + 1) - x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(placed, lambda s: let(F.sort_array(F.transform(repeated(s), lambda x: x["p"])), covered))


def _repeat_words(words: Column) -> Column:
    """Most texts repeat no window: a hash set tells, and the sort is done for the others alone."""
    found = let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= 3, found).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default doc_id) and the MEASURES, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(
        plain_words(F.col(text)),
        lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    # one pass drops all but symbols and capitals; what is left is short
    by_char = let(
        F.regexp_replace(t, r"[^#*$%&|<>A-Z]+", ""),
        lambda x: F.struct(F.length(F.regexp_replace(x, "[A-Z]+", "")).alias("n_symbols"), F.length(F.regexp_replace(x, "[^A-Z]+", "")).alias("n_upper")),
    )
    kept = keep or ["doc_id"]
    # inline() keeps later filters from being pushed below, where they would repeat the measuring
    got = docs.select(*kept, F.inline(F.array(F.struct(by_word.alias("w"), by_line.alias("l"), by_char.alias("c")))))
    place = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l", "n_symbols": "c", "n_upper": "c"}
    return got.select(*kept, *(F.col(f"{place[m]}.{m}").cast("long").alias(m) for m in MEASURES))


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with failure_bits: bit r.bit is set where rule r fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failure_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablate(led: DataFrame, policies: list[Policy], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents, kept with the policy, kept without the rule.

    The ledger is first summed by distinct bit patterns, at most 2 ** len(rules) of them, so
    what follows doesn't grow with the documents.
    """
    by_bits = led.groupBy("failure_bits").agg(F.count("*").alias("n"))
    names = {r.name: r for r in rules}
    tests = [(p.version, n, p.mask(rules), p.mask(rules) & ~(1 << names[n].bit)) for p in policies for n in p.rules]
    total = lambda m: F.sum(F.when(F.col("failure_bits").bitwiseAND(F.lit(m).cast("long")) == 0, F.col("n")).otherwise(0))
    rows = [F.struct(F.lit(v).alias("policy"), F.lit(n).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(total(full), F.lit(0)).alias("kept"), F.coalesce(total(less), F.lit(0)).alias("kept_without")) for v, n, full, less in tests]
    return by_bits.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def write_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger of docs as Parquet at path, read again: any number of policies can be applied to it, and
    ablations computed, without measuring a text twice."""
    ledger(measure(docs)).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def apply(led: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """doc_id, measurements, base_failed, kept, failure_bits and the policy's version."""
    return led.select("doc_id", *MEASURES[:5], (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(policy)).alias("kept"), *MEASURES[5:], "failure_bits", F.lit(policy.version).alias("policy"))


def judge(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """apply() on the ledger of docs, which is not stored."""
    return apply(ledger(measure(docs)), policy)


def keep_passing(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of docs that pass BASE and policy, with the columns of docs."""
    cols = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("_row"), F.col("text"))
    return ledger(measure(held, keep=["_row"])).filter(passes(BASE) & passes(policy)).select("_row.*")
