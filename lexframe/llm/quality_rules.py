"""Quality rules as a bitmask ledger: DataFrame functions only.

``ledger`` evaluates every rule once per document and keeps the measurements and one long of failure bits. A
policy is a version: a name and the bits that reject. Policies and ablations then read the ledger alone:
``apply_policy`` is a bitwise AND, ``ablations`` counts the documents that each rule rejects, that it alone
rejects, and that would be kept without it, from counts by bit pattern.

Repeated words: the hashes (xxhash64 of three words with a separator that no word holds) of a text's 3-word
windows are ordered with their positions; windows equal to a neighbour in that order appear twice or more, and
the words they cover are counted by the gaps between their positions. Texts whose windows all differ skip
that. Nothing leaves the row, so nothing is shuffled and no key can be hot.

Defined results: a null or blank text has no words, all counts 0, and fails the base; ratios of texts without
words are 0; repeated rows are judged alike; an empty table gives an empty ledger. Added columns replace
input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout")


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements, in SQL; its bit is its place in the list of rules."""

    name: str
    fails: str


#: Bits are stable: new rules are added at the end.
RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("shouting", "100 * n_shout > 40 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document."""

    version: str
    rejects: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        place = {rule.name: k for k, rule in enumerate(rules)}
        return sum(1 << place[name] for name in self.rejects)


#: 2 leaves out single-letter languages' rule; 1 is the base alone.
POLICIES = {
    "1": Policy("1", BASE),
    "2": Policy("2", (*BASE, "symbols", "duplicate_lines", "long_words", "shouting")),
    "3": Policy("3", tuple(rule.name for rule in RULES)),
}
CURRENT = "2"


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words() -> Column:
    """Words inside 3-word windows found twice or more; 0 where no windows had to be ordered."""
    return F.expr("""
        case when __ordered is null then 0L else
        aggregate(
            sort_array(filter(
                transform(
                    __ordered,
                    (x, i) -> if(x.h = get(__ordered, i - 1).h or x.h = get(__ordered, i + 1).h, x.p, null)
                ),
                p -> p is not null
            )),
            named_struct('n', 0L, 'next', 0),
            (s, p) -> named_struct(
                'n', s.n + (p + 3 - greatest(s.next, p)), 'next', p + 3),
            s -> s.n
        ) end
    """)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements."""
    docs = docs.select([c for c in docs.columns if c.lower() not in MEASURES])
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("__words", F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), ""))
    windows = F.expr(
        "transform(slice(__words, 1, greatest(size(__words) - 2, 0)),"
        " (w, i) -> xxhash64(w, ' ', get(__words, i + 1), ' ', get(__words, i + 2)))"
    )
    ordered = F.expr(
        "case when size(__windows) <> size(array_distinct(__windows)) then"
        " sort_array(transform(__windows, (h, i) -> struct(h as h, i as p))) end"
    )
    lines = F.expr("filter(__lines, x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    return (
        split.withColumn("__windows", windows)
        .withColumn("__ordered", ordered)
        .withColumn("__lines", F.split(body, "\n"))
        .withColumn("__lines", lines)
        # a generator keeps later filters from being pushed into, and so repeating, the expressions above
        .select(*docs.columns, F.explode(F.array(F.struct(
            F.size("__words").cast("bigint").alias("n_words"),
            (F.length(body) - _count_of(body, BLANKS)).cast("bigint").alias("word_chars"),
            _count_of(body, SYMBOLS).cast("bigint").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
            _repeat_words().alias("n_repeat_words"),
            F.size("__lines").cast("bigint").alias("n_lines"),
            F.regexp_count(body, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")).cast("bigint").alias("n_shout"),
        ))).alias("__measures"))
        .select(*docs.columns, "__measures.*")
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``failures``, one bit per rule."""
    bits = F.lit(0).cast("bigint")
    for place, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(0).cast("bigint"))
    return measure(docs, text).withColumn("failures", bits)


def _hit(mask: int) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask).cast("bigint")) != 0


def apply_policy(
    table: DataFrame, policy: Policy = POLICIES[CURRENT], rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """A ledger with ``base_failed``, ``kept`` and ``policy``."""
    base = Policy("base", BASE).mask(rules)
    return table.withColumn("base_failed", _hit(base)).withColumn(
        "kept", ~_hit(base | policy.mask(rules))
    ).withColumn("policy", F.lit(policy.version))


def ablations(
    table: DataFrame, policy: Policy = POLICIES[CURRENT], rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Per rule of the policy: documents it rejects, rejects alone, and the share kept with and without it."""
    mask = policy.mask(rules)
    patterns = table.groupBy(
        F.col("failures").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")
    ).agg(F.count("*").alias("n"))
    place = {rule.name: k for k, rule in enumerate(rules)}
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << place[name]).cast("bigint").alias("bit"))
        for name in policy.rejects
    ]))
    return patterns.withColumn("r", each).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"),
    ).withColumn("kept_without", F.col("kept") + F.col("rejected_alone"))
