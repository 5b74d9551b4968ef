"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; policies are masks over these bits, so a new policy or an ablation never reads
the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import BLANKS, let, words

# The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"

MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper".split()
)


@dataclass(frozen=True)
class Rule:
    """A document fails where the SQL condition over MEASURES holds."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * word_chars"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "shouting", "100 * n_upper > 50 * word_chars"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_words", "word_chars > 20 * n_words"),
)

# Policies by version: names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[name] for name in POLICIES[policy])


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that are found twice or more.

    Windows are told apart by 64-bit hashes. Texts whose windows all differ stop after one
    hash set; the others sort their windows once and sum the words that the repeated ones
    cover, each word once.
    """

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            hit = F.filter(
                s,
                lambda x, i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False)))
                | ((i < last) & F.coalesce(same(i, i + 1), F.lit(False))),
            )
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        covered = lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda a, b: a + b,
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(let(ordered, starts), covered)
        )

    def windows(v: Column) -> Column:
        n = F.size(v)
        return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.slice(v, 1, F.greatest(n - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2)),
            )
        )

    return let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), counted)


def measurements(text: Column) -> Column:
    """A struct of MEASURES for a text; null counts as the empty text."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    whole = lambda c, name: c.cast("bigint").alias(name)

    def of_words(w: Column) -> Column:
        dense = F.length(F.array_join(w, ""))
        return F.struct(F.size(w).alias("n"), dense.alias("c"), _repeat_words(w).alias("r"))

    def gathered(c: Column, ls: Column) -> Column:
        return F.struct(
            whole(c["n"], "n_words"),
            whole(c["c"], "word_chars"),
            whole(F.regexp_count(full, F.lit(SYMBOLS)), "n_symbols"),
            whole(F.size(ls) - F.size(F.array_distinct(ls)), "n_dup_lines"),
            whole(c["r"], "n_repeat_words"),
            whole(F.size(ls), "n_lines"),
            whole(F.regexp_count(full, F.lit("[A-Z]")), "n_upper"),
        )

    return let(let(words(text), of_words), lambda c: let(lines, lambda ls: gathered(c, ls)))


def failures(measured: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits for a struct column of MEASURES."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        condition = " ".join(f"{measured}.{t}" if t in MEASURES else t for t in rule.fails.split())
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << rule.bit)).otherwise(0))
    return bits


def ledger(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per document: its id, MEASURES and ``failed`` (one bit per rule).

    Null and empty texts have no words and fail ``few_words``. Repeated rows stay repeated,
    null ids stay, other columns are not carried, an empty table gives an empty ledger.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"), measurements(F.col(text_col)).alias("m")
    ).select("doc_id", "m.*", failures("m", rules).alias("failed"))


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy and the ``policy`` itself."""
    return book.withColumns(
        {
            "kept": F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0,
            "policy": F.lit(policy),
        }
    )


def ablation(book: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that the policy
    would keep without it. Works on counts of failure patterns, at most 2^rules rows."""
    full = mask(policy)
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(full)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    wanted = [r for r in rules if full >> r.bit & 1]
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("own")) for r in wanted])
    )
    when = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    has = F.col("bits").bitwiseAND(F.col("r.own")) != 0
    alone = F.col("bits") == F.col("r.own")
    return (
        patterns.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(when(has, "n_failed"), when(alone, "n_alone"), when(alone | (F.col("bits") == 0), "n_kept_without"))
    )


def filtered(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns and no others."""
    inner = docs.select(F.struct("*").alias("row"), measurements(F.col(text_col)).alias("m"))
    return inner.filter(failures("m").bitwiseAND(F.lit(mask(policy))) == 0).select("row.*")
