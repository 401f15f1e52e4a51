"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a versioned mask over these bits, so changing a policy, or
asking what each rule costs, is bitwise arithmetic over the ledger and no second scan of
the texts.

The measuring is DataFrame functions over one row at a time: no shuffle, no Python worker,
memory bounded by the longest single text. ``stored`` writes the ledger, a few numbers a
document, and policies and ablations read it from there.

Defined cases: a null text is an empty text; a text without words fails ``too_few_words``
only; very long texts are measured whole; ties at a bound pass, as each rule says; a null id
passes through; repeated rows give repeated ledger rows; an empty table gives an empty ledger
and ablations of zeros; extra columns of the input are not carried and cannot clash; a policy
that names an unknown rule is an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.text import BLANKS, dropped_chars, let, lines, words
from bindery.storage import materialize

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
LEDGER_VERSION = 1


@dataclass(frozen=True)
class Rule:
    """One rule: its bit, its name, and the SQL over measurements that is true on failure."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES: tuple[Rule, ...] = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_ratio", "n_words > 0 AND 10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words)"),
    Rule(5, "few_letters", "2 * n_letters < word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    def __post_init__(self) -> None:
        if unknown := set(self.rules) - {rule.name for rule in RULES}:
            raise ValueError(f"no such rules: {sorted(unknown)}")

    @property
    def mask(self) -> int:
        return sum(rule.mask for rule in RULES if rule.name in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_words"))
WEB = Policy("web-1", tuple(rule.name for rule in RULES))


def _windows(w: Column) -> Column:
    """The 3-word windows of words with their places, sorted."""
    return F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")),
        )
    )


def _repeated_places(s: Column) -> Column:
    """The places of sorted windows that equal a neighbour, in order."""
    same = lambda i, j: F.coalesce(F.get(s, i)["g"] == F.get(s, j)["g"], F.lit(False))
    return F.sort_array(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1)),
            lambda i: F.get(s, i)["p"],
        )
    )


def _covered_words(p: Column) -> Column:
    """Words that windows at these places cover: three each, less the overlap with the next."""
    return F.when(
        F.size(p) > 0,
        F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1),
            F.lit(0).cast("long"),
            lambda acc, i: acc + F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(3))),
        ),
    ).otherwise(F.lit(0).cast("long"))


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Each step is bound to a lambda variable, so a filter on a measurement, which the
    optimizer rewrites in terms of the text, evaluates it once more and not once per word.
    """
    found = let(w, lambda own: let(_windows(own), lambda s: let(_repeated_places(s), _covered_words)))
    return F.when(F.size(w) >= 4, found).otherwise(F.lit(0).cast("long"))


def measurements(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measurements (long) that the rules read."""
    split = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    ).select("doc_id", "t", words(F.col("t")).alias("w"), lines(F.col("t")).alias("l"))
    worded = F.filter(F.col("l"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.length(dropped_chars(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(dropped_chars(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def failure_bits(rules: Sequence[Rule] = RULES) -> Column:
    """The failed rules of a row of measurements as one long."""
    return reduce(
        lambda bits, rule: bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long")),
        rules,
        F.lit(0).cast("long"),
    )


def ledger(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Measurements, ``failed`` (long, a bit per rule) and the version of the rules."""
    return measurements(docs, doc_id, text).select(
        "*", failure_bits(rules).alias("failed"), F.lit(LEDGER_VERSION).alias("ledger_version")
    )


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger of all rules as a written table; the texts are not read again."""
    return materialize(ledger(docs, doc_id, text), "quality-ledger")


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and the policy's version."""
    return book.select(
        "*",
        (F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0).alias("kept"),
        F.lit(policy.version).alias("policy"),
    )


def ablations(book: DataFrame, policies: Mapping[str, Policy] | Sequence[Policy] = (BASE, WEB)) -> DataFrame:
    """What each rule of each policy removes, in one aggregation over the ledger.

    One row per policy and rule: n_failed (rule failed), n_only (failed this rule and no
    other of the policy), kept, kept_without (kept were the rule left out).
    """
    chosen = list(policies.values()) if isinstance(policies, Mapping) else list(policies)
    pairs = [(policy, rule) for policy in chosen for rule in RULES if rule.mask & policy.mask]
    sums: list[Column] = []
    for k, (policy, rule) in enumerate(pairs):
        under = F.col("failed").bitwiseAND(F.lit(policy.mask))
        rest = F.col("failed").bitwiseAND(F.lit(policy.mask & ~rule.mask))
        sums += [
            F.count_if(under.bitwiseAND(F.lit(rule.mask)) != 0).alias(f"failed_{k}"),
            F.count_if(under == rule.mask).alias(f"only_{k}"),
            F.count_if(under == 0).alias(f"kept_{k}"),
            F.count_if(rest == 0).alias(f"without_{k}"),
        ]
    totals = book.agg(*sums)
    rows = F.array(
        *(
            F.struct(
                F.lit(policy.version).alias("policy"),
                F.lit(rule.name).alias("rule"),
                F.col(f"failed_{k}").alias("n_failed"),
                F.col(f"only_{k}").alias("n_only"),
                F.col(f"kept_{k}").alias("kept"),
                F.col(f"without_{k}").alias("kept_without"),
            )
            for k, (policy, rule) in enumerate(pairs)
        )
    )
    return totals.select(F.inline(rows))


def op1_quality_rules(spark, sf_dir) -> DataFrame:
    """Measurements, base verdict and the verdict of policy ``web-1`` for all documents, from
    the stored ledger."""
    book = apply_policy(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")), WEB)
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        "kept",
        "failed",
    )


def quality_ablations(spark, sf_dir) -> DataFrame:
    """What each rule of the policies ``base-1`` and ``web-1`` removes from all documents."""
    return ablations(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d
), places AS (
  SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3
), windows AS (
  SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM places
), repeated AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n >= 2
), covered AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id,
    len(w.w)::BIGINT AS n_words,
    len(l)::BIGINT AS n_lines,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters,
    (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 0 AND 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


def _ablations_oracle() -> str:
    pairs = ", ".join(
        f"('{policy.version}', '{rule.name}', {policy.mask}, {rule.mask})"
        for policy in (BASE, WEB)
        for rule in RULES
        if rule.mask & policy.mask
    )
    return f"""
SELECT policy, rule, count(*) FILTER (WHERE failed & own <> 0) AS n_failed, count(*) FILTER (WHERE failed & mask = own) AS n_only,
  count(*) FILTER (WHERE failed & mask = 0) AS kept, count(*) FILTER (WHERE failed & (mask - own) = 0) AS kept_without
FROM ({ORACLE}) b, (VALUES {pairs}) v(policy, rule, mask, own) GROUP BY policy, rule
"""


ABLATIONS_ORACLE = _ablations_oracle()
