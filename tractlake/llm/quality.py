"""Operator 9: quality rules whose cutoffs have a guaranteed risk.

Text statistics are exact and taken from whole texts. A rule rejects a document whose
metric is beyond a cutoff. Cutoffs come from labelled documents that pass the base rule.

- A quarter of them, by a hash of the id, puts all (rule, cutoff) steps of a stratum in an
  order: the share of good documents rejected, pulled towards the share in all strata, then
  the share of bad ones. Steps that reject no larger share of bad than of good are left out,
  and then those of which that holds for the documents that no earlier step rejects. A stratum
  without bad documents in that quarter has nothing to tell by, and keeps the latter.
- The others are the holdout. A policy is all steps up to a place in the order; it is accepted
  if ``P(Binomial(n, risk) <= k) <= level`` for the ``k`` of ``n`` good held-out documents that
  any of its rules rejects. Policies are tested in order, up to the first failure, so the tests
  of one stratum need no correction among themselves, and the limit is that of the verdict.
- Holm's correction over strata: the level is ``error`` over the strata whose policies aren't
  all accepted. A stratum whose last policy passes can hold no false acceptance.
- A stratum with so few good held-out labels that not even zero rejections would do is judged
  together with all others of that kind, in the order of all strata. The limit holds for those
  strata together. Which they are follows from the numbers of labels only.

With probability ``1 - error`` the rules reject at most ``risk`` of the good documents in every
stratum that has labels enough, and in the rest together. A stratum without a good held-out
label, or where no policy is accepted, has the base rule only.

Null or empty texts have zero words and fail the base rule. Repeated rows are each judged;
each counts when its label is known. A document with several labels is good if all are.
Labels that are null, or of documents not there, don't count. Null strata are a stratum.
Without labels only the base rule works. Empty tables give empty tables. Input columns with
an output's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.base import SPACE, Query, materialize, table, utf8

SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: One in so many labelled documents orders the steps, the others are held out.
SHARES = 4
#: Documents by which the shares of all strata weigh on a stratum's own.
PRIOR = 200
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_marks",
)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    keys = ids
    for step in range(1, window):
        keys = keys[:-1] * len(numbers) + ids[step:]
        if step + 1 < window and len(numbers) > 1_000_000:  # keeps the product in 64 bits
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for step in range(window):
        covered[step : step + len(keys)] |= twice
    return int(covered.sum())


def measures(text: bytes) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, b"!?^~=")),
    )


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and one column for each of ``MEASURES``."""
    source = docs.select(*keep, utf8(text).alias("__text"))
    kept = source.drop("__text").schema
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{m} long" for m in MEASURES]
    )
    names = list(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(value.as_py()) for value in batch.column("__text")]
            values = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)]
                + [pa.array(values[:, i]) for i in range(len(names))],
                [*batch.schema.names[:-1], *names],
            )

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Rejects ``metric >= cutoff``, or ``<=`` if ``low``; ``cutoffs`` from lenient to strict."""

    name: str
    metric: Column
    cutoffs: tuple[float, ...]
    low: bool = False

    def rejects(self, cutoff) -> Column:
        return self.metric <= cutoff if self.low else self.metric >= cutoff


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def _grid(first: float, last: float, steps: int) -> tuple[float, ...]:
    return tuple(round(x, 4) for x in np.linspace(first, last, steps))


def default_rules() -> list[Rule]:
    """Metrics and the cutoffs to try: fixed grids, which don't depend on the data."""
    length = F.coalesce(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")), F.lit(0.0))
    return [
        Rule("symbols", _share("n_symbols", "n_words"), _grid(1.0, 0.05, 20)),
        Rule("same_lines", _share("n_dup_lines", "n_lines"), _grid(0.95, 0.05, 19)),
        Rule("same_words", _share("n_repeat_words", "n_words"), _grid(0.5, 0.05, 10)),
        Rule("capitals", _share("n_upper", "word_chars"), _grid(1.0, 0.05, 20)),
        Rule("marks", _share("n_marks", "n_words"), _grid(1.0, 0.05, 20)),
        Rule("long_words", length, _grid(15.0, 5.5, 20)),
        Rule("short_words", length, _grid(1.0, 4.0, 13), low=True),
    ]


def chance(n: int, k: int, risk: float) -> float:
    """``P(Binomial(n, risk) <= k)``, by the exact sum."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log(np.maximum(n - i[:-1], 1)) - np.log(i[:-1] + 1.0)
    ways = np.concatenate([[0.0], np.cumsum(steps)])
    logs = ways + i * math.log(risk) + (n - i) * math.log1p(-risk)
    top = logs.max()
    return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")
    )


def order_steps(n, good, m, bad, pooled) -> list[int | None]:
    """The place of each step, lenient first; None for steps that are left out.

    ``good`` of ``n`` good and ``bad`` of ``m`` bad documents are rejected by each step; ``pooled``
    has the same four of all strata, and counts as ``PRIOR`` documents more.
    """
    all_n, all_good, all_m, all_bad = pooled

    def shares(count, size, all_count, all_size):
        towards = np.asarray(all_count, float) / max(all_size, 1)
        return (np.asarray(count, float) + PRIOR * towards) / (size + PRIOR)

    lost, caught = shares(good, n, all_good, all_n), shares(bad, m, all_bad, all_m)
    used = [i for i in range(len(lost)) if caught[i] > lost[i]]
    places: list[int | None] = [None] * len(lost)
    for place, i in enumerate(sorted(used, key=lambda i: (lost[i], -caught[i], i))):
        places[i] = place
    return places


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    rules: list[Rule],
    stratum: str = "lang",
    risk: float = 0.01,
    error: float = 0.05,
) -> DataFrame:
    """(stratum, one column of cutoffs per rule); null where no cutoff is proven.

    ``labels``: (doc_id, quality), 1 for good. All labelled documents count. ``risk`` is the
    limit for all rules together.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("__good"))
    )
    steps = [(rule, cutoff) for rule in rules for cutoff in rule.cutoffs]
    fired = F.array(*[F.coalesce(rule.rejects(F.lit(c)), F.lit(False)) for rule, c in steps])
    labelled = materialize(
        measured.filter(~base_failed())
        .join(known, "doc_id")
        .select(
            F.col(stratum).alias("__stratum"),
            "__good",
            (F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) != 0).alias("__held"),
            fired.alias("__fired"),
        ),
        "rule-steps",
    )
    rates = materialize(_rates(labelled, len(steps)), "rule-rates")
    ordered = materialize(_paths(rates, len(steps), risk, error), "rule-orders")
    paths = materialize(_gaining(labelled, ordered, len(steps)), "rule-paths")
    tested = materialize(_tested(labelled, paths, len(steps), risk), "rule-tests")
    level = error / max(1, _left(tested, error))
    failing = F.array_position(F.transform("chances", lambda p: p > level), True)
    passed = F.when(failing == 0, F.size("chances")).otherwise(failing - 1)
    depth = paths.join(
        tested.select("__small", F.col("__chain").alias("__of"), passed.alias("__depth")),
        (paths["__small"] == tested["__small"]) & paths["__chain"].eqNullSafe(F.col("__of")),
        "left",
    )
    columns, at = [], 0
    for rule in rules:
        reached = F.array_max(
            F.array(
                *[
                    F.when(F.col("__path")[at + j] < F.col("__depth"), F.lit(j + 1))
                    for j in range(len(rule.cutoffs))
                ]
            )
        )
        grid = F.array(*[F.lit(float(c)) for c in rule.cutoffs])
        columns.append(F.get(grid, reached - 1).alias(rule.name))
        at += len(rule.cutoffs)
    return materialize(depth.select("__stratum", *columns), "rule-cutoffs")


def _rates(labelled: DataFrame, steps: int) -> DataFrame:
    """By stratum: documents that order the steps, those that each step rejects, and the held out."""
    fit = ~F.col("__held")

    def rejected(kind: Column) -> Column:
        return F.array(*[F.count_if(fit & kind & F.col("__fired")[i]) for i in range(steps)])

    good = F.col("__good")
    return labelled.groupBy("__stratum").agg(
        F.count_if(fit & good).alias("n"),
        rejected(good).alias("good"),
        F.count_if(fit & ~good).alias("m"),
        rejected(~good).alias("bad"),
        F.count_if(~fit & good).alias("held"),
    )


def _paths(rates: DataFrame, steps: int, risk: float, error: float) -> DataFrame:
    """(stratum, small, chain, path): the order of steps; small strata share the chain null."""

    def total(name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.col(name)[i]), F.lit(0)) for i in range(steps)])

    whole = rates.agg(
        F.count("*").alias("strata"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        total("good").alias("good"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("m"),
        total("bad").alias("bad"),
    ).first()
    pooled = (whole.n, whole.good, whole.m, whole.bad)
    limit = error / (whole.strata + 1)
    common = order_steps(*pooled, pooled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [chance(n, 0, risk) > limit for n in batch.column("held").to_pylist()]
            own = zip(*[batch.column(c).to_pylist() for c in ("n", "good", "m", "bad")])
            found = [common if s else order_steps(*row, pooled) for s, row in zip(small, own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__stratum"), pa.array(small), pa.array(found, pa.list_(pa.int32()))],
                ["__stratum", "__small", "__path"],
            )

    kind = rates.schema["__stratum"].dataType.simpleString()
    found = rates.mapInArrow(run, f"__stratum {kind}, __small boolean, __path array<int>")
    return found.withColumn("__chain", F.when(~F.col("__small"), F.col("__stratum")))


def _first(labelled: DataFrame, paths: DataFrame, steps: int) -> DataFrame:
    """``labelled`` with its chain, and the place of the first step that rejects each document."""
    of = paths.withColumnRenamed("__stratum", "__of")
    place = F.array_min(
        F.array(*[F.when(F.col("__fired")[i], F.col("__path")[i]) for i in range(steps)])
    )
    return labelled.join(of, F.col("__stratum").eqNullSafe(F.col("__of"))).select(
        "__good", "__small", "__chain", "__path", place.alias("__first")
    )


def _gaining(labelled: DataFrame, paths: DataFrame, steps: int) -> DataFrame:
    """``paths`` without the steps that add no larger share of bad than of good documents."""

    def new(kind: Column) -> Column:
        return F.array(*[F.count_if(kind & (F.col("__first") == i)) for i in range(steps)])

    good = F.col("__good")
    gains = (
        _first(labelled.filter("NOT __held"), paths, steps)
        .groupBy(F.col("__small").alias("__few"), F.col("__chain").alias("__of"))
        .agg(
            F.count_if(good).alias("n"),
            F.count_if(~good).alias("m"),
            new(good).alias("good"),
            new(~good).alias("bad"),
        )
    )
    kept = F.transform(
        "__path",
        lambda p: F.when(
            (F.coalesce("m", F.lit(0)) == 0)
            | (F.get("bad", p) * F.col("n") > F.get("good", p) * F.col("m")),
            p,
        ),
    )
    return paths.join(
        gains,
        (paths["__small"] == F.col("__few")) & paths["__chain"].eqNullSafe(F.col("__of")),
        "left",
    ).select("__stratum", "__small", kept.alias("__path"), "__chain")


def _tested(labelled: DataFrame, paths: DataFrame, steps: int, risk: float) -> DataFrame:
    """(small, chain, chances): for each policy, how unlikely so few rejections would be."""
    counts = (
        _first(labelled.filter("__held AND __good"), paths, steps)
        .groupBy("__small", "__chain")
        .agg(
            F.count("*").alias("n"),
            F.max(F.coalesce(F.array_max("__path") + 1, F.lit(0))).alias("length"),
            F.array(*[F.count_if(F.col("__first") == i) for i in range(steps)]).alias("rejected"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("n", "length", "rejected")])
            chances = [
                [chance(n, int(k), risk) for k in np.cumsum(rejected[:length])]
                for n, length, rejected in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__small"), batch.column("__chain"), pa.array(chances, pa.list_(pa.float64()))],
                ["__small", "__chain", "chances"],
            )

    kind = paths.schema["__chain"].dataType.simpleString()
    return counts.mapInArrow(run, f"__small boolean, __chain {kind}, chances array<double>")


def _left(tested: DataFrame, error: float) -> int:
    """Chains that are not wholly accepted, at the level that their own number gives (Holm)."""
    worst = F.coalesce(F.array_max("chances"), F.lit(0.0))
    chains = left = tested.count()
    while left:
        now = chains - tested.filter(worst <= error / left).count()
        if now == left:
            break
        left = now
    return left


def judge(
    measured: DataFrame, cutoffs: DataFrame, rules: list[Rule], stratum: str = "lang"
) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    base = base_failed()
    marked = cutoffs.select("__stratum", *[F.col(r.name).alias(f"__{r.name}") for r in rules])
    broken = F.lit(False)
    for rule in rules:
        broken = broken | F.coalesce(rule.rejects(F.col(f"__{rule.name}")), F.lit(False))
    return (
        measured.drop("base_failed", "kept")
        .join(marked, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
        .select(
            *[F.col(c) for c in measured.columns if c not in ("base_failed", "kept")],
            base.alias("base_failed"),
            (~base & ~broken).alias("kept"),
        )
    )


def verdicts(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Measures and verdicts of ``docs``; ``keep`` are columns to carry along."""
    rules = default_rules()
    carried = list(dict.fromkeys(["doc_id", "lang", *(keep or [])]))
    measured = materialize(measure(docs, carried), "measured")
    return judge(measured, fit_cutoffs(measured, labels, rules), rules)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    The cutoffs are fitted on one pass over the texts, and applied in a second one that
    carries each text along with its own measures; no join brings texts and verdicts together.
    """
    rules = default_rules()
    own = docs.columns
    fit = materialize(measure(docs, ["doc_id", "lang"]), "measured")
    cutoffs = fit_cutoffs(fit, labels, rules)
    clear = docs.select([F.col(c).alias(f"__own_{c}") for c in own] + [F.col("lang")])
    judged = judge(measure(clear, clear.columns, "__own_text"), cutoffs, rules)
    return judged.filter("kept").select([F.col(f"__own_{c}").alias(c) for c in own])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


QUERIES = [Query("op9_quality_rules", op9_quality_rules)]
