"""Quality rules whose cutoffs come with a guarantee on labelled holdouts.

Base counts are taken in one pass over the texts and written once, without the texts. Each rule compares
one feature with a cutoff. The labelled documents are the holdout: per stratum, rule and candidate cutoff
Spark counts how many labelled-good documents the cutoff would reject. A cutoff is admissible if the exact
binomial tail says that a false rejection rate of ``risk / rules`` or more would show so few rejections with
probability at most ``delta / (strata * rules)``. That is Bonferroni's correction over strata and rules; over
the cutoffs of one rule none is needed, as they are nested and admitted from the widest inwards (fixed
sequence). So with probability ``1 - delta`` all chosen cutoffs hold at once, and all rules together reject
less than ``risk`` of the good documents of any stratum. Of the admissible cutoffs the one with most
labelled-bad documents rejected, less ``GOOD_WEIGHT`` times the good ones, is used; equal ones fall to the
widest. A stratum with too few labels gets no cutoff and so
loses nothing beyond the base rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.text import Texts, mix, ready, slices
from helioframe.session import persist_table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RISK = 0.05
DELTA = 0.05
GOOD_WEIGHT = 10

#: rule -> feature and candidate cutoffs; a document is rejected if the feature lies above the cutoff
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0, 3.0)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25)),
    "lines": ("n_dup_lines / greatest(n_words, 1)", (0.005, 0.01, 0.02, 0.05, 0.1, 0.2)),
    "long_words": ("word_chars / greatest(n_words, 1)", (6.0, 7.0, 8.0, 10.0, 12.0, 16.0)),
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count_texts(run: Texts) -> dict[str, np.ndarray]:
    words = run.words()
    head = (run.data & 0xC0) != 0x80
    found, first, text = run.windows(words, WINDOW)
    repeated = _repeated(found, text)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, first[repeated], 1)
    np.add.at(edge, first[repeated] + WINDOW, -1)

    breaks = np.flatnonzero(run.data == 0x0A)
    starts = np.concatenate([run.borders[:-1], breaks + 1])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    owner = np.concatenate([np.arange(run.n), np.searchsorted(run.borders, breaks, side="right") - 1])[order]
    ends = np.concatenate([breaks, run.borders[1:]])
    ends.sort()
    full = np.concatenate([[0], np.cumsum(run.solid)])
    real = full[ends] > full[starts]
    lines, owner = run.hashes(starts[real], ends[real]), owner[real]
    _, kept = np.unique(_keyed(lines, owner), return_index=True)
    duplicate = np.ones(len(lines), dtype=bool)
    duplicate[kept] = False
    return {
        "n_words": run.n_words,
        "word_chars": run.per_text(run.solid & head),
        "n_symbols": run.per_text(_SYMBOL[run.data]),
        "n_dup_lines": np.bincount(owner[duplicate], minlength=run.n),
        "n_repeat_words": run.per_text_words(np.cumsum(edge[:-1]) > 0),
    }


def _keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions whose value occurs again under the same owner."""
    keys = _keyed(hashes, owner)
    in_order = np.sort(keys)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    return np.flatnonzero(np.isin(keys, twice)) if len(twice) else np.zeros(0, dtype=np.int64)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with the counts. Null text counts as empty; columns of these names are replaced."""
    ready(docs.sparkSession)
    kept = [c for c in docs.columns if c != text and c not in COUNTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], *[f"{c} bigint" for c in COUNTS]])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_texts(run) for run in slices(batch.column(len(kept)))]
            if parts:
                counts = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *counts], names=[*kept, *COUNTS])

    return rows.mapInArrow(step, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def log_tail(rejected: int, total: int, rate: float) -> float:
    """log P(Bin(total, rate) <= rejected), exact up to rounding."""
    if rejected >= total:
        return 0.0
    if rejected > total * rate:
        return math.log(0.5)      # above the mean: never below any useful level
    i = np.arange(1, rejected + 1, dtype=np.float64)
    steps = np.log((total - i + 1) / i) + math.log(rate) - math.log1p(-rate)
    terms = total * math.log1p(-rate) + np.concatenate([[0.0], np.cumsum(steps)])
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def holdout_counts(counts: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id") -> DataFrame:
    """Per stratum, rule and cutoff: labelled good and bad documents that pass the base rule, and how many of each are rejected."""
    marked = labels.filter("quality is not null").groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_good"))
    held = counts.filter(~base_failed()).join(marked, F.col(key) == F.col("_key"))
    good, bad = F.col("_good") == 1, F.col("_good") == 0
    sums = [F.sum(good.cast("long")).alias("n_good"), F.sum(bad.cast("long")).alias("n_bad")]
    for name, (feature, cutoffs) in RULES.items():
        for i, cut in enumerate(cutoffs):
            over = F.expr(feature) > F.lit(cut)
            sums += [F.sum((good & over).cast("long")).alias(f"g_{name}_{i}"), F.sum((bad & over).cast("long")).alias(f"b_{name}_{i}")]
    wide = held.groupBy(F.col(stratum).alias("stratum")).agg(*sums)
    tests = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(cut).alias("cutoff"), F.col(f"g_{name}_{i}").alias("good_rejected"), F.col(f"b_{name}_{i}").alias("bad_rejected"))
        for name, (_, cutoffs) in RULES.items() for i, cut in enumerate(cutoffs)]))
    return wide.select("stratum", "n_good", "n_bad", tests.alias("t")).select("stratum", "n_good", "n_bad", "t.*")


def thresholds(counts: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One line per stratum with a cutoff per rule (null: none admissible)."""
    tests = holdout_counts(counts, labels, stratum)
    tests = persist_table(tests, "holdout")
    strata = max(1, tests.select("stratum").distinct().count())
    rate = risk / len(RULES)

    @F.pandas_udf("double")
    def tail(rejected: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([log_tail(int(k), int(n), rate) if n else 0.0 for k, n in zip(rejected, total, strict=True)])

    judged = tests.withColumn("tail", tail("good_rejected", "n_good"))
    level = math.log(delta / (len(RULES) * strata))
    gain = F.col("bad_rejected") - GOOD_WEIGHT * F.col("good_rejected")
    useful = judged.filter((F.col("tail") <= level) & (gain > 0))
    best = useful.groupBy("stratum", "rule").agg(F.max(F.struct(gain, "cutoff")).alias("best"))
    return best.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == name, F.col("best.cutoff"))).alias(f"cut_{name}") for name in RULES])


def judge(counts: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts with ``base_failed``, the rules that reject (``rejected_by``), and ``kept``."""
    over = [F.when(F.expr(feature) > F.col(f"cut_{name}"), F.lit(name)) for name, (feature, _) in RULES.items()]
    rows = counts.join(cuts, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    return rows.withColumns({"base_failed": base_failed(), "rejected_by": F.array_compact(F.array(*over))}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("stratum", *[f"cut_{name}" for name in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per document without its text.

    Null or empty text has no words and fails the base rule; a null key is judged, only never labelled;
    repeated keys are judged row by row; the lowest label of a key counts; a null stratum is one of its own;
    empty tables give empty results.
    """
    counts = persist_table(base_counts(_needed(docs, key, stratum)), "quality")
    return judge(counts, thresholds(counts, labels, stratum), stratum)


def _needed(docs: DataFrame, key: str, stratum: str, text: str = "text") -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((key, stratum))], F.col(f"`{text}`").alias("text"))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, whole and with all their columns.

    The counts are taken again next to the texts rather than joined to them: cutoffs are one line per stratum,
    so the texts are read twice but never shuffled. Null and empty texts fail the base rule and go; null and repeated
    keys and a null stratum as in ``quality_rules``: what it keeps stays, row by row. Columns may have any names; an empty
    table gives no rows; without labels only the base rule rejects.
    """
    cuts = persist_table(thresholds(persist_table(base_counts(_needed(docs, key, stratum, text)), "quality"), labels, stratum), "cutoffs")
    names = [f"_q_{c}" for c in docs.columns]
    with_text = base_counts(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(f"`{text}`").alias("_body")), "_body")
    judged = judge(with_text, cuts, f"_q_{stratum}").filter("kept")
    return judged.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
