"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) and, inside words, digits and signs
to the letters they stand for. The automaton holds words and word beginnings with their weights, and
exception phrases: a lexicon word inside one of them doesn't count. The weight of all matches over a
power of the number of words goes through a logistic curve to a score from 0 to 1.

The lexicon is learned from a bounded sample of labelled rows, ``SAMPLE_ROWS`` of each label at most,
chosen by hash; that is the only bound: every term and every exception phrase with the evidence asked for
is in the lexicon, so its size is bounded by the sample's distinct words. A term's evidence counts the different words it follows, not its documents: a term that
only comes with a copied passage always follows the same word. Word beginnings stand for families of
terms. Labels of held-out rows are never read; lang, source and doc_id are no inputs.

Defined results: null and empty texts score as texts without a match; rows without a doc_id are not
learned from; without toxic labels, or with too few of them for any term, every score is
``DEFAULT_SCORE``; a text without a match is never toxic; labels that repeat a doc_id or contradict each
other count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_and_text, materialise, table

SAMPLE_ROWS = 6000
MIN_EVIDENCE = 4
#: An exception phrase stands in so many clean rows of the sample at least, and in no toxic one.
MIN_EXCEPTION = 2
#: Counts of terms that a task combines before it passes them on.
COMBINE = 200_000
#: Evidence times the log ratio of its rates in toxic and clean rows, at least; chance reaches it for few terms.
MIN_GAIN = 30.0
#: A term is toxic if at least so large a part of its places, by evidence, lies in toxic rows.
MIN_PURITY = 0.9
PREFIXES = range(4, 9)
DEFAULT_SCORE = 0.01
#: The curve's shift, at most: a text without a match scores under one half.
MAX_SHIFT = -0.01
#: Look-alike letters and the Latin letters they stand for.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k", "υ": "u"}
#: Digits and signs written for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = {ord(k): v for k, v in (LOOK_ALIKES | SUBSTITUTES).items()} | {0xFF41 + i: chr(97 + i) for i in range(26)}


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes replaced."""
    return text.lower().translate(_FOLD)


def words(folded: str) -> list[str]:
    """Runs of letters, in order."""
    return "".join(c if c.isalpha() else " " for c in folded).split()


def _outside(found: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The places of ``found`` in none of the ``spans``; both are walked once, in order."""
    out, spans, at, reach = {}, sorted(spans), 0, 0
    for p in sorted(found):
        while at < len(spans) and spans[at][0] <= p:
            reach = max(reach, spans[at][1])
            at += 1
        if p >= reach:
            out[p] = found[p]
    return out


@dataclass
class Lexicon:
    """``terms``: weight of a whole word, or of a word's beginning when it ends in "*"; ``exceptions``:
    two-word phrases that take their lexicon word out; ``power``, ``slope``, ``shift``: the curve."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    power: float = 0.5
    slope: float = 0.0
    shift: float = math.log(DEFAULT_SCORE / (1 - DEFAULT_SCORE))

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        patterns: dict[str, list] = {}
        for t, w in self.terms.items():
            patterns.setdefault(t.rstrip("*"), []).append(("*" if t.endswith("*") else "w", w))
        for e in self.exceptions:
            patterns.setdefault(e, []).append(("x", 0.0))
        for p, found in patterns.items():
            a.add_word(p, (len(p), found))
        if patterns:
            a.make_automaton()
        return a if patterns else None

    def measure(self, automaton, text: str) -> tuple[float, int]:
        """(weight of the matches, number of words)."""
        folded = fold(text)
        n = folded.count(" ") + folded.count("\n") + 1
        if automaton is None or not folded:
            return 0.0, n
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, found) in automaton.iter(folded):
            lo, hi = end - size + 1, end + 1
            if lo and folded[lo - 1].isalpha():
                continue
            ends = hi == len(folded) or not folded[hi].isalpha()
            for kind, w in found:
                if kind == "x":
                    if ends:
                        excused.append((lo, hi))
                elif ends or kind == "*":
                    best[lo] = max(w, best.get(lo, 0.0))
        if excused and best:
            best = _outside(best, excused)
        return sum(best.values()), n

    def score(self, weight: float, n: int) -> float:
        z = self.shift + self.slope * math.log1p(weight / n**self.power)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id):
    """Rows whose labels are kept from learning."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "toxic") -> DataFrame:
    """(doc_id, text, label) of up to ``sample_rows`` learnable rows of each label, chosen by hash."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")).where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id")))
    order = F.xxhash64("_id")
    some = [own.where(F.col("label") == y).orderBy(order, "_id").limit(sample_rows) for y in (0, 1)]
    sample = materialise(some[0].unionByName(some[1]), "toxic-sample")
    # 2 * sample_rows rows of two numbers
    return materialise(id_and_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label"), "toxic-texts")


def _counts(found: Counter) -> pa.RecordBatch:
    term, kind, before, label = zip(*found, strict=True) if found else ((),) * 4
    cells = pa.array(term, pa.string()), pa.array(kind, pa.string()), pa.array(before, pa.string()), pa.array(label, pa.int32()), pa.array(list(found.values()), pa.int64())
    return pa.RecordBatch.from_arrays(list(cells), ["term", "kind", "before", "label", "docs"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, kind, before, label, docs): each word and word beginning once a text and word before it, counted."""
    found: Counter = Counter()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ws = words(fold(text))
            seen = set()
            for before, w in set(zip(["", *ws], ws, strict=False)):
                seen.add((w, "w", before, label))
                seen |= {(w[:k], "*", before, label) for k in PREFIXES if len(w) > k}
            found.update(seen)
            if len(found) > COMBINE:
                yield _counts(found)
                found.clear()
    yield _counts(found)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "toxic") -> Lexicon:
    texts = training_rows(docs, labels, sample_rows, label_col)
    counts = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    # what a term follows, once a label: its evidence
    seen = texts.select("text", "label").mapInArrow(_terms, "term string, kind string, before string, label int, docs long")
    each = seen.groupBy("term", "kind", "before").agg(F.max("label").alias("t"), F.max(1 - F.col("label")).alias("c"))
    stats = each.groupBy("term", "kind").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= MIN_EVIDENCE)
    t, c = F.col("t") / n_toxic, F.col("c") / n_clean
    pure = stats.where(t / (t + c) >= MIN_PURITY).withColumn("gain", F.col("t") * F.log((t + 0.5 / n_toxic) / (c + 0.5 / n_clean)))
    found = pure.where(F.col("gain") >= MIN_GAIN).collect()  # the lexicon: distinct words of the sample at most
    best = {r["term"] + "*" * (r["kind"] == "*"): math.log((r["t"] + 0.5) / n_toxic) - math.log((r["c"] + 0.5) / n_clean) for r in found}
    lexicon = Lexicon({k: w for k, w in best.items() if w > 0})
    if not lexicon.terms:
        return Lexicon()
    lexicon.exceptions = _exceptions({k for k in lexicon.terms if not k.endswith("*")}, texts)
    _fit(lexicon, texts)
    return lexicon


def _exceptions(plain: set[str], texts: DataFrame) -> set[str]:
    """The two-word phrases round a word of ``plain`` that ``MIN_EXCEPTION`` clean texts have and no toxic one."""
    terms = texts.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(fold(text))
                found.update({(f"{v} {w}", "x", "", label) for v, w in zip(ws, ws[1:], strict=False) if v in terms.value or w in terms.value})
            yield _counts(found)

    rows = texts.select("text", "label").mapInArrow(run, "term string, kind string, before string, label int, docs long")
    held = rows.groupBy("term").agg(F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("clean"), F.max("label").alias("toxic"))
    return {r["term"] for r in held.where((F.col("clean") >= MIN_EXCEPTION) & (F.col("toxic") == 0)).select("term").collect()}


def _fit(lexicon: Lexicon, texts: DataFrame) -> None:
    """The curve, from the (weight, words, label) of the sample: at most 2 * sample_rows rows of three numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            found = [lexicon.measure(a, t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), b.column(1)], ["weight", "n", "label"])

    rows = texts.select("text", "label").mapInArrow(run, "weight double, n long, label int").toPandas()
    y, best = rows["label"].to_numpy(float), math.inf
    share = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum()))  # both labels weigh the same
    for power in (0.25, 0.5, 0.75):
        x = np.log1p(rows["weight"].to_numpy() / rows["n"].to_numpy(float) ** power)
        ab = np.zeros(2)
        design = np.stack([np.ones_like(x), x], 1)
        for _ in range(50):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
            g = design.T @ (share * (p - y)) + 1e-3 * ab
            h = (design * (share * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            ab -= step
            if np.abs(step).max() < 1e-9:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ ab, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if loss < best - 1e-12:
            best, lexicon.power, lexicon.shift, lexicon.slope = loss, power, float(ab[0]), float(ab[1])
    lexicon.shift = min(lexicon.shift, MAX_SHIFT)


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with a column of scores. The lexicon, a part of the bounded sample's words, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        a = known.automaton()
        for batch in texts:
            yield pd.Series([known.score(*known.measure(a, t)) for t in batch], dtype="float64")

    udf = F.pandas_udf(rate, "double")
    return df.withColumn(score_col, udf(F.coalesce(F.col(text_col), F.lit(""))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    out = score(id_and_text(docs), lexicon)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
