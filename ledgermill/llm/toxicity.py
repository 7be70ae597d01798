"""Toxicity scores from a fuzzy lexicon with context windows.

Terms and stems that mark toxic texts are learned from labelled rows. They form a trie; a
Levenshtein automaton of up to one edit runs through trie and token together, so that a
misspelled term still leads to its entry. The product of the two is made
deterministic lazily: a state is the set of (trie node, edits so far) that a prefix
can reach, and each (state, letter) is worked out once per worker. Most tokens end in the
dead state after two or three letters.

Each match is weighed in its window. Inside quotation marks, or near words that report
speech, and without a second person near by, it is a quotation and counts less than
abuse. A text's features, the weight of its abuse, of its quotations, of the worst window
and of fuzzy matches, enter a logistic model fitted on labelled rows.

Learning sees at most ``max_labelled`` rows, those with the smallest hashes, which bounds the lexicon
too; equal texts count once. Scoring sees every whole text.

Defined cases: null and empty texts have no match and get the score of a text without
any; texts of any length are scored whole; repeated rows are scored alike; a row whose id is
null or unlabelled is scored but not learned from; rows with conflicting labels for
one id count as toxic if any of them is; where labels teach no lexicon (too few of either kind)
every score is the base rate, 0.5 at most, and without any label it is 0; empty tables give empty
results; ``score`` passes other columns by and ``without_toxic`` keeps them, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import checkpoint, resident

MAX_LABELLED = 20_000
#: Distinct toxic texts that a term or stem must occur in, and odds that it must have.
LEAST_TEXTS = 4
LEAST_LOG_ODDS = 3.0
STEM_LENGTHS = (4, 7)
#: Entries shorter than this match exactly only.
FUZZY_LENGTH = 5
FUZZY_WEIGHT = 0.7
STEM_WEIGHT = 0.9
WINDOW = 6
QUOTED_SHARE = 0.25

TOKEN = re.compile(r"\w+", re.UNICODE)
# Quotation marks, words that report speech and second-person words of four languages.
QUOTES = set("\"“”„«»‘‚")
REPORTING = frozenset("said says wrote writes quoted called calling reported sagte schrieb nannte zitierte dit écrit appelé cité dijo escribió llamó citó".split())
SECOND_PERSON = frozenset("you your you're youre u du dich dir dein deine ihr euch tu toi ton ta vous votre usted ustedes tú tus vosotros".split())
FEATURES = ("abuse", "quotation", "worst_window", "fuzzy", "any")


class Entry(NamedTuple):
    """A term, or a stem that any ending may follow. ``fuzzy``: one edit may separate a token from it."""

    text: str
    stem: bool
    weight: float
    fuzzy: bool = True


class Lexicon:
    """A trie of terms and stems, searched by a Levenshtein automaton of at most one edit."""

    def __init__(self, entries: Iterable[Entry]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[Entry | None] = [None]
        #: Whether an entry that may be misspelled lies below each node.
        self.reach: list[bool] = [False]
        # Stems first: where one text is both, the stem covers the term.
        for entry in sorted(entries, key=lambda e: (e.text, not e.stem)):
            node, may = 0, entry.fuzzy and len(entry.text) >= FUZZY_LENGTH
            self.reach[0] |= may
            for letter in entry.text:
                if letter not in self.edges[node]:
                    self.edges[node][letter] = len(self.edges)
                    self.edges.append({})
                    self.final.append(None)
                    self.reach.append(False)
                node = self.edges[node][letter]
                self.reach[node] |= may
            if old := self.final[node]:
                entry = Entry(entry.text, old.stem, max(old.weight, entry.weight), old.fuzzy or entry.fuzzy)
            self.final[node] = entry
        self.start = self._close({(0, 0, 0)})
        self.states = {self.start: 0}
        self.members = [self.start]
        self.steps: list[dict[str, int]] = [{}]
        self.found: list[tuple[float, bool, str] | None] = [self._accepts(self.start)]

    # A member is (node, edits, held): held marks a stem already complete, which any ending may follow.

    def _close(self, members: set[tuple[int, int, int]]) -> frozenset:
        """With the entries' letters that the token leaves out."""
        out = set(members)
        for node, edits, held in members:
            if not edits and not held and self.reach[node]:
                out |= {(to, 1, 0) for to in self.edges[node].values()}
        out |= {(node, edits, 1) for node, edits, held in out if not held and self._stem(node, edits)}
        return frozenset(self._fewest(out))

    def _stem(self, node: int, edits: int) -> bool:
        end = self.final[node]
        return bool(end and end.stem and (not edits or self._may(end)))

    @staticmethod
    def _may(end: Entry) -> bool:
        return end.fuzzy and len(end.text) >= FUZZY_LENGTH

    @staticmethod
    def _fewest(members: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
        return {(n, e, h) for n, e, h in members if not e or (n, 0, h) not in members}

    def _next(self, members: frozenset, letter: str) -> frozenset:
        out = set()
        for node, edits, held in members:
            if held:
                out.add((node, edits, 1))
                continue
            if letter in self.edges[node]:
                out.add((self.edges[node][letter], edits, 0))
            if not edits and self.reach[node]:
                out.add((node, 1, 0))  # a letter too many
                out |= {(to, 1, 0) for to in self.edges[node].values()}  # another letter
        return self._close(out)

    def _accepts(self, members: frozenset) -> tuple[float, bool, str] | None:
        """(weight, whether an edit was needed, entry) of the best entry that ends here."""
        best = None
        for node, edits, held in sorted(members):
            end = self.final[node]
            if end and (not edits or self._may(end)):
                weight = end.weight * (FUZZY_WEIGHT if edits else 1.0) * (STEM_WEIGHT if held else 1.0)
                if not best or weight > best[0]:
                    best = weight, bool(edits), end.text
        return best

    def match(self, token: str) -> tuple[float, bool, str] | None:
        state, steps = 0, self.steps
        for letter in token:
            if (to := steps[state].get(letter)) is None:
                members = self._next(self.members[state], letter)
                if (to := self.states.get(members)) is None:
                    to = self.states[members] = len(self.members)
                    self.members.append(members)
                    steps.append({})
                    self.found.append(self._accepts(members))
                steps[state][letter] = to
            state = to
            if not self.members[state]:
                return None
        return self.found[state]


@dataclass
class Model:
    """A lexicon and the logistic model over the features of its matches."""

    entries: list[Entry]
    coefficients: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    intercept: float = -50.0


class Scorer:
    """Features of texts under one lexicon. It remembers tokens up to a bound."""

    REMEMBERED = 120_000

    def __init__(self, entries: list[Entry]):
        self.lexicon = Lexicon(entries)
        self.known: dict[str, tuple[float, bool, str] | None] = {}

    def _match(self, token: str) -> tuple[float, bool, str] | None:
        if len(self.known) >= self.REMEMBERED:
            self.known.clear()
        found = self.known[token] = self.lexicon.match(token)
        return found

    def features(self, text: str | None) -> list[float]:
        if not text or not self.lexicon.edges[0]:
            return [0.0] * len(FEATURES)
        lower = text.lower()
        known = self.known
        hits = {}
        for token in set(TOKEN.findall(lower)):
            found = known[token] if token in known else self._match(token)
            if found:
                hits[token] = found
        if not hits:
            return [0.0] * len(FEATURES)
        tokens = list(TOKEN.finditer(lower))
        words = [m[0] for m in tokens]
        abuse = quotation = fuzzy = 0.0
        weights = np.zeros(len(words))
        for i, word in enumerate(words):
            if word not in hits:
                continue
            weight, edited, _ = hits[word]
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            left = lower[tokens[max(0, i - WINDOW)].start() : tokens[i].start()]
            right = lower[tokens[i].end() : tokens[min(len(tokens) - 1, i + WINDOW)].end() + 1]
            quoted = (any(c in QUOTES for c in left) and any(c in QUOTES for c in right)) or any(w in REPORTING for w in around)
            if quoted and not any(w in SECOND_PERSON for w in around):
                quotation += weight
                weight *= QUOTED_SHARE
            else:
                abuse += weight
            fuzzy += weight * edited
            weights[i] = weight
        ends = np.concatenate([[0.0], np.cumsum(weights)])
        span = 2 * WINDOW + 1
        worst = float((ends[span:] - ends[:-span]).max()) if len(words) >= span else float(ends[-1])
        return [math.log1p(abuse), math.log1p(quotation), math.log1p(worst), math.log1p(fuzzy), 1.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method with an L2 penalty on the weights; classes weigh alike."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), -50.0 if not len(y) or not y.max() else 50.0
    rows = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    ridge = np.diag([penalty] * x.shape[1] + [1e-9])
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        gradient = rows.T @ (weight * (p - y)) + ridge @ w
        hessian = (rows * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ rows + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def held_out(id_col: Column) -> Column:
    """The fold that learning never sees: crc32 of the id's decimal text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _learned_entries(sample: DataFrame) -> list[Entry]:
    """sample(text, toxic): distinct texts. Terms and stems whose share among toxic texts stands out."""
    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not totals[0] or not totals[1]:
        return []
    tokens = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_\p{M}]+"), F.lit(0)))).alias("token"))
    counts = checkpoint(tokens.groupBy("token").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    odds = F.log((F.col("t") + 0.1) / (totals[0] + 1)) - F.log((F.col("c") + 0.1) / (totals[1] + 1))
    strong = lambda df: df.withColumn("odds", odds).where((F.col("t") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_LOG_ODDS))
    terms = strong(counts.where(F.length("token") >= 3)).orderBy(F.col("odds").desc(), "token").collect()  # as bounded as the sample
    least, most = STEM_LENGTHS
    lengths = F.sequence(F.lit(least), F.least(F.lit(most), F.length("token") - 1))
    stems = counts.where(F.length("token") > least).select("t", "c", "token", F.explode(F.transform(lengths, lambda n: F.substring("token", F.lit(1), n))).alias("stem"))
    stems = stems.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") >= 2).alias("kinds"))
    # A stem needs several endings that each recur, and none or next to none in clean texts.
    stems = strong(stems.where("kinds >= 5")).orderBy(F.length("stem"), F.col("odds").desc(), "stem").collect()
    top = max([r.odds for r in terms] + [r.odds for r in stems], default=1.0)
    out: dict[tuple[str, bool], float] = {}
    for r in stems:
        if not any((r.stem[:n], True) in out for n in range(least, len(r.stem))):
            out[r.stem, True] = min(1.0, r.odds / top)
    for r in terms:
        out[r.token, False] = min(1.0, r.odds / top)
    entries = [Entry(text, stem, round(w, 6)) for (text, stem), w in sorted(out.items())]

    # An entry may be misspelled unless its one-edit neighbours are words of clean texts.
    shared = sample.sparkSession.sparkContext.broadcast(entries)

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            found = [lexicon.match(t) for t in batch]
            yield pd.Series([f[2] if f and f[1] else None for f in found], dtype=object)

    near = counts.select("t", "c", F.pandas_udf(nearest, "string")("token").alias("entry")).where("entry is not null")
    near = near.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where((F.col("c") > 0) & (odds < LEAST_LOG_ODDS))
    exact_only = {r.entry for r in near.collect()}
    return [e._replace(fuzzy=e.text not in exact_only) for e in entries]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    # The bound on learning: rows with the smallest hashes of their ids.
    chosen = marks.orderBy(F.xxhash64(F.lit(11), F.col("id")), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.join(chosen, "id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    texts = checkpoint(texts.repartition(F.xxhash64("text")))
    entries = _learned_entries(texts)
    if not entries:
        toxic, seen = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
        # Nothing tells texts apart: all get the base rate, with one text of either kind added.
        return Model([], intercept=min(0.0, math.log((toxic + 1) / (seen - toxic + 1))) if seen else -50.0)
    known = texts.select("toxic", _features_udf(texts.sparkSession, Model(entries))("text").alias("f")).toPandas()
    x = np.array(known.f.tolist(), dtype=float).reshape(len(known), len(FEATURES))
    w, b = fit_logistic(x, known.toxic.to_numpy(float))
    return Model(entries, w.tolist(), b)


def _features_udf(spark, model: Model):
    entries = spark.sparkContext.broadcast(model.entries)  # as bounded as the labelled rows
    key = hash(tuple(model.entries))

    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = resident(("toxicity", key), lambda: Scorer(entries.value))
        for batch in texts:
            yield pd.Series([scorer.features(t) for t in batch])

    return F.pandas_udf(features, "array<double>")


def _probability(features: Column, model: Model) -> Column:
    at = F.lit(float(model.intercept))
    for i, w in enumerate(model.coefficients):
        at = at + features[i] * F.lit(float(w))
    return 1 / (1 + F.exp(-at))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted and the features."""
    ship(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("id"), _features_udf(docs.sparkSession, model)(F.col(text_col)).alias("f"))
    scored = found.select("id", "f", held_out(F.col("id")).alias("held_out"), _probability(F.col("f"), model).alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col("f")[i].alias(name) for i, name in enumerate(FEATURES[:4])])


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose texts score ``threshold`` or more."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"))
    found = _features_udf(docs.sparkSession, model)(F.col("row").getField(text_col))
    return rows.withColumn("f", found).where(_probability(F.col("f"), model) < threshold).select("row.*")
