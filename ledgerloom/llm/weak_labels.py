"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of words and of word beginnings, mined from labelled training rows and dealt
into several lists each, density rules, and fixed patterns. A generative label model estimates by EM how often every
voter votes which way given the class, and which pairs of voters go together beyond that; correlated voters are tied in a
forest, each voter conditioned on its parent. A logistic regression is then trained on the posterior labels. Scoring
needs only that linear model and the lexicons, which are bounded and broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import arrow_map, materialize

SAMPLE = 20_000  # labelled documents that the classifier is fitted on, at most
LEXICON = 600  # terms of a kind, at most
LISTS = 4  # lists that a kind of lexicon is dealt into
LEAST_DOCS = 4  # training documents that a term must be in
BEGINNINGS = (4, 5, 6, 7)
STRONG = 2.5  # log odds
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"[A-Z]{3,}\W*!")
_SECOND_PERSON = re.compile(r"(?i)\byou(?:'re| are)? (?:a |an |such |all |so )?\w+")
_MASKED = re.compile(r"\b\w+[*@#$]+\w+\b")


# ---------------------------------------------------------------- lexicons


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled training rows, those of the least hashes of their ids.

    ``train`` says by the id Column which rows may be learned from. The chosen ids are bounded by ``limit`` and broadcast;
    of an id with several rows the least text stands, so the rows are bounded too.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(train(F.col("id")) & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def terms_of(text: str) -> list[str]:
    """Every word, as ``=word``, and its beginnings, as ``beginning-``."""
    out = []
    for w in _WORD.findall(text.lower()):
        out.append("=" + w)
        out += [w[:n] + "-" for n in BEGINNINGS if len(w) > n]
    return out


def mined_terms(sample: DataFrame, least: int = LEAST_DOCS, most: int = LEXICON) -> list[tuple[str, float]]:
    """(term, weight) of the words and of the beginnings that most favour class 1.

    The weight is the smoothed log odds of the shares of documents of either class that hold the term; terms are ranked by
    it over its standard error, so that one document that repeats a word counts once.
    """

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            totals: dict[str, list[int]] = {}
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                for t in set(terms_of(text)):
                    totals.setdefault(t, [0, 0])[y] += 1
            columns = list(zip(*totals.values())) if totals else [[]] * 2
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["term", "d0", "d1"])

        return batch

    counted = arrow_map(sample.select("text", "y"), make, "term string, d0 long, d1 long")
    summed = counted.groupBy("term").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).filter(F.col("d1") >= least)
    sizes = sample.agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")).head()
    if not sizes.n0 or not sizes.n1:
        return []
    odds = F.log((F.col("d1") + 0.5) / (sizes.n1 + 1)) - F.log((F.col("d0") + 0.5) / (sizes.n0 + 1))
    error = F.sqrt(1 / (F.col("d1") + 0.5) - 1 / (sizes.n1 + 1) + 1 / (F.col("d0") + 0.5) - 1 / (sizes.n0 + 1))
    scored = summed.select("term", odds.alias("odds"), (odds / error).alias("z"))
    out = []
    for kind in ("=", "-"):
        of_kind = scored.filter(F.col("term").startswith("=") == F.lit(kind == "=")).filter("odds > 1.5 and z > 4")
        out += [(r.term, r.odds) for r in of_kind.orderBy(F.desc("z"), "term").limit(most).collect()]
    return out


# ---------------------------------------------------------------- voters


class Voters:
    """Votes in {-1 abstain, 0, 1} and features of a text."""

    def __init__(self, terms: list[tuple[str, float]]):
        self.column: dict[str, int] = {}
        self.weight: dict[str, float] = dict(terms)
        for at, (t, _) in enumerate(terms):
            self.column[t] = (0 if t.startswith("=") else LISTS) + at % LISTS
        self.known: dict[str, tuple[tuple[int, float], ...]] = {}
        self.names = [f"words {k}" for k in range(LISTS)] + [f"beginnings {k}" for k in range(LISTS)]
        self.names += ["two words", "three words", "five words", "dense", "very dense", "strong words", "none", "shouting", "second person", "masked word"]

    def _hits(self, word: str) -> tuple[tuple[int, ...], float]:
        """The lists that a word is in, and its greatest weight."""
        if (found := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            keys = ["=" + word] + [word[:n] + "-" for n in BEGINNINGS if len(word) > n]
            keys = [k for k in keys if k in self.column]
            found = self.known[word] = tuple({self.column[k] for k in keys}), max((self.weight[k] for k in keys), default=0.0)
        return found

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        words = _WORD.findall(text.lower())
        counts, mass, touched, strong = [0] * (2 * LISTS), 0.0, 0, 0
        for lists, weight in map(self._hits, words):
            if lists:
                touched += 1
                strong += weight > STRONG
                mass += weight
                for c in lists:
                    counts[c] += 1
        n = max(len(words), 1)
        shouts = len(_SHOUT.findall(text))
        votes = [1 if c > 1 else -1 for c in counts]
        votes += [1 if touched > 1 else 0, 1 if touched > 2 else 0, 1 if touched > 4 else -1]
        votes += [1 if mass / n > 0.01 else 0, 1 if mass / n > 0.03 else 0, 1 if strong > 1 else 0]
        votes += [0 if touched == 0 and n > 20 else -1, 1 if shouts > 3 else -1, 1 if _SECOND_PERSON.search(text) else -1, 1 if _MASKED.search(text) else -1]
        features = [np.log1p(c) for c in counts]
        features += [np.log1p(mass), min(3.0, 10 * mass / n), np.log1p(touched), min(1.0, 20 * touched / n), np.log1p(strong), min(1.0, 20 * strong / n)]
        features += [float(touched > k) for k in range(4)] + [float(strong > k) for k in range(4)]
        features += [float(mass / n > x) for x in (0.003, 0.01, 0.03, 0.1)] + [np.log(n), min(1.0, 10 * shouts / n)]
        return votes, features


# ---------------------------------------------------------------- label model


@dataclass
class LabelModel:
    """P(vote | class, parent's vote) for voters in a forest; parents[j] is -1 for a root."""

    prior: float
    parents: list[int] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)  # [class, parent's vote + 1, vote + 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parents):
            above = votes[:, p] + 1 if p >= 0 else np.zeros(len(votes), int)
            logs += np.log(self.tables[j][:, above, votes[:, j] + 1]).T
        logs -= logs.max(1, keepdims=True)
        q = np.exp(logs)
        return q[:, 1] / q.sum(1)


def _tables(votes: np.ndarray, q: np.ndarray, parents: list[int]) -> list[np.ndarray]:
    out = []
    for j, p in enumerate(parents):
        table = np.full((2, 3, 3), 0.5)
        above = votes[:, p] + 1 if p >= 0 else np.zeros(len(votes), int)
        for y, w in ((0, 1 - q), (1, q)):
            np.add.at(table[y], (above, votes[:, j] + 1), w)
        out.append(table / table.sum(2, keepdims=True))
    return out


def _forest(votes: np.ndarray, q: np.ndarray, least: float = 0.01) -> list[int]:
    """Parents by the greatest conditional mutual information given the class; pairs under ``least`` stay independent."""
    k, n = votes.shape[1], len(votes)
    pairs = []
    for a in range(k):
        for b in range(a):
            info = 0.0
            for w in (1 - q, q):
                joint = np.zeros((3, 3))
                np.add.at(joint, (votes[:, a] + 1, votes[:, b] + 1), w)
                total = joint.sum()
                if total > 0:
                    p = joint / total
                    apart = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
                    some = p > 0
                    info += total / n * float((p[some] * np.log(p[some] / apart[some])).sum())
            if info >= least:
                pairs.append((info, a, b))
    near: dict[int, list[int]] = {j: [] for j in range(k)}
    root = list(range(k))
    for _, a, b in sorted(pairs, reverse=True):
        if root[a] != root[b]:
            near[a].append(b)
            near[b].append(a)
            gone, kept = root[a], root[b]
            root = [kept if r == gone else r for r in root]
    parents = [-2] * k
    for start in range(k):
        if parents[start] == -2:
            parents[start], todo = -1, [start]
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if parents[y] == -2:
                        parents[y] = x
                        todo.append(y)
    return parents


def fit_label_model(votes: np.ndarray, first: np.ndarray, rounds: int = 20, hold: float = 1.0) -> tuple[LabelModel, np.ndarray]:
    """EM from the first guess; ``hold`` is how strongly the labels of training rows weigh in the posterior.

    Ties are estimated before the first round, so that a voter and its near copy don't outvote the rest, and twice later.
    """
    q = np.clip(first.astype(float), 0.04, 0.96)
    anchor = q.copy()
    for r in range(rounds):
        if r in (0, rounds // 3, 2 * rounds // 3):
            parents = _forest(votes, q)
        model = LabelModel(float(np.clip(q.mean(), 0.01, 0.99)), parents, _tables(votes, q, parents))
        p = np.clip(model.posterior(votes), 1e-4, 1 - 1e-4)
        odds = np.log(p / (1 - p)) + hold * np.log(anchor / (1 - anchor))
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - q).max() < 1e-4 and r > 2 * rounds // 3:
            q = new
            break
        q = new
    return model, q


def fit_logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge-penalized logistic regression on soft labels, by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), x1.T @ (p - q) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    terms: list[tuple[str, float]]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    label_model: LabelModel | None
    base: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(features), self.base)
        z = (features - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(sample: DataFrame) -> ToxicityModel:
    """Fit on ``sample`` (text, y), which the caller has bounded; its votes and features are gathered, its texts are not.

    An empty sample, or one of a single class, gives a constant score: the share of class 1 (0.0 if empty).
    """
    sample = materialize(sample.select("text", "y"), "sample")
    terms = mined_terms(sample)

    def make():
        voters = Voters(terms)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [voters(t) for t in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("y"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["y", "votes", "features"])

        return batch

    rows = arrow_map(sample, make, "y int, votes array<int>, features array<double>", by_row=True).collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(terms, np.zeros(0), np.zeros(0), np.zeros(0), None, float(y.mean()) if len(y) else 0.0)
    votes, x = np.array([r.votes for r in rows]), np.array([r.features for r in rows])
    order = np.lexsort((*x.T, y))  # the order of collected rows must not matter
    votes, x, y = votes[order], x[order], y[order]
    label_model, q = fit_label_model(votes, y)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    return ToxicityModel(terms, mean, spread, fit_logistic((x - mean) / spread, q), label_model, float(y.mean()))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all columns and ``score_col`` double (replaced if it exists). A null text counts as empty."""
    docs = docs.drop(score_col)
    names = [*docs.columns, score_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.mean, model.spread, model.weights, model.base))

    def make():
        terms, mean, spread, weights, base = shared.value
        voters, own = Voters(terms), ToxicityModel(terms, mean, spread, weights, None, base)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([voters(t or "")[1] for t in b.column(text_col).to_pylist()])
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(own.scores(x), pa.float64())], names)

        return batch

    return arrow_map(docs, make, docs.withColumn(score_col, F.lit(0.0)).schema, by_row=True)
