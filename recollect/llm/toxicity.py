"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are word beginnings: a fixed lexicon, and beginnings mined from a bounded sample of labelled training rows
(distinct texts only), besides patterns of style. Each document of the whole corpus gets the set of voters that
fire as one 64-bit number, from its whole text.

The label model is a two-class mixture in which voters fire with class-dependent rates. Expectation maximisation
over all documents estimates prior and rates, with the class of training rows held to their label; second moments
under the posterior give the correlations of voters within the toxic class, and correlated voters share their
weight. Its posteriors, not the labels, then train a logistic regression (Newton steps). Both read a table of
distinct vote sets with counts, so copies are pre-aggregated and the driver receives sums of fixed size.

Defined results: null and empty texts fire no voter and get the score of such texts; labels that are null, or whose
row is held out or has a null id, are never read; a null id is not held out; several labels of one document count as toxic if one is; without labels the lexicon
votes alone; rows are independent, so repeats get equal scores; further columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh

#: The lexicon.
LEXICON = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
#: Patterns: words that voters begin, per text and per character of it, and style.
REPEATS, DENSITIES = (2, 3), (1 / 4000, 1 / 1500, 1 / 600)
PATTERNS = [*(f"hits_{n}" for n in REPEATS), *(f"density_{round(1 / d)}" for d in DENSITIES), "shouting", "exclaiming", "elongated"]
#: Labelled rows of each class that voters are mined from, at most; the hash of the id picks them.
SAMPLE = 10_000
#: Lengths of word beginnings; texts of the sample that must hold one; least ratio of toxic to clean rate; most voters.
PREFIXES, SUPPORT, RATIO, VOTERS = range(4, 11), 8, 4.0, 40
#: A ratio from which only the number of toxic texts ranks voters, so that a common stem comes before its forms.
PURE = 10.0
#: Different word beginnings that a task counts at a time.
PIECE = 100_000
EM_STEPS, NEWTON_STEPS, RIDGE, THRESHOLD, CORRELATED = 12, 30, 1.0, 0.3, 0.2
WORD = re.compile(r"[^\W\d_]+")
ELONGATED = re.compile(r"([^\W\d_])\1{3}")


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def beginnings(text: str) -> set[str]:
    return {word[:n] for word in set(WORD.findall(text.lower())) for n in PREFIXES if len(word) >= n}


def training_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(_key, _toxic) of the rows that may be learned from."""
    rows = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_toxic")).dropna()
    return rows.where(~held_out(F.col("_key"))).groupBy("_key").agg(F.max("_toxic").alias("_toxic"))


def mine_voters(docs: DataFrame, train: DataFrame, key: str, text: str) -> list[str]:
    """Word beginnings that mark toxic texts of the sample, the best of each family that begin one another."""
    order = F.xxhash64("_key")
    sample = train.where("_toxic = 1").orderBy(order).limit(SAMPLE).unionByName(train.where("_toxic = 0").orderBy(order).limit(SAMPLE))
    # at most 2 * SAMPLE rows of an id and a label
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), "_key")
    rows = rows.where(F.col("_text") != "").groupBy(F.xxhash64("_text").alias("_h")).agg(F.first("_text").alias("_text"), F.max("_toxic").alias("_toxic"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for i, (body, label) in enumerate(zip(batch["_text"], batch["_toxic"], strict=True), 1):
                (toxic if label >= 1 else clean).update(beginnings(body))
                # partial counts leave in pieces, so memory does not grow with the batch
                if i == len(batch) or len(toxic) + len(clean) >= PIECE:
                    names = list(toxic.keys() | clean.keys())
                    yield pd.DataFrame({"mark": names, "t": [toxic[n] for n in names], "c": [clean[n] for n in names]})
                    toxic, clean = Counter(), Counter()

    sizes = rows.groupBy("_toxic").count().collect()
    size = {r[0]: r[1] for r in sizes}
    if not size.get(1) or not size.get(0):
        return []
    marks = rows.select("_text", "_toxic").mapInPandas(count, "mark string, t long, c long").groupBy("mark").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = ((F.col("t") + 0.5) / size[1]) / ((F.col("c") + 0.5) / size[0])
    best = marks.where((F.col("t") >= SUPPORT) & (ratio >= RATIO)).orderBy((F.col("t") * F.log(F.least(ratio, F.lit(PURE)))).desc(), F.length("mark").desc(), "mark").limit(64 * VOTERS).collect()
    out: list[str] = []
    for mark in (r["mark"] for r in best):
        if len(out) < VOTERS and not any(mark.startswith(have) or have.startswith(mark) for have in out):
            out.append(mark)
    return out


def votes_of(text: Column, voters: list[str]) -> Column:
    """The set of voters that fire as a 64-bit number; patterns take the bits after the voters'.

    Only the text goes to Python, in pieces of bounded size, and one number for each row comes back.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, voter in enumerate(voters):
            machine.add_word(voter, (1 << i, len(voter)))
        machine.make_automaton()
        first = len(voters)

        def votes(body: str | None) -> int:
            if not body:
                return 0
            low, out, hits = body.lower(), 0, 0
            for end, (bit, n) in machine.iter(low) if voters else ():
                if end < n or not low[end - n].isalpha():
                    out |= bit
                    hits += 1
            style = [*(hits >= n for n in REPEATS), *(hits > 0 and hits >= d * len(low) for d in DENSITIES), body.isupper(), "!!" in body, bool(ELONGATED.search(low))]
            return out | sum(1 << i for i, fires in enumerate(style, first) if fires)

        for batch in batches:
            yield pa.array((votes(x.as_py()) for x in batch), pa.int64(), size=len(batch))

    return F.arrow_udf(run, T.LongType())(text.cast("string"))


def _matrix(bits: np.ndarray, n: int) -> np.ndarray:
    return ((bits.astype(np.int64)[:, None] >> np.arange(n)) & 1).astype(np.float64)


def _sum_over(patterns: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sums of per_batch(frame) -> vector of `size` numbers over all rows of patterns; the driver gets one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            total += per_batch(batch)
        yield pd.DataFrame({"i": np.arange(size), "x": total})

    rows = patterns.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["x"]
    return out


@dataclass
class ToxicityModel:
    voters: list[str]
    prior: float = 0.05
    toxic_rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    clean_rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def size(self) -> int:
        return len(self.voters) + len(PATTERNS)

    def posterior(self, bits: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        votes = _matrix(bits, self.size())
        share = np.ones(self.size())
        if self.correlations.size:
            # voters that fire together for another reason than the class share one vote
            tied = np.where(self.correlations > CORRELATED, self.correlations, 0.0)
            np.fill_diagonal(tied, 0.0)
            share = 1 / (1 + tied.sum(axis=1))
        a, b = self.toxic_rates, self.clean_rates
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (share * np.log(a / b)) + (1 - votes) @ (share * np.log((1 - a) / (1 - b)))
        out = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return out if known is None else np.where(np.isnan(known), out, known)

    def features(self, bits: np.ndarray) -> np.ndarray:
        votes = _matrix(bits, self.size())
        fired = votes[:, : len(self.voters)].sum(axis=1, keepdims=True)
        return np.hstack([np.ones((len(votes), 1)), votes, np.log1p(fired)])

    def score(self, bits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(bits) @ self.weights, -30, 30)))

    def score_column(self, bits: Column) -> Column:
        """score() as a column expression."""
        n = len(self.voters)
        fired = F.bit_count(bits.bitwiseAND(F.lit((1 << n) - 1)))
        odds = F.lit(float(self.weights[0])) + F.lit(float(self.weights[-1])) * F.log1p(fired)
        for i, weight in enumerate(self.weights[1:-1]):
            odds = odds + F.lit(float(weight)) * F.getbit(bits, F.lit(i)).cast("double")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))


def fit_label_model(model: ToxicityModel, patterns: DataFrame) -> None:
    """Expectation maximisation over (bits, known, n); known is the label of training rows, else null."""
    m = model.size()
    model.toxic_rates, model.clean_rates = np.full(m, 0.2), np.full(m, 0.002)
    model.toxic_rates[len(model.voters) :] = model.clean_rates[len(model.voters) :] = 0.05

    def moments(batch: pd.DataFrame) -> np.ndarray:
        n, votes = batch["n"].to_numpy(np.float64), _matrix(batch["bits"].to_numpy(), m)
        y = model.posterior(batch["bits"].to_numpy(), batch["known"].to_numpy(np.float64))
        return np.concatenate([[n.sum(), (n * y).sum()], (n * y) @ votes, n @ votes])

    for _ in range(EM_STEPS):
        sums = _sum_over(patterns, moments, 2 + 2 * m)
        total, toxic, in_toxic, anywhere = sums[0], sums[1], sums[2 : 2 + m], sums[2 + m :]
        before = model.toxic_rates
        model.prior = float(np.clip((toxic + 0.5) / (total + 1), 1e-4, 0.5))
        model.toxic_rates = np.clip((in_toxic + 0.1) / (toxic + 1), 1e-4, 1 - 1e-4)
        model.clean_rates = np.clip((anywhere - in_toxic + 0.05) / (total - toxic + 1), 1e-5, 1 - 1e-4)
        if np.abs(model.toxic_rates - before).max() < 1e-4:
            break

    def second(batch: pd.DataFrame) -> np.ndarray:
        n, votes = batch["n"].to_numpy(np.float64), _matrix(batch["bits"].to_numpy(), m)
        y = n * model.posterior(batch["bits"].to_numpy(), batch["known"].to_numpy(np.float64))
        return np.concatenate([[y.sum()], y @ votes, (votes.T @ (votes * y[:, None])).ravel()])

    sums = _sum_over(patterns, second, 1 + m + m * m)
    weight = max(sums[0], 1e-9)
    mean, both = sums[1 : 1 + m] / weight, sums[1 + m :].reshape(m, m) / weight
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    model.correlations = np.clip((both - np.outer(mean, mean)) / np.outer(spread, spread), -1, 1)


def fit_classifier(model: ToxicityModel, patterns: DataFrame) -> None:
    """Ridge logistic regression on the label model's posteriors, without the labels.

    Newton steps with Levenberg's damping: a step that raises the loss is taken back and damped more.
    """
    width = model.size() + 2
    start = np.zeros(width)
    start[0] = np.log(model.prior / (1 - model.prior))
    ridge = RIDGE * np.eye(width)
    ridge[0, 0] = 1e-6

    def sums(batch: pd.DataFrame) -> np.ndarray:
        n, bits = batch["n"].to_numpy(np.float64), batch["bits"].to_numpy()
        x, p, y = model.features(bits), np.clip(model.score(bits), 1e-13, 1 - 1e-13), model.posterior(bits)
        loss = -(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        return np.concatenate([[loss], x.T @ (n * (y - p)), (x.T @ (x * (n * p * (1 - p))[:, None])).ravel()])

    model.weights, damping, best, kept, found = start, 1.0, np.inf, start, None
    for _ in range(NEWTON_STEPS):
        now = _sum_over(patterns, sums, 1 + width + width * width)
        loss = now[0] + 0.5 * model.weights @ ridge @ model.weights
        if loss <= best:
            settled = best - loss < 1e-7 * max(loss, 1.0)
            best, kept, found, damping = loss, model.weights, now, damping / 8
            if settled:
                break
        else:
            damping *= 16
        curved = found[1 + width :].reshape(width, width) + ridge
        model.weights = kept + np.linalg.solve(curved + damping * np.diag(np.diag(curved)), found[1 : 1 + width] - ridge @ kept)
    model.weights = kept


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None) -> tuple[DataFrame, ToxicityModel]:
    """The columns `keep` of docs (all by default) with votes and score, and the model that was fitted on them.

    The votes are computed once: they are written beside the kept columns, and the score is an expression over them.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    train = scratch.table("train", training_labels(labels, key, label))
    mined = mine_voters(docs, train, key, text)
    voters = mined + [w for w in LEXICON if not any(w.startswith(v) or v.startswith(w) for v in mined)]
    model = ToxicityModel(voters)
    kept = docs.columns if keep is None else keep
    into, score = fresh(docs.select(*kept), "votes", "score")
    named = fresh(docs.select(*kept), "_key")[0]
    voted = scratch.table("voted", docs.select(*kept, F.col(key).alias(named), votes_of(F.col(text), voters).alias(into)))
    slim = voted.select(F.col(named).alias("_key"), F.col(into).alias("bits"))
    # counted by id first, so that an id (or null) that many rows have is a few rows of the join
    counted = slim.groupBy("_key", "bits").agg(F.count(F.lit(1)).alias("n"))
    known = counted.join(train, "_key", "left").groupBy("bits", F.col("_toxic").cast("double").alias("known")).agg(F.sum("n").alias("n"))
    patterns = scratch.table("patterns", known)
    fit_label_model(model, patterns)
    fit_classifier(model, patterns)
    return voted.drop(named).withColumn(score, model.score_column(F.col(into))), model


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored, _ = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "votes")
