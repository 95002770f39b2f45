"""A quality classifier learnt without labels: heuristic labellers, a model of their accuracy, a linear scorer.

1. Each labeller looks at one property of a text and votes good, bad or not at
   all. The votes of a text form a pattern; there are 3 ** (number of labellers)
   patterns at most, and the counts of patterns over all texts are what the
   model sees.
2. Expectation-maximisation estimates, for each labeller, how often it says bad
   of bad texts and good of good ones, and the share of good texts. A labeller
   that does not vote says nothing about a text. The posterior of a pattern is
   the chance that such a text is good.
3. The posteriors are the soft labels of a logistic scorer over hashed features
   of whole texts: byte trigrams and the labellers' properties in steps. It is
   fitted on a sample of at most `sample` distinct texts that have words, drawn
   by a hash: copies and blank texts take no room in it.
4. The scorer scores every text; texts of 0.5 and more are kept.

A text that is NULL or has no words scores 0. Repeated rows get equal scores.
An empty table gives an empty table. Only the text is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lamina.llm.common import all_but, bounded_batches, free_name, map_rows, quoted, release, written

BAD, GOOD, SILENT = 0, 1, 2
DIMENSIONS = 4096
SAMPLE = 4000

MARKS = b".,;:!?'\"-()"
UPPER, DIGIT, SPACE, MARK, SYMBOL, LETTER = range(6)


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, SYMBOL, np.uint8)
    kinds[ord("a"):ord("z") + 1] = kinds[128:] = LETTER
    kinds[ord("A"):ord("Z") + 1] = UPPER
    kinds[ord("0"):ord("9") + 1] = DIGIT
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[list(MARKS)] = MARK
    return kinds


KINDS = byte_kinds()


def measures(data: bytes) -> dict[str, float]:
    """Properties of a text that has words."""
    words = data.lower().split()
    n = len(words)
    kinds = np.bincount(KINDS[np.frombuffer(data, np.uint8)], minlength=6)
    letters = int(kinds[LETTER] + kinds[UPPER])
    shown = max(1, len(data) - int(kinds[SPACE]))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return {
        "words": float(n),
        "symbols": kinds[SYMBOL] / shown,
        "upper": kinds[UPPER] / max(1, letters),
        "digits": kinds[DIGIT] / shown,
        "repeats": sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1),
        "shouts": data.count(b"!") / n,
        "bars": (data.count(b" | ") + data.count(b"\t")) / n,
        "stops": (data.count(b".") + data.count(b"?")) / n,
        "lines": float(len(lines)),
        "copied": 1 - len(set(lines)) / max(1, len(lines)),
        "length": shown / n,
    }


def between(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    if good[0] <= value <= good[1]:
        return GOOD
    return SILENT if bad[0] < value < bad[1] else BAD


def votes(m: dict[str, float]) -> list[int]:
    """What each labeller says. Thresholds are parameters of the labellers, chosen by what prose looks like."""
    long = m["words"] >= 20
    return [
        between(m["symbols"], (0, 0.01), (0, 0.06)),
        between(m["upper"], (0, 0.2), (-1, 0.6)),
        between(m["digits"], (0, 0.1), (-1, 0.4)),
        between(m["repeats"], (0, 0.05), (-1, 0.3)),
        between(m["shouts"], (0, 0.05), (-1, 0.4)),
        between(m["bars"], (0, 0.02), (-1, 0.2)),
        between(m["stops"], (0.01, 0.4), (0.002, 2)) if m["words"] >= 100 else SILENT,
        between(m["copied"], (0, 0.1), (-1, 0.5)) if m["lines"] >= 6 else SILENT,
        between(m["length"], (3, 10), (2, 16)) if long else SILENT,
    ]


LABELLERS = 9


def pattern_of(said: list[int]) -> int:
    return sum(v * 3 ** k for k, v in enumerate(said))


def said_by(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(LABELLERS) % 3


@dataclass
class VoteModel:
    """prior: chance of good; right: for each labeller, chance of a right vote on bad and on good texts."""

    prior: float
    right: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        said = said_by(np.asarray(patterns, np.int64))
        says_good, says_bad = said == GOOD, said == BAD
        right_bad, right_good = self.right[:, 0], self.right[:, 1]
        good = np.log(self.prior) + says_good @ np.log(right_good) + says_bad @ np.log(1 - right_good)
        bad = np.log(1 - self.prior) + says_bad @ np.log(right_bad) + says_good @ np.log(1 - right_bad)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, slander: float = 0.002,
              trust: float = 4.0) -> VoteModel:
    """Accuracies by expectation-maximisation over pattern counts; at first a text is bad if anyone says so.

    Labellers look for different faults, so most of them call a bad text good.
    What they share is that they seldom call a good text bad: a prior of
    `slander`, worth `trust` times all texts, says so, else the model takes
    texts with a single fault for good ones.
    """
    held = trust * counts.sum()
    said = said_by(np.asarray(patterns, np.int64))
    chance = np.where((said == BAD).any(axis=1), 0.1, 0.95)
    model = VoteModel(0.5, np.full((LABELLERS, 2), 0.7))
    for _ in range(rounds):
        good, bad = chance * counts, (1 - chance) * counts
        right = np.empty((LABELLERS, 2))
        right[:, 0] = ((said == BAD).T @ bad + 0.05) / ((said != SILENT).T @ bad + 1)
        right[:, 1] = 1 - ((said == BAD).T @ good + slander * (held + 1)) / ((said != SILENT).T @ good + held + 1)
        model = VoteModel(float(np.clip((good.sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4)),
                          np.clip(right, 1e-4, 1 - 1e-4))
        before, chance = chance, model.posterior(patterns)
        if np.abs(before - chance).max(initial=0) < 1e-6:
            break
    return model


# ------------------------------------------------------------------ scorer

STEPS = {
    "symbols": 20, "upper": 10, "digits": 10, "repeats": 10, "shouts": 5, "bars": 10, "stops": 5, "copied": 10,
}


def slots(m: dict[str, float]) -> list[int]:
    """Hashed features of the labellers' properties, each in steps."""
    names = [f"{k}:{min(8, round(m[k] * steps))}" for k, steps in STEPS.items()]
    return [xxhash.xxh32_intdigest(name) % DIMENSIONS for name in names]


def trigrams(data: bytes) -> np.ndarray:
    """Hashed byte trigrams, in order; the text is padded with a space on both sides."""
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D))
            * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 12)


def features(data: bytes, m: dict[str, float]) -> np.ndarray:
    """Shares of the trigrams, to the power of a half, and 0.3 for each property's step."""
    out = np.sqrt(np.bincount(trigrams(data), minlength=DIMENSIONS) / max(1, len(data))).astype(np.float32)
    np.add.at(out, slots(m), 0.3)
    return out


def fit_scorer(rows: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.1,
               decay: float = 1e-5) -> np.ndarray:
    """Weights, the last one constant, of a logistic scorer, by full gradients with moments."""
    weights = np.zeros(DIMENSIONS + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for turn in range(1, rounds + 1 if len(rows) else 1):
        wrong = 1 / (1 + np.exp(-np.clip(rows @ weights[:-1].astype(np.float32) + weights[-1], -30, 30))) - labels
        slope = np.append(rows.T @ wrong.astype(np.float32), wrong.sum()) / len(rows) + decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        weights -= rate * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.999 ** turn)) + 1e-8)
    return weights


@dataclass
class Quality:
    """A fitted classifier."""

    votes: VoteModel
    weights: np.ndarray

    def score(self, data: bytes) -> tuple[float, int]:
        """Score of a text and its vote pattern; a text without words has score 0 and no votes."""
        if not data.strip():
            return 0.0, pattern_of([SILENT] * LABELLERS)
        m = measures(data)
        margin = float(features(data, m) @ self.weights[:-1]) + float(self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30)))), pattern_of(votes(m))


def drawn(texts: DataFrame, sample: int) -> DataFrame:
    """(place, text) of at most `sample` distinct texts with words; a text has one place, however many rows hold it."""
    place = F.shiftrightunsigned(F.xxhash64("text", F.lit(sample)), 11) / F.lit(float(1 << 53))
    placed = texts.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select(place.alias("place"), "text")
    places = written(placed.select("place").distinct(), "places")
    # The share wanted, and a little more, then exactly `sample`.
    share = min(1.0, 1.2 * sample / max(1, places.count()))
    first = places.where(F.col("place") < share).orderBy("place").limit(sample)
    last = first.agg(F.max("place")).first()[0]
    return placed.where(F.col("place") <= F.lit(last).cast("double")).dropDuplicates(["place"])


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Quality:
    """Vote model over all texts of `docs`, scorer over a sample of at most `sample` distinct texts."""
    bounded_batches(docs.sparkSession)

    def vote(piece):
        found = [pattern_of(votes(measures(t))) for t in (x.encode() for x in piece["text"].to_pylist()) if t.strip()]
        patterns, counts = np.unique(np.array(found, np.int32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(counts, pa.int64())], ["pattern", "n"])

    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One row for each pattern: at most 3 ** LABELLERS of them reach the driver.
    totals = map_rows(texts, vote, "text", "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    patterns, counts = totals["pattern"].to_numpy().astype(np.int64), totals["n"].to_numpy().astype(float)
    model = fit_votes(patterns, counts)

    def prepare(piece):
        out: list[list] = [[], []]
        for data in (x.encode() for x in piece["text"].to_pylist()):
            m = measures(data)
            out[0].append(features(data, m).astype(np.float16).tobytes())
            out[1].append(pattern_of(votes(m)))
        return pa.RecordBatch.from_arrays([piece["place"], pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32())],
                                          ["place", "row", "pattern"])

    got = map_rows(drawn(texts, sample), prepare, "text", "place double, row binary, pattern int").toArrow()
    got = got.sort_by("place")
    rows = np.empty((got.num_rows, DIMENSIONS), np.float32)
    for k, row in enumerate(got["row"]):
        rows[k] = np.frombuffer(row.as_buffer(), np.float16)
    return Quality(model, fit_scorer(rows, model.posterior(got["pattern"].to_numpy())))


def scored(docs: DataFrame, quality: Quality, text: str = "text") -> DataFrame:
    """`docs` with score, posterior (of the votes) and kept; columns of these names, in any case, are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(quality)

    @F.pandas_udf("score double, posterior double")
    def judge(texts):
        import pandas as pd

        release()
        own = shared.value
        pairs = [own.score((t or "").encode()) for t in texts]
        return pd.DataFrame({
            "score": [s for s, _ in pairs], "posterior": own.votes.posterior(np.array([p for _, p in pairs], np.int64))})

    verdict = free_name(docs, "judged")
    found = quoted(verdict)
    judged = docs.withColumn(verdict, judge(F.col(text)))
    return judged.select(
        *all_but(docs, "score", "posterior", "kept"), found["score"].alias("score"),
        found["posterior"].alias("posterior"), (found["score"] >= 0.5).alias("kept"))
