"""Operator 4: quality classifier from overlapping heuristic labellers.

Each labeller votes good (1), bad (-1) or nothing (0) on a text. Expectation-maximisation over the counts of vote
patterns, taken over all rows, estimates how each labeller votes on good and on bad texts, and gives each pattern a
posterior. A logistic regression on hashed features is then trained on the posteriors of a sample of ``FIT_ROWS``
rows at most, and scores every row. Counts, features and scores are computed where the rows are; only the table of
patterns (3 to the number of labellers at most) and the weights come to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staveframe.llm._batches import chunks, hashed, quoted

# Frequent function words of the languages of the texts.
STOP = frozenset(
    "the of and to in is it that for on with was be this are as at by an or from "
    "der die das und in zu den mit von ist des auf für nicht ein eine dem sich "
    "de la le les et des en un une du que pour dans est qui sur par pas au "
    "el los las y del se por con una para su al lo como más que no".split()
)
#: Signs that a word may carry at its ends.
EDGES = ".,;:!?'\"()"
LABELLERS = ("symbols", "capitals", "digits", "stop_words", "word_length", "variety", "neighbours", "closing", "lines")
#: Characters by class: 0 space, 1 line feed, 2 lower case, 3 upper case, 4 digit, 5 other letter, from 6 on own classes of signs, last: other sign.
SIGNS = ".,;:!?'\"-()|*#$%&@/_=<>"
CLASSES = 7 + len(SIGNS)
DIMENSIONS = 1 << 10
#: Rows that the scorer is fitted on, at most, and the partitions that they are dealt to.
FIT_ROWS, FIT_PARTS = 8_000, 8


def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; other planes count as the last class."""
    table = np.full(1 << 16, CLASSES - 1, dtype=np.uint8)
    for c in range(1 << 16):
        x = chr(c)
        if x == "\n":
            table[c] = 1
        elif x.isspace():
            table[c] = 0
        elif x.islower():
            table[c] = 2
        elif x.isupper():
            table[c] = 3
        elif x.isdigit():
            table[c] = 4
        elif x.isalpha():
            table[c] = 5
    for k, x in enumerate(SIGNS):
        table[ord(x)] = 6 + k
    return table


class Reader:
    """Votes and hashed features of texts."""

    def __init__(self):
        self.table = class_table()

    def classes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return np.where(points < (1 << 16), self.table[np.minimum(points, (1 << 16) - 1)], CLASSES - 1).astype(np.int64)

    def measure(self, text: str, classes: np.ndarray) -> dict[str, float]:
        words = text.split()
        n, kinds = max(1, len(words)), Counter(words)
        many = np.bincount(classes, minlength=CLASSES)
        solid = max(1, len(classes) - int(many[:2].sum()))
        letters = max(1, int(many[[2, 3, 5]].sum()))
        lines = [x for x in text.split("\n") if x]
        closing = int(many[6:8].sum())  # full stops and commas
        return {
            "words": len(words), "symbols": float(many[6 + SIGNS.index("|") :].sum() + many[6 + SIGNS.index("!")]) / solid, "capitals": many[3] / letters, "digits": many[4] / solid,
            "stop_words": sum(k for w, k in kinds.items() if w.strip(EDGES).lower() in STOP) / n, "word_length": solid / n, "variety": len(kinds) / n, "neighbours": sum(map(eq, words, words[1:])) / n,
            "closing": closing / n, "lines": 1 - len(set(lines)) / max(1, len(lines)),
        }

    @staticmethod
    def votes(m: dict[str, float]) -> list[int]:
        """A vote of each labeller; all abstain on texts without words, most on short ones."""
        if not m["words"]:
            return [0] * len(LABELLERS)
        short = m["words"] < 20
        return [
            -1 if m["symbols"] > 0.03 else 1 if m["symbols"] < 0.005 else 0,
            -1 if m["capitals"] > 0.4 else 1 if m["capitals"] < 0.15 else 0,
            -1 if m["digits"] > 0.3 else 1 if m["digits"] < 0.1 else 0,
            0 if short else -1 if m["stop_words"] < 0.03 else 1 if m["stop_words"] > 0.08 else 0,
            0 if short else -1 if not 2 <= m["word_length"] <= 14 else 1 if 3 <= m["word_length"] <= 11 else 0,
            0 if short else -1 if m["variety"] < 0.1 else 1 if m["variety"] > 0.3 else 0,
            0 if short else -1 if m["neighbours"] > 0.1 else 1 if m["neighbours"] < 0.04 else 0,
            0 if short else -1 if m["closing"] < 0.005 else 1 if m["closing"] > 0.02 else 0,
            0 if short else -1 if m["lines"] > 0.5 else 1 if m["lines"] < 0.2 else 0,
        ]

    def features(self, classes: np.ndarray, m: dict[str, float]) -> np.ndarray:
        """Ten times the square roots of the shares of hashed runs of three classes, and of hashed steps of the measures."""
        runs = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]
        out = np.bincount(runs * 2654435761 % (1 << 32) >> 22, minlength=DIMENSIONS) / max(1, len(runs))
        for k, name in enumerate(LABELLERS):
            step = int(min(15, m[name] * 50 if name not in ("word_length", "variety") else m[name] * (1 if name == "word_length" else 15)))
            out[(7919 * (k * 16 + step + 1) * 2654435761 % (1 << 32)) >> 22] += 0.1
        return 10 * np.sqrt(out)


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``votes array<int>`` of every row. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in chunks(batches, "text"):
            rows = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([reader.votes(reader.measure(t, reader.classes(t))) for t in rows], pa.list_(pa.int32()))], ["votes"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "votes array<int>")


class LabelModel:
    """How each labeller votes on bad and on good texts where it votes, and the share of good ones."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        self.good = 0.9
        #: Chance of a vote "bad" on a bad and on a good text, to begin with.
        self.bad = np.repeat([[0.4, 0.02]], len(LABELLERS), axis=0)
        for _ in range(rounds if len(patterns) else 0):
            p = self.posterior(patterns)
            self.good = float((p * counts).sum() / counts.sum())
            for j in range(len(LABELLERS)):
                for y, weight in enumerate(((1 - p) * counts, p * counts)):
                    against, cast = weight[patterns[:, j] == -1].sum(), weight[patterns[:, j] != 0].sum()
                    # A prior of ten votes holds what is seldom seen; a labeller is never better than 999 in 1000.
                    self.bad[j, y] = np.clip((against + 10 * (0.4, 0.02)[y]) / (cast + 10), 0.001, 0.999)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good; a labeller that abstains says nothing."""
        odds = np.full(len(patterns), np.log((self.good + 1e-9) / (1 - self.good + 1e-9)))
        for j in range(len(LABELLERS)):
            odds += np.where(patterns[:, j] == -1, np.log(self.bad[j, 1] / self.bad[j, 0]), 0.0)
            odds += np.where(patterns[:, j] == 1, np.log((1 - self.bad[j, 1]) / (1 - self.bad[j, 0])), 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among each labeller's votes."""
        return dict(zip(LABELLERS, ((1 - self.good) * self.bad[:, 0] + self.good * (1 - self.bad[:, 1])).tolist(), strict=True))


def fit_labels(docs: DataFrame, text_col: str = "text") -> LabelModel:
    """The label model of all rows."""
    rows = votes(docs, text_col).groupBy("votes").count().collect()  # one row for each pattern
    return LabelModel(np.array([r["votes"] for r in rows], dtype=np.int64).reshape(-1, len(LABELLERS)), np.array([r["count"] for r in rows], dtype=np.float64))


def fit_scorer(docs: DataFrame, labels: LabelModel, fit_rows: int = FIT_ROWS, text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear scorer, trained on posteriors of about ``fit_rows`` rows drawn by a hash of
    all their columns (all, where there are fewer): each row counts as good and as bad with the weights that the
    posterior gives. The rows are fitted in the order of that hash, so that it does not matter how they are dealt."""
    n = docs.count()
    place = F.xxhash64(*hashed(docs))
    drawn = docs.where(F.pmod(place, F.lit(1 << 20)) < int((1 << 20) * fit_rows / n)) if n > fit_rows else docs
    source = drawn.select(place.alias("place"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in chunks(batches, "text"):
            columns: list[list] = [[], [], [], []]
            for place, t in zip(batch.column("place").to_pylist(), (x or "" for x in batch.column("text").to_pylist()), strict=True):
                classes = reader.classes(t)
                m = reader.measure(t, classes)
                p = float(labels.posterior(np.array([reader.votes(m)]))[0])
                x = reader.features(classes, m).tolist()
                for label, weight in ((1.0, p), (0.0, 1 - p)):
                    if weight > 1e-3:
                        for column, value in zip(columns, (place, label, weight, x), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.list_(pa.float64()))], ["place", "label", "weight", "x"])

    rows = source.mapInArrow(run, "place long, label double, weight double, x array<double>")
    part = F.pmod(F.col("place"), F.lit(FIT_PARTS)).cast("int")
    rows = rows.repartitionById(FIT_PARTS, part).sortWithinPartitions("place", "label").select("label", "weight", array_to_vector("x").alias("features")).persist()
    try:
        kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(kinds) < 2:  # nothing to tell apart: every text scores as the labels say
            return np.zeros(DIMENSIONS), 10.0 if 0.0 not in kinds else -10.0
        model = LogisticRegression(weightCol="weight", regParam=1e-6, maxIter=80, standardization=False).fit(rows)
    finally:
        rows.unpersist()
    return model.coefficients.toArray(), float(model.intercept)


def score(docs: DataFrame, labels: LabelModel | None = None, scorer: tuple[np.ndarray, float] | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``posterior`` (of the votes), ``score`` (of the linear scorer, 0 to 1) and
    ``keep`` (``score >= least``) added; columns of these names are replaced.

    Null texts count as empty; texts without words get no votes, posterior and score are then the prior's and the
    intercept's, and they are kept, as nothing speaks against them. Repeated rows are scored once each.
    """
    labels = fit_labels(docs, text_col) if labels is None else labels
    weights, intercept = fit_scorer(docs, labels, text_col=text_col) if scorer is None else scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in chunks(batches, "text"):
            posterior, scores, keep = [], [], []
            for t in (x or "" for x in batch.column("text").to_pylist()):
                classes = reader.classes(t)
                m = reader.measure(t, classes)
                posterior.append(reader.votes(m))
                z = float(reader.features(classes, m) @ weights) + intercept
                scores.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
                keep.append(scores[-1] >= least or not m["words"])
            p = labels.posterior(np.array(posterior).reshape(-1, len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(p), pa.array(scores, pa.float64()), pa.array(keep, pa.bool_())], ["doc", "posterior", "score", "keep"])

    columns = [c for c in docs.columns if c not in ("posterior", "score", "keep")]
    source = docs.select(F.struct(*map(quoted, columns)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([source.schema["doc"]]).add("posterior", "double").add("score", "double").add("keep", "boolean")
    done = source.mapInArrow(run, schema)
    return done.select(*[F.col("doc").getField(c).alias(c) for c in columns], "posterior", "score", "keep")
