"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a general lexicon of abuse and of one
learned from the labels, abuse near second-person words, capitals,
punctuation and obfuscation. Labels, language, source and id are no inputs.
Training takes at most ``TRAIN_ROWS`` labelled rows, those of the smallest id
digests; the trees see three quarters of them, the calibration the rest.

Cases: null and empty texts have all-zero features and a score of their own;
without usable labels every score is 0; a document counts once for each value
that its labels have, however often its row or its labels repeat; features are rates, so a very long text is scored
as any other; equal texts have equal scores, and 0.5 counts as toxic; an empty
table gives no rows; extra columns pass through unless they carry a result's
name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import python_ready, slices

TRAIN_ROWS = 20_000
LEARNED_WORDS = 100
#: Abuse in common use, and words that address the reader.
ABUSE = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting filthy vermin clown fool imbecile retard bastard bitch whore slut cunt dick asshole shit fuck fucking crap hate kill ugly freak creep parasite cretin jerk dumbass lunatic coward liar pig swine".split())
ADDRESS = frozenset("you your yours yourself youre ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti su".split())
EDGES = "\"'`.,;:!?()[]{}<>#$%&*|~^+-=_/\\…«»„“”’"
MIXED = re.compile(r"[^\W\d_][0-9@$!*+_.\-]+[^\W\d_]")
PLAIN = str.maketrans("013457@$!+", "oleastasit", "*._-")
REPEATED = re.compile(r"([^\W\d_])\1\1")
NEAR = 3
NAMES = ("abuse", "abuse_rate", "learned", "learned_rate", "kinds", "near", "near_rate", "capitals", "bangs", "punctuation", "odd_symbols", "mixed_rate", "hidden", "stretched_rate", "words")


def text_features(text: str, learned: frozenset[str]) -> list[float]:
    raw = text.lower().split()
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    words = [w.strip(EDGES) for w in raw]
    abuse = [k for k, w in enumerate(words) if w in ABUSE]
    own = [w for w in words if w in learned]
    hidden = 0
    mixed = [w for w in words if not w.isalpha() and MIXED.search(w)]
    for w in mixed:
        plain = w.translate(PLAIN)
        hidden += plain in ABUSE or plain in learned
    places = abuse + [k for k, w in enumerate(words) if w in learned and w not in ABUSE]
    near = sum(any(w in ADDRESS for w in words[max(0, k - NEAR) : k + NEAR + 1]) for k in places)
    marks = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, letters = len(text), int(marks[65:91].sum() + marks[97:123].sum())
    dots, odd = int(marks[[33, 44, 46, 58, 59, 63]].sum()), int(marks[[35, 36, 37, 38, 42, 64, 94, 124, 126]].sum())
    log = np.log1p
    return [
        float(log(len(abuse))), len(abuse) / n, float(log(len(own))), len(own) / n, float(len(set(own) | {words[k] for k in abuse})), float(log(near)), near / n,
        int(marks[65:91].sum()) / max(1, letters), int(marks[33]) / size, dots / size, odd / size, len(mixed) / n, float(log(hidden)), len(REPEATED.findall(text)) / n, float(log(n)),
    ]


@dataclass
class Trees:
    """Boosted depth-limited trees on binned features, for the logistic loss."""

    edges: list[np.ndarray]
    trees: list[tuple[list[tuple[int, int]], np.ndarray]]  # (feature, bin) of each inner node by level order, leaf values
    base: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        edges = [np.unique(np.append(e, np.quantile(c[c > c.min()], [0, 0.25, 0.5, 0.75]) if (c > c.min()).any() else e)) for e, c in zip(edges, x.T, strict=True)]
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        width = max(len(e) for e in edges) + 2
        base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        score, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node, inner = np.zeros(len(y), np.int64), []
            for level in range(depth):
                splits = []
                count = 1 << level
                best = np.full(count, 1e-9)
                choice = [(0, width)] * count  # everything to the left
                for f in range(len(code)):
                    flat = node * width + code[f]
                    g = np.bincount(flat, grad, count * width).reshape(count, width).cumsum(1)
                    h = np.bincount(flat, hess, count * width).reshape(count, width).cumsum(1)
                    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    at = gain.argmax(1)
                    for k in np.nonzero(gain[np.arange(count), at] > best)[0].tolist():
                        best[k], choice[k] = gain[k, at[k]], (f, int(at[k]))
                splits = choice
                inner += splits
                feature, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
                node = node * 2 + (code[feature[node], np.arange(len(y))] > cut[node])
            g, h = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
            leaves = rate * g / (h + ridge)
            trees.append((inner, leaves))
            score = score + leaves[node]
        return Trees(edges, trees, base)

    def margin(self, x: np.ndarray) -> np.ndarray:
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for inner, leaves in self.trees:
            node, start, count = np.zeros(len(x), np.int64), 0, 1
            while start < len(inner):
                level = inner[start : start + count]
                feature, cut = np.array([s[0] for s in level]), np.array([s[1] for s in level])
                node = node * 2 + (code[feature[node], rows] > cut[node])
                start, count = start + count, count * 2
            score = score + leaves[node]
        return score


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first and last margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    at = np.array([[b[2], b[3]] for b in blocks]).ravel()
    value = np.repeat([b[0] / b[1] for b in blocks], 2)
    return at, value


@dataclass
class Model:
    learned: frozenset[str]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a small share of the raw one keeps the order within a step."""
        if self.trees is None or not len(x):
            return np.zeros(len(x))
        margin = self.trees.margin(x)
        return np.clip(0.99 * np.interp(margin, *self.knots) + 0.01 / (1 + np.exp(-margin)), 0, 1)


def learn_words(rows: DataFrame, words: int = LEARNED_WORDS) -> frozenset[str]:
    """The words that most raise the odds of the label, counted over the rows' whole texts."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+", " ")
    seen = rows.select("toxic", F.explode(F.array_distinct(F.split(F.trim(plain), " "))).alias("word")).where("word <> ''")
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not totals[1] or not totals[0] or totals[0] == totals[1]:
        return frozenset()
    yes, no = totals[0], totals[1] - totals[0]
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (yes + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (no + 1))
    found = counts.where((F.col("p") >= max(5, yes // 50))).withColumn("odds", odds).where("odds > 2.5")
    return frozenset(r["word"] for r in found.orderBy(F.desc("odds"), "word").limit(words).collect())


def featured(docs: DataFrame, learned: frozenset[str]) -> DataFrame:
    """``docs`` without text, with the array column ``features``."""
    keep = [c for c in docs.columns if c not in ("text", "features")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("features", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [text_features(t or "", learned) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), pa.array(x, arrow.field("features").type)], schema=arrow)

    python_ready(docs.sparkSession)
    return docs.mapInArrow(rows, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"), digest.alias("digest")).orderBy("digest", "toxic").limit(rows)
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` narrow rows
    sample = sample.dropDuplicates(["doc_id", "toxic"])  # ids that repeat add nothing, so the bound holds for texts too
    learned = learn_words(sample.select("toxic", "text"))
    got = featured(sample.select("toxic", "digest", "text"), learned).orderBy("digest").collect()
    y = np.array([r["toxic"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(learned, None, (np.zeros(2), np.zeros(2)))
    x = np.array([r["features"] for r in got], float)
    held = np.array([r["digest"][-1] < "4" for r in got])  # the smallest digests are the sample, so by their ends
    if len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    trees = Trees.fit(x[~held], y[~held])
    use = held if held.any() else ~held
    return Model(learned, trees, isotonic(trees.margin(x[use]), y[use]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or the columns ``keep`` of it, with ``score`` (0 to 1) of every whole text and ``predicted`` (score >= 0.5)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([text_features(t or "", model.learned) for t in batch.column("text").to_pylist()], float).reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], schema=arrow)

    python_ready(docs.sparkSession)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rows, schema)


def fold(column: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
