"""Language-model scoring by a probabilistic suffix tree.

Tokens are words (A-Z lower-cased) and one end token a text; the base is their
add-one unigram model. The tree models the same tokens as they are spelled:
words parted by one space, then the end, so its symbols are bytes. A context
is the last 1 to ``DEPTH`` symbols, and longer ones are looked at level by
level. A context that the training texts hold ``LEAST_COUNT`` times is retained
if its next-symbol distribution diverges from that of its suffix: its count
times the Kullback-Leibler divergence reaches the number of its next symbols. A
retained context keeps all its next symbols, absolutely discounted; the rest of
its probability goes to its longest retained suffix, down to the root, an
add-one model of all symbols. A word's spelling has the product of its symbols'
probabilities, each by the state of the longest retained suffix. A text's score
is the log10 of the product of its words' probabilities, each half by its
spelling and half by the base (``blended``). Counts take all training texts:
more text retains more contexts. The depth is a bound, of disk: README has what
it costs.

Scale: nothing of the model is collected or broadcast. Texts are dealt into
chunks by a digest; a chunk's distinct contexts and words, a few in a hundred of
its places, are counted by key over all chunks; the tree is built level by level
as joins of tables; each chunk gets back the values of its own keys, which a
task holds while the chunk's texts stream past. Work and traffic grow with the
texts, a task's memory only with ``CHUNK``.

Cases: null and empty texts are the end token alone; without training rows
there is the root only, with N and V of 0; repeated rows count each time; equal
scores are no case; very long texts are one row and are taken in slices; an
empty table gives no rows; extra columns pass through unless they carry a
result's name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import drop_staged, python_ready, slices, stage
from nomenclia.llm.windows import word_hashes

#: Symbols of a context at most; with the next symbol they are one 64-bit key.
DEPTH = 5
LEAST_COUNT = 4
DISCOUNT = 0.5
#: Bytes of text in a chunk.
CHUNK = 32 << 20
#: Distinct keys that a task merges at a time.
MERGE = 2_000_000
END = b"\n"
SEPARATOR = 32
LN10 = math.log(10)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SYMBOL, TOKEN, TEXT = 0, 1, 2


def spelled(text: str | None) -> bytes:
    """A text's tokens as symbols; bytes.split() parts at space and ASCII 9-13 alone."""
    return b" ".join((text or "").encode().translate(LOWER).split()) + END


def symbol_keys(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """Of every symbol of the texts, end to end: the symbol (lowest byte) and the ``depth`` ones before it; a text follows an end, and nothing stands before that."""
    data = np.frombuffer(END + b"".join(texts), np.uint8).astype(np.uint64)
    out = data[1:].copy()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.arange(len(out)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for d in range(1, depth + 1):
        before = np.zeros(len(out), np.uint64)
        before[d - 1 :] = data[: len(out) - d + 1]
        before[inside < d - 1] = 0
        out |= before << np.uint64(8 * d)
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


def _counted(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many of them are ``of`` training texts."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for chosen, weight in ((keys[of], 1), (keys[~of], 0)):
        ordered = np.sort(chosen)
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        parts.append((ordered[heads], weight * np.diff(heads, append=len(ordered))))
    return _merged(parts)


class Counts:
    """A chunk's distinct keys so far, and how often training texts hold them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.held = 0

    def add(self, keys: np.ndarray, of: np.ndarray) -> None:
        self.parts.append(_counted(keys, of))
        self.held += len(self.parts[-1][0])
        if self.held > MERGE:
            self.parts, self.held = [self.total()], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.parts)


def runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where one of the columns, by which they are sorted, changes."""
    for batch in batches:
        if batch.num_rows:
            values = np.stack([batch.column(c).to_numpy() for c in columns], 1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tuple(values[a].tolist()), batch.slice(a, b - a)


def chunk_keys(texts: DataFrame) -> DataFrame:
    """(chunk, kind, key, n) of ``texts`` (chunk, text, train): the distinct symbols in context and tokens of each chunk; staged."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(chunk: int, counts: tuple[Counts, Counts]) -> Iterator[pa.RecordBatch]:
            for kind, c in zip((SYMBOL, TOKEN), counts, strict=True):
                keys, n = c.total()
                for s in range(0, len(keys), 1 << 16):
                    k = keys[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk, np.int32)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[s : s + (1 << 16)])], ["chunk", "kind", "key", "n"])

        at, counts = None, (Counts(), Counts())
        for (chunk,), run in runs(batches, "chunk"):
            if chunk != at:
                if at is not None:
                    yield from given(at, counts)
                at, counts = chunk, (Counts(), Counts())
            for part in slices([run]):
                texts = [spelled(t) for t in part.column("text").to_pylist()]
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                counts[0].add(symbol_keys(texts), np.repeat(train, [len(t) for t in texts]))
                hashes, lengths = token_hashes(texts)
                counts[1].add(hashes, np.repeat(train, lengths))
        if at is not None:
            yield from given(at, counts)

    dealt = texts.repartition("chunk").sortWithinPartitions("chunk")
    return stage(dealt.mapInArrow(found, "chunk int, kind byte, key long, n long"), "keys")


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of spelled texts, the end (hash 0) after each text's words, and their numbers."""
    hashes, lengths = word_hashes(texts)
    ends = np.cumsum(lengths)
    return np.insert(hashes, ends, np.uint64(0)), lengths + 1


def states(counts: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT) -> list[DataFrame]:
    """By level, from the root on: (key, n, total, p, kept) of every symbol in context of ``counts`` (key, n), n being 0 where only texts that are scored have it; each staged.

    ``kept`` tells whether the context is a state, and ``p`` is the symbol's
    probability by the longest suffix of the context that is one.
    """
    levels = [counts]
    for d in range(depth - 1, -1, -1):
        mask = (1 << (8 * (d + 1))) - 1
        levels.insert(0, levels[0].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")))
    n, total = F.col("n"), F.col("total")
    whole = Window.partitionBy()
    out = [stage(levels[0].withColumn("total", F.sum("n").over(whole)).select("key", "n", "total", ((n + 1) / (total + 256)).alias("p"), F.lit(True).alias("kept")), "states")]
    for d in range(1, depth + 1):
        of = Window.partitionBy("context")
        level = levels[d].withColumn("context", F.shiftrightunsigned("key", 8)).select("*", F.sum("n").over(of).alias("total"), F.count_if(n > 0).over(of).alias("kinds"), F.col("key").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("suffix"))
        shorter = out[-1].select(F.col("key").alias("suffix"), F.try_divide(n, total).alias("share"), F.col("p").alias("below"))
        gain = F.sum(F.when(n > 0, n * F.log(n / total / F.col("share")))).over(of)
        met = level.join(shorter, "suffix").withColumn("kept", (total >= least) & (gain >= F.col("kinds")))
        own = F.when(n > 0, (n - DISCOUNT) / total).otherwise(0.0) + F.try_divide(DISCOUNT * F.col("kinds"), total) * F.col("below")
        out.append(stage(met.select("key", "n", "total", F.when(F.col("kept"), own).otherwise(F.col("below")).alias("p"), F.coalesce("kept", F.lit(False)).alias("kept")), "states"))
    return out


ADDED = [("train_tokens", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def _scores(texts: list[bytes], values: dict[int, tuple[np.ndarray, np.ndarray]], total: int, unit: float) -> list[tuple]:
    """The added columns of up to 256 texts, by the chunk's values."""
    keys, logs = values[SYMBOL]
    asked = symbol_keys(texts)
    # Sorted lookups are near each other.
    order = np.argsort(asked)
    of_symbol = np.empty(len(asked))
    of_symbol[order] = logs[np.searchsorted(keys, asked[order])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    stops = (data == SEPARATOR) | (data == END[0])
    tree = np.add.reduceat(of_symbol, np.flatnonzero(np.append(True, stops[:-1]))) if len(data) else of_symbol

    hashes, lengths = token_hashes(texts)
    keys, counts = values[TOKEN]
    c = counts[np.searchsorted(keys, hashes)]
    of = np.repeat(np.arange(len(texts)), lengths)
    known, logs = np.bincount(of, c > 0, len(texts)), np.log10(c + 1.0) - unit
    base = np.bincount(of, logs, len(texts))
    gains = np.bincount(np.repeat(np.arange(len(texts)), np.maximum(lengths - 1, 1)), blended(tree, logs, c > 0, lengths), len(texts))
    return list(zip([total] * len(texts), lengths.tolist(), known.astype(np.int64).tolist(), base.tolist(), gains.tolist(), strict=True))


def blended(tree: np.ndarray, logs: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of every word with what follows it (a text without words: its end), half by the tree and half by the base.

    ``tree`` has a value for each of these; ``logs`` and ``known`` have one for
    each token, the end of each text included. Given that a text goes on, the
    base gives a word p / (1 - p(end)), and another word follows with 1 - p(end).
    Words that no training text has are one symbol to the base; of the tree's
    part of that symbol, the word's own spelling is counted alone.
    """
    last = np.cumsum(lengths) - 1
    end, met = logs[last], known[last]
    more = np.log10(np.where(met, 1 - 10.0**end, 1.0))
    # The end joins the last word; a text of nothing else keeps it.
    ends, alone = np.zeros(len(logs), bool), lengths == 1
    ends[last[~alone]] = True
    own = logs[~ends].copy()
    units = np.maximum(lengths - 1, 1)
    finals = np.cumsum(units) - 1
    firsts = finals - units + 1
    many = units > 1
    own[firsts[many]] += more[many]
    own[finals[many]] -= more[many]
    own[finals[~alone]] += end[~alone]
    return np.logaddexp(tree * LN10, own * LN10) / LN10 - math.log10(2)


def score(docs: DataFrame, train: Column) -> DataFrame:
    """``docs`` without text, with the scores of a model learned from those of its rows where ``train`` holds."""
    python_ready(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text" and c not in dict(ADDED)]
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64("text", *[c for c in keep if docs.schema[c].dataType.typeName() in ("long", "integer", "string")]), F.lit(1 + size // CHUNK)).cast("int")
    texts = docs.select(*keep, "text", chunk.alias("__chunk"), F.coalesce(train, F.lit(False)).alias("__train"))

    keys = chunk_keys(texts.select(F.col("__chunk").alias("chunk"), "text", F.col("__train").alias("train")))
    symbols, tokens = keys.where(f"kind = {SYMBOL}"), keys.where(f"kind = {TOKEN}")
    counts = stage(symbols.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    tree = states(counts)
    words = stage(tokens.groupBy("key").agg(F.sum("n").alias("n")), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, unit = int(sums["n"]), math.log10(int(sums["n"]) + int(sums["v"]) + 1)

    # Every chunk's keys with their values, then its texts.
    value = tree[-1].select("key", F.log10("p").alias("value")).withColumn("kind", F.lit(SYMBOL).cast("byte"))
    value = value.unionByName(words.select("key", F.col("n").cast("double").alias("value"), F.lit(TOKEN).cast("byte").alias("kind")))
    known = keys.select("chunk", "kind", "key").join(value, ["kind", "key"])
    rest = T.StructType([docs.schema[c] for c in keep])
    asked = known.select(F.col("chunk").alias("__chunk"), F.col("kind").alias("__kind"), F.col("key").alias("__key"), F.col("value").alias("__value"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(rest).alias("__rest"))
    given = texts.select("__chunk", F.lit(TEXT).cast("byte").alias("__kind"), F.lit(0).cast("long").alias("__key"), F.lit(0.0).alias("__value"), "text", F.struct(*keep).alias("__rest"))
    schema = T.StructType([*rest.fields, *[T.StructField(n, t) for n, t in ADDED]])
    arrow = to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, values = None, {}, {}
        for (chunk, kind), run in runs(batches, "__chunk", "__kind"):
            if chunk != at:
                at, parts, values = chunk, {SYMBOL: [], TOKEN: []}, {}
            if kind != TEXT:
                parts[kind].append((run.column("__key").to_numpy().view(np.uint64), run.column("__value").to_numpy()))
                continue
            if not values:
                for k, part in parts.items():
                    key, value = (np.concatenate(x) for x in zip(*part, strict=True))
                    order = np.argsort(key)
                    values[k] = key[order], value[order]
                parts = {}
            for part in slices([run]):
                out = _scores([spelled(t) for t in part.column("text").to_pylist()], values, total, unit)
                own = part.column("__rest").flatten()
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, arrow, strict=False)), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[len(own) :], strict=True))], schema=arrow)

    met = asked.unionByName(given).repartition("__chunk").sortWithinPartitions("__chunk", "__kind")
    out = stage(met.mapInArrow(scored, schema), "scores")
    for staged in (keys, counts, words, *tree):
        drop_staged(staged)
    return out
