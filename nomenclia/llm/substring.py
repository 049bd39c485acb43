"""Removal of repeated passages by level-wise doubling of word windows.

A word goes if a window of ``window`` words that covers it occurs anywhere
else. A window can only repeat if the shorter ones in it do, so the levels
double: windows of about a quarter of that length are counted first; windows
repeated at one length alone are extended to twice that length (9, 18, 35 for
35), until the full length is counted or no candidate survives. Of the shorter
windows only anchors are counted, the least hash within every full window that
is still a candidate, which both places of a repeat have in common: 7 % of all
places at the first level.

Scale: equal texts are one class, known by a 128-bit digest, and stand once a
task for all. Counts are summed by task before they are dealt out by hash: what
a task alone sees twice is known to repeat, so its places go straight to their
text and one row tells the others; a passage that very many documents share is
one short row a task and a key. Full windows have two independent 64-bit
hashes. Texts are read once a level, the later ones only those with candidates.

Cases: null texts have no words and nothing is removed; texts shorter than a
window keep all; a window that repeats within one text goes too; repeated rows
are copies of each other; very long texts are hashed in pieces, and one text is
one row; an empty table gives no rows; extra columns pass through unless they
carry a result's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import drop_staged, few, keyed, python_ready, slices, stage
from nomenclia.llm.windows import mixed, run_hashes, slide, word_hashes

WINDOW = 35
#: Length of the first level's windows at least.
SHORTEST = 8
#: Places that a task gathers before it deals out their sums.
GATHER = 500_000
KEY = ["__k1", "__k2"]
SPANS = "array<struct<start:int,end:int>>"
NONE = np.iinfo(np.uint64).max


def levels(window: int) -> list[int]:
    """The lengths, each about twice the one before."""
    out = [window]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _places(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of ``size`` words that fit: their place in the whole and their text."""
    starts = np.cumsum(lengths) - lengths
    fit = np.maximum(0, lengths - size + 1)
    text = np.repeat(np.arange(len(lengths)), fit)
    return starts[text] + np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit), text


def _expanded(column: pa.Array, starts: np.ndarray) -> np.ndarray:
    """The places in the whole of every text's runs (start, end)."""
    runs, sizes = column.flatten(), np.diff(column.offsets.to_numpy())
    first = runs.field("start").to_numpy().astype(np.int64) + np.repeat(starts, sizes)
    count = (runs.field("end").to_numpy() - runs.field("start").to_numpy()).astype(np.int64)
    return np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def candidates(hashes: np.ndarray, lengths: np.ndarray, window: int, before: int | None, runs: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """Full windows (place, text) whose anchor of the level before, of ``before`` words, is among the repeated places."""
    at, text = _places(lengths, window)
    if before is None or not len(at):
        return at, text
    short = run_hashes(hashes, before)
    marked = np.full(len(short), NONE, np.uint64)
    places = _expanded(runs, np.cumsum(lengths) - lengths)
    marked[places] = short[places]
    width = window - before + 1
    alive = slide(marked, width)[at] == slide(short, width)[at]
    return at[alive], text[alive]


def anchors(hashes: np.ndarray, lengths: np.ndarray, at: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, hash) of the windows of ``length`` words that are the least of some full window in ``at``."""
    width, short = window - length + 1, run_hashes(hashes, length)
    least = np.zeros(len(hashes), np.uint64)
    if len(at):
        least[at] = slide(short, width)[at]
    largest = slide(np.concatenate([np.zeros(width - 1, np.uint64), least[: len(short)]]), width, np.maximum) if len(short) else short
    place, text = _places(lengths, length)
    some = (largest[place] == short[place]) & (largest[place] > 0) if len(place) else np.zeros(0, bool)
    return place[some], text[some], short[place[some]]


ROW = "k long, h long, c long, __k1 long, __k2 long, start int, end int"


def _dealt(h: np.ndarray, c: np.ndarray, own: np.ndarray, at: np.ndarray, copied: np.ndarray) -> pa.RecordBatch:
    """A task's windows by hash: those seen once with their place; of others the hash alone, and their places as runs that are known to repeat."""
    order = np.lexsort((c, h))
    h, c, own, at, copied = h[order], c[order], own[order], at[order], copied[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    heads = np.flatnonzero(new)
    size = np.diff(heads, append=len(h))
    many = (size > 1) | np.logical_or.reduceat(copied, heads)
    sole, told = heads[~many], heads[many]
    known = np.repeat(many, size)
    known &= ~copied  # texts that have copies go whole
    o, a = own[known], at[known]
    by = np.lexsort((a, o[:, 1], o[:, 0]))
    o, a = o[by], a[by]
    cut = np.ones(len(a), bool)
    cut[1:] = (o[1:] != o[:-1]).any(1) | (a[1:] > a[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(a)) - 1 if len(first) else first
    key = lambda i: mixed(h[i] ^ mixed(c[i]))
    k = np.concatenate([key(sole), key(told), mixed(o[first, 0] ^ a[first].astype(np.uint64))])
    n, counts = len(k), (len(sole), len(told), len(first))
    kind = np.repeat([0, 1, 2], counts)
    nothing = lambda dtype: np.zeros(len(told), dtype)
    none = np.zeros(len(first), np.uint64)
    column = lambda x, missing: pa.array(x, mask=kind == missing)
    ids = [np.concatenate([own[sole, i], nothing(np.uint64), o[first, i]]).view(np.int64) for i in (0, 1)]
    start, end = np.concatenate([at[sole], nothing(np.int64), a[first]]), np.concatenate([at[sole] + 1, nothing(np.int64), a[last] + 1])
    assert n == len(start)
    return pa.RecordBatch.from_arrays(
        [pa.array(k.view(np.int64)), column(np.concatenate([h[sole], h[told], none]).view(np.int64), 2), column(np.concatenate([c[sole], c[told], none]).view(np.int64), 2), *(column(x, 1) for x in ids), column(start.astype(np.int32), 1), column(end.astype(np.int32), 1)],
        ["k", "h", "c", *KEY, "start", "end"],
    )


def level_rows(texts: DataFrame, window: int, length: int, before: int | None) -> DataFrame:
    """The places of one level, dealt out by hash; ``texts`` has KEY, text, copied and, after the first level, runs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, gathered, seen = [], 0, set()
        for batch in slices(batches):
            digests = np.stack([batch.column(k).to_numpy() for k in KEY], 1).view(np.uint64)
            new = [x not in seen and not seen.add(x) for x in map(tuple, digests.tolist())]
            batch, digests = batch.filter(pa.array(new, pa.bool_())), digests[new]
            texts = _bytes(batch.column("text"))
            hashes, lengths = word_hashes(texts)
            at, text = candidates(hashes, lengths, window, before, batch.column("runs") if before else None)
            if length < window:
                at, text, h = anchors(hashes, lengths, at, window, length)
                c = np.zeros(len(h), np.uint64)
            else:
                h, c = run_hashes(hashes, window)[at], run_hashes(word_hashes(texts, 1)[0], window)[at]
            # What a text with copies has in full repeats; its shorter windows are judged as any other's.
            copied = batch.column("copied").to_numpy(zero_copy_only=False).astype(bool)[text] & (length == window)
            parts.append((h, c, digests[text], at - (np.cumsum(lengths) - lengths)[text], copied))
            gathered += len(h)
            if gathered > GATHER:
                yield _dealt(*map(np.concatenate, zip(*parts, strict=True)))
                parts, gathered = [], 0
        if gathered:
            yield _dealt(*map(np.concatenate, zip(*parts, strict=True)))

    return texts.mapInArrow(found, ROW)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by k: KEY, start and end of the places that repeat."""
    names = [*KEY, "start", "end"]

    def close(table: pa.Table) -> pa.Table:
        run, told = (~table[x].is_valid().to_numpy() for x in ("h", "start"))
        key, place = [table[x].fill_null(0).to_numpy() for x in ("k", "h", "c")], [table[x].fill_null(0).to_numpy() for x in names[:3]]
        order = np.lexsort((*reversed(place), *reversed(key), run))
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (*key, run)])
        first = np.append(True, ~same)
        # A text that several tasks have seen counts once.
        once = np.append(True, ~(same & np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in place])))
        group = np.cumsum(first) - 1
        count = np.bincount(group, once + 2.0 * told[order])
        several = np.empty(len(order), bool)
        several[order] = count[group] > 1
        return table.select(names).filter(pa.array((run | several) & ~told))

    left = None
    for batch in batches:
        now = pa.Table.from_batches([batch] if left is None else [*left, batch])
        k = now["k"].to_numpy()
        if not len(k):
            continue
        end = int(np.searchsorted(k, k[-1]))  # the last key may go on
        left = now.slice(end).to_batches()
        if end:
            yield from close(now.slice(0, end)).to_batches()
    if left is not None:
        yield from close(pa.Table.from_batches(left)).to_batches()


def repeats(texts: DataFrame, window: int, length: int, before: int | None) -> DataFrame:
    """KEY and runs (start, end) of the places of a level's windows that occur elsewhere too; staged."""
    met = level_rows(texts, window, length, before).repartition("k").sortWithinPartitions("k")
    found = met.mapInArrow(_repeated, "__k1 long, __k2 long, start int, end int")
    return stage(found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).cast(SPANS).alias("runs")), "repeats")


ADDED = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("kept_sha256", T.StringType())]


def without(docs: DataFrame, window: int, kept_text: bool) -> DataFrame:
    """``docs`` (text, __whole, __runs and more) with the words of its windows, or of the whole, removed."""
    added = [x for x in ADDED if kept_text or x[0] != "kept"]
    keep = [c for c in docs.columns if c not in ("text", "__whole", "__runs")]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in added]])
    arrow = to_arrow_schema(schema)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, whole, runs in zip(_bytes(batch.column("text")), batch.column("__whole").to_pylist(), batch.column("__runs").to_pylist(), strict=True):
                words = text.split()
                n, at, rest = len(words), 0, []
                if whole and n >= window:
                    words = []
                elif runs:
                    for start, end in sorted((r["start"], r["end"] - 1 + window) for r in runs):
                        if start > at:
                            rest += words[at:start]
                        at = max(at, end)
                    words = rest + words[at:]
                kept = b" ".join(words)
                out.append((n, n - len(words), *([kept.decode()] if kept_text else []), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * len(added)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), *(pa.array(c, arrow.field(n).type) for c, (n, _) in zip(columns, added, strict=True))], schema=arrow)

    return docs.mapInArrow(removed, schema)


def repeated_windows(docs: DataFrame, copied: DataFrame, window: int) -> DataFrame:
    """KEY and runs of the full windows that occur elsewhere too, of texts with such windows."""
    texts, before, runs = docs.join(few(copied).withColumn("copied", F.lit(True)), KEY, "left").withColumn("copied", F.coalesce("copied", F.lit(False))), None, None
    for length in levels(window):
        if before is not None:
            # The candidates' texts go on; of equal texts one.
            inside = texts.drop("runs").join(few(runs.select(*KEY)), KEY, "left_semi").dropDuplicates(KEY)
            texts = stage(inside.join(runs, KEY), "candidates")
        runs, last = repeats(texts, window, length, before), runs
        if last is not None:
            drop_staged(last)
        before = length
        if runs.isEmpty():
            break
    return runs


def remove_repeats(docs: DataFrame, window: int = WINDOW, kept_text: bool = False) -> DataFrame:
    """``docs`` without text, with n_words, n_removed and kept_sha256 (and ``kept``, if asked for)."""
    python_ready(docs.sparkSession)
    rows = keyed(docs.drop(*dict(ADDED)), "text")
    copied = stage(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "copied")
    runs = repeated_windows(rows.select(*KEY, "text"), copied, window)
    # Only texts that lose some of their words meet their runs.
    sole = runs.join(few(copied), KEY, "left_anti").withColumnRenamed("runs", "__runs")
    no_runs, whole = F.lit(None).cast(SPANS).alias("__runs"), F.lit(True).alias("__whole")
    copies = rows.join(few(copied), KEY, "left_semi").select("*", no_runs, whole)
    sole = stage(sole, "sole")
    cut = rows.join(few(sole.select(*KEY)), KEY, "left_semi").join(sole, KEY).withColumn("__whole", F.lit(False))
    other = rows.join(few(copied.unionByName(sole.select(*KEY))), KEY, "left_anti").select("*", no_runs, F.lit(False).alias("__whole"))
    out = without(copies.unionByName(cut).unionByName(other).drop(*KEY), window, kept_text)
    return out.select(*[c for c in docs.columns if c not in (dict(ADDED).keys() | {"text"})], *[n for n, _ in ADDED if n in out.columns])
