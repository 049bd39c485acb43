"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most ``limit`` tokens. Pieces are dealt over
groups of about ``group_rows``; every group packs by best-fit decreasing and
computes lower bounds on its bin count from families of dual feasible
functions. A group whose count meets its bound is certified: its bins stay,
but for the emptiest one, which rounding may have left over. A group with a
gap keeps its (nearly) full bins and gives up the documents of the others.
What the groups give up is exchanged: dealt anew over fewer groups and packed
again, until one group holds the rest or the rounds end.

Cases: a null text is an empty one, and an empty text is one piece of the end
id alone; a very long text is one row while it is encoded and many pieces after
that; repeated rows, and pieces of equal length, are packed as rows of their
own in any order; an empty table gives no pieces; extra columns are carried
along unless they have a result's name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import python_ready, slices, stage
from nomenclia.llm.tokens import MEMO, encoder

LIMIT = 2048
END_ID = 0
GROUP_ROWS = 2000
ROUNDS = 4
#: Tokens that a bin of a group with a gap may leave free and still be kept.
SPARE = 8


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """``docs`` without text, one row a piece: piece, start, length, ids_crc32."""
    added = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    keep = [c for c in docs.columns if c != "text" and c not in dict(added)]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in added]])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, memo)
        kind = f"<u{encode.width}"
        for batch in slices(batches):
            of, out = [], []
            for row, ids in enumerate(encode.encode([t or "" for t in batch.column("text").to_pylist()])):
                whole = np.append(np.frombuffer(ids, kind), [end_id]).astype("<u4")
                first = len(whole) % limit or limit
                at = [0, *range(first, len(whole), limit), len(whole)]
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    of.append(row)
                    out.append((k, a, b - a, zlib.crc32(whole[a:b].tobytes())))
            kept = batch.select(keep).take(pa.array(of, pa.int64()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(kept.columns)] + [pa.array(c, arrow.field(n).type) for c, (n, _) in zip(columns, added, strict=True)], schema=arrow)

    python_ready(docs.sparkSession)
    return docs.mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, limit: int) -> float:
    """The best of the dual feasible bounds on the number of bins, before rounding up."""
    count = np.bincount(lengths, minlength=limit + 1)
    size = np.arange(limit + 1)
    above, weight = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    e = np.arange(1, limit // 2 + 1)  # sizes over limit - e count as a whole bin, those under e as nothing
    best = float((np.append(above, 0)[limit - e + 1] + (weight[limit - e] - weight[e - 1]) / limit).max())
    best = max(best, float(weight[-1]) / limit)
    for k in range(1, 21):  # sizes rounded to multiples of 1/k, the exact multiples of 1/(k + 1) left as they are
        scaled = (k + 1) * size
        best = max(best, float((count * np.where(scaled % limit == 0, size / limit, scaled // limit / k)).sum()))
    return best


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's free room.

    Bins are stacks by free room; one bit a room tells which are non-empty, so
    the tightest fit is the lowest set bit at or above the item's length.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            at = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
        else:
            at, free = len(room), limit
            room.append(limit)
        bins[item], offsets[item] = at, limit - free
        room[at] = left = free - need
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(at)
    return bins, offsets, np.array(room, np.int64)


def kept_bins(lengths: np.ndarray, room: np.ndarray, limit: int, spare: int = SPARE) -> np.ndarray:
    """Which bins stay: all but the emptiest of a certified group, the nearly full ones of another."""
    keep = np.ones(len(room), bool)
    if len(room) > math.ceil(lower_bound(lengths, limit) - 1e-9):
        keep = room <= spare
    keep[np.argmax(room)] &= room.max() <= spare
    return keep


def _packer(turn: int, last: bool, limit: int):
    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, room = best_fit(lengths, limit)
        keep = np.ones(len(room), bool) if last else kept_bins(lengths, room, limit)
        return group.drop(columns="__group").assign(sequence_id=(turn << 56) + (int(key[0]) << 20) + bins, offset=offsets, __kept=keep[bins])

    return packed


def pack(items: DataFrame, limit: int = LIMIT, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (with ``length``, 1 to ``limit``) with ``sequence_id`` and ``offset``.

    ``items`` is staged; rows are told apart by their place in the staged files.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    python_ready(items.sparkSession)
    rest, done = stage(items.select(*names), "pieces"), []
    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__kept", T.BooleanType())])
    for turn in range(rounds):
        groups = max(1, math.ceil(rest.count() / group_rows))
        last = groups == 1 or turn == rounds - 1
        dealt = rest.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)))
        out = stage(dealt.groupBy("__group").applyInPandas(_packer(turn, last, limit), schema), "packed")
        done.append(out.where("__kept").drop("__kept"))
        if last:
            break
        rest = stage(out.where("not __kept").select(*names), "exchanged")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole
