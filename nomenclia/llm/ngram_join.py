"""N-gram Jaccard self-join by partitions of the universe, verified exactly.

A document's set holds hashes of its distinct runs of ``n`` words. Two sets
link when ``100 * |intersection| >= 75 * |union|``; then they differ in at
most ``H = (|r| + |s|) / 7`` members. Sizes fall into bands [2^k, 2^(k+1)); a
pair belongs to the band of its smaller set, and a set also serves the band
below if a partner there is in reach. In each band the universe is cut into
segments by hash, so a linked pair disagrees in at most H of them:

1. Every non-empty segment is counted once, as a hash of its content. By cost,
   a set is allocated its H + 1 segments that the fewest sets have (ties by
   hash); both sets of a linked pair then have one of these in common. Segments
   of one set alone come first and meet nothing, so most sets are done here.
2. Groups of sets with an allocated segment in common are joined as stars
   around the set of which most segments are dear, as an original's among its
   edited copies are; links become components, which settles large groups of
   near copies at the cost of one pair a member.
3. What is left are sets in groups that still hold several components: those
   around passages that many documents share. They are cut again, into
   neighbourhoods of one member: of the |r| - ceil(3|r| / 4) + 1 members that
   the fewest of these sets have, a linked pair has one in common. Sets that
   share one are paired if, from that member on, both have enough members left
   that others share, 3/7 of the sizes' sum: around a dear member that holds
   for sets that are common text for the most part, and hardly else.

Before two sets are compared, bitmaps of their members bound the difference
from below: every bit that differs stands for a member that differs. What
passes is counted exactly. Only connectivity is asked for, so pairs within a
component are never compared, and no link between components is lost.

Equal sets are one node (a 64-bit fingerprint of the set and its size), so a
large group of copies costs one row a task. A signature that one task sees more
than ``POPULAR`` times is dealt out by set instead of by signature.

Cases: documents without words or text have no set and are their own class;
documents with fewer than ``n`` words have one run; a very long text is hashed
in pieces and its set is one row; a null doc_id counts as no candidate for a
class's smallest; repeated rows are equal sets; an empty table gives no rows;
extra columns pass through unless they carry a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import drop_staged, few, keyed, python_ready, slices, stage
from nomenclia.llm.components import components
from nomenclia.llm.windows import mixed, run_hashes, word_hashes

N = 5
#: Sets with one signature beyond which it is dear.
POPULAR = 32
#: Signatures that a task gathers before it deals them out.
GATHER = 400_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BAND_MASK = 63


def shingle_sets(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts, each ascending, end to end, and their sizes."""
    hashes, lengths = word_hashes([(t or "").encode().translate(LOWER) for t in texts])
    runs, sets, at = run_hashes(hashes, n), [np.zeros(0, np.uint64)], 0
    for k in lengths.tolist():
        if k >= n:
            ordered = np.sort(runs[at : at + k - n + 1])
            new = np.ones(len(ordered), bool)
            np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
            sets.append(ordered[new])
        else:
            sets.append(mixed(run_hashes(hashes[at : at + k], k) + np.uint64(k)) if k else sets[0])
        at += k
    return np.concatenate(sets), np.array([len(s) for s in sets[1:]], np.int64)


def fingerprints(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(members) + 1, np.uint64)
    np.cumsum(mixed(members + np.uint64(0x51ED270B)), out=sums[1:])
    ends = np.cumsum(sizes)
    return mixed((sums[ends] - sums[ends - sizes]) ^ mixed(sizes.astype(np.uint64))).view(np.int64)


def bands(sizes: np.ndarray) -> np.ndarray:
    """The band of each size, which is at least 1."""
    return np.frexp(sizes.astype(float))[1] - 1


def segments(band: np.ndarray) -> np.ndarray:
    """Segments of a band: half its largest size and 16 more, 64 at least."""
    return np.maximum(64, (1 << band) + 16)


def differ(sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """In how many members a set of the size can differ from a partner, in its own band (the partner at most 4/3 as large) or the one below (in it)."""
    partner = np.where(bands(sizes) == band, 4 * sizes // 3, (2 << band) - 1)
    return (sizes + partner) // 7


def band_rows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set number, band) for every band that a set serves."""
    some = np.nonzero(sizes > 0)[0]
    own = bands(sizes[some])
    below = (3 * sizes[some] < (4 << own)) & (own > 0)
    return np.concatenate([some, some[below]]), np.concatenate([own, own[below] - 1])


def cut(members: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The segments of all sets in all their bands: ``set``, ``band``, ``sig``, and of each element its segment and hash."""
    which, band = band_rows(sizes)
    starts = np.cumsum(sizes) - sizes
    count = sizes[which]
    row = np.repeat(np.arange(len(which)), count)
    place = starts[which][row] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    h = members[place]
    seg = ((h >> np.uint64(32)) * segments(band).astype(np.uint64)[row]) >> np.uint64(32)  # ascending with the members
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])
    heads = np.nonzero(new)[0]
    mark = mixed(h ^ np.uint64(0xA5A5A5A5))
    sums = np.add.reduceat(mark, heads) if len(heads) else np.zeros(0, np.uint64)
    tag = mixed((seg[heads] << np.uint64(8)) | band[row[heads]].astype(np.uint64))
    return {"set": which[row[heads]], "band": band[row[heads]], "tag": tag, "sum": sums, "of": np.cumsum(new) - 1, "mark": mark}


def signature(tag: np.ndarray, sums: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Segment and content in one number, the band in its low bits."""
    return ((mixed(tag + mixed(sums)) & ~np.uint64(BAND_MASK)) | band.astype(np.uint64)).view(np.int64)


def bitmaps(members: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set the bits that its members hash to, four to eight a member, 256 at least."""
    out, at = [], 0
    for k, band in zip(sizes.tolist(), bands(np.maximum(1, sizes)).tolist(), strict=True):
        bits = np.zeros(max(256, 8 << band), bool)
        bits[members[at : at + k] & np.uint64(len(bits) - 1)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
        at += k
    return out


def least_difference(x: bytes, y: bytes) -> int:
    """In how many members two sets differ at least, by their bitmaps; the larger one is folded."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _spare(members: np.ndarray, sizes: np.ndarray) -> list[list[dict]]:
    """By band, the set's non-empty segments, and how many they are beyond those that it is allocated."""
    c = cut(members, sizes)
    pairs, count = np.unique(c["set"] * 64 + c["band"], return_counts=True)
    which, band = pairs >> 6, pairs & 63
    out: list[list[dict]] = [[] for _ in sizes]
    for k, b, n, h in zip(which.tolist(), band.tolist(), count.tolist(), differ(sizes[which], band).tolist(), strict=True):
        out[k].append({"band": b, "full": n, "spare": n - 1 - h})
    return out


SPARE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("band", "full", "spare")]))
OWN = [("node", T.LongType()), ("n_shingles", T.LongType()), ("__spare", SPARE)]


def nodes(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with node (null for no set), n_shingles and ``__spare``."""
    keep = [c for c in docs.columns if c not in ("text", *dict(OWN))]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in OWN]])
    arrow = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            members, sizes = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), pa.array(fingerprints(members, sizes), mask=sizes == 0), pa.array(sizes), pa.array(_spare(members, sizes), arrow.field("__spare").type)], schema=arrow)

    return docs.mapInArrow(found, schema)


def _dealt(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(k, sig, node): by signature, but by set where the signature is dear within the task alone."""
    order = np.argsort(sig, kind="stable")
    ordered = sig[order]
    first = np.ones(len(sig), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    size = np.diff(np.flatnonzero(first), append=len(sig))
    # One row without a set tells the signature's reducer that it is dear.
    told = ordered[first][size > POPULAR]
    dear = np.zeros(len(sig), bool)
    dear[order] = np.repeat(size > POPULAR, size)
    k = np.where(dear, mixed(sig.view(np.uint64) ^ mixed(node.view(np.uint64))).view(np.int64), sig)
    none = np.ones(len(told), bool)
    return pa.RecordBatch.from_arrays([pa.array(np.append(k, told)), pa.array(np.append(sig, told), mask=np.append(~dear, ~none)), pa.array(np.append(node, told), mask=np.append(np.zeros(len(sig), bool), none))], ["k", "sig", "node"])


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(p[0]) for p in held) > GATHER:
            yield _dealt(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield _dealt(*map(np.concatenate, zip(*held, strict=True)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by k: (sig, node, df) of the signatures that two sets have or more; df is POPULAR + 1 for dear ones."""

    def close(k: np.ndarray, sig: np.ndarray, node: np.ndarray, has_sig: np.ndarray, has_node: np.ndarray) -> pa.RecordBatch:
        alone = has_sig & has_node  # dealt out by set: dear, whatever else is here
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        far = new & alone | alone & ~np.append(False, alone[:-1])
        far_sig, far_node = sig[far], node[far]
        size = np.diff(np.flatnonzero(new), append=len(k))
        use = np.repeat(size > 1, size) & ~alone
        k, node, has_node = k[use], node[use], has_node[use]
        order = np.lexsort((node, ~has_node, k))
        k, node, has_node = k[order], node[order], has_node[order]
        once = np.ones(len(k), bool)  # a set that several tasks have seen counts once
        once[1:] = (k[1:] != k[:-1]) | (node[1:] != node[:-1]) | (has_node[1:] != has_node[:-1])
        k, node, has_node = k[once], node[once], has_node[once]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        told = np.bincount(group, ~has_node) > 0 if len(k) else np.zeros(0, bool)
        df = np.bincount(group, has_node).astype(np.int64) if len(k) else np.zeros(0, np.int64)
        df[told | (df > POPULAR)] = POPULAR + 1
        use = has_node & (df > 1)[group] if len(k) else has_node
        df = df[group][use] if len(k) else df
        return pa.RecordBatch.from_arrays([pa.array(np.append(k[use], far_sig)), pa.array(np.append(node[use], far_node)), pa.array(np.append(df, np.full(len(far_sig), POPULAR + 1)).astype(np.int32))], ["sig", "node", "df"])

    left: tuple | None = None
    for batch in batches:
        cols = [batch.column(c) for c in ("k", "sig", "node")]
        now = (cols[0].to_numpy(), cols[1].fill_null(0).to_numpy(), cols[2].fill_null(0).to_numpy(), cols[1].is_valid().to_numpy(zero_copy_only=False), cols[2].is_valid().to_numpy(zero_copy_only=False))
        if left is not None:
            now = tuple(np.concatenate(x) for x in zip(left, now, strict=True))
        if not len(now[0]):
            continue
        end = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on
        left = tuple(x[end:] for x in now)
        if end:
            yield close(*(x[:end] for x in now))
    if left is not None and len(left[0]):
        yield close(*left)


def shared(rows: DataFrame) -> DataFrame:
    """(sig, node, df), a node once for each signature, from rows (k, sig, node); staged."""
    met = rows.repartition("k").sortWithinPartitions("k").mapInArrow(_groups, "sig long, node long, df int")
    return stage(met, "shared")


def segment_rows(docs: DataFrame) -> DataFrame:
    """(k, sig, node) of all non-empty segments of the sets of ``docs`` (text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            seen: set[int] = set()
            for batch in slices(batches):
                members, sizes = shingle_sets(batch.column("text").to_pylist())
                own = fingerprints(members, sizes)
                new = np.array([x not in seen and not seen.add(x) for x in own.tolist()], bool)
                members, sizes, own = members[np.repeat(new, sizes)], sizes[new], own[new]
                c = cut(members, sizes)
                yield signature(c["tag"], c["sum"], c["band"]), own[c["set"]]

        yield from _gathered(parts())

    return docs.select("text").mapInArrow(found, "k long, sig long, node long")


def allocated(info: DataFrame, segments: DataFrame) -> DataFrame:
    """(sig, node, core): of each set the segments that others have too and that are among its H + 1 rarest; staged. ``core`` is the share of its segments that are dear, then that others have."""
    spare = info.where("node is not null").groupBy("node").agg(F.first("__spare").alias("s")).select("node", F.inline("s"))
    own = Window.partitionBy("node", "band")
    count = F.count("*").over(own)
    core = F.struct((F.count_if(F.col("df") > POPULAR).over(own) / F.col("full")).alias("dear"), (count / F.col("full")).alias("known"))
    placed = segments.withColumn("band", F.expr(f"cast(sig & {BAND_MASK} as int)")).join(spare, ["node", "band"]).select("sig", "node", core.alias("core"), "spare", count.alias("all"), F.row_number().over(own.orderBy("df", "sig")).alias("place"))
    return stage(placed.where("place <= all - spare").select("sig", "node", "core"), "allocated")


def set_rows(texts: DataFrame) -> DataFrame:
    """(node, n, bitmap, members) of the distinct sets of ``texts`` (node, text), members as bytes; staged."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            new = [x not in seen and not seen.add(x) for x in batch.column("node").to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            members, sizes = shingle_sets(batch.column("text").to_pylist())
            ends = np.cumsum(sizes)
            sets = [members[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes), pa.array(bitmaps(members, sizes), pa.binary()), pa.array(sets, pa.binary())], ["node", "n", "bitmap", "members"])

    met = texts.select("node", "text").mapInArrow(found, "node long, n long, bitmap binary, members binary")
    return stage(met.dropDuplicates(["node"]), "sets")


def _checked(test, columns: tuple[str, str]):
    """A task body that keeps the pairs (a, b) whose two ``columns`` pass the test."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = pa.array([test(x.as_buffer(), y.as_buffer(), n) for x, y, n in zip(*(batch.column(c) for c in columns), batch.column("total").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return found


def _linked(x: pa.Buffer, y: pa.Buffer, total: int) -> bool:
    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= 75 * (total - same)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; staged."""

    def beside(pairs: DataFrame, column: str, x: str, y: str) -> DataFrame:
        for side, name in (("a", x), ("b", y)):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(name)), side)
        return pairs.where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").select("a", "b", x, y, (F.col("n_a") + F.col("n_b")).alias("total"))

    near = stage(beside(pairs, "bitmap", "x", "y").mapInArrow(_checked(lambda x, y, n: 7 * least_difference(x, y) <= n, ("x", "y")), "a long, b long"), "near")
    out = stage(beside(near, "members", "x", "y").mapInArrow(_checked(_linked, ("x", "y")), "a long, b long"), "links")
    drop_staged(near)
    return out


def star_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): of each group (sig, node, core) the set with the largest core, with the others."""
    first = F.max_by("node", F.struct("core", "node"))
    pivots = groups.groupBy("sig").agg(first.alias("p"), F.count("*").alias("all")).where("all > 1").select("sig", "p")
    return groups.join(pivots, "sig").where("node <> p").select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def several(groups: DataFrame) -> DataFrame:
    """The rows of ``groups`` (sig, label and more) whose group holds more than one label."""
    mixed_groups = groups.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("sig")
    return groups.join(mixed_groups, "sig")


def member_rows(sets: DataFrame) -> DataFrame:
    """(k, sig, node) with every member of the sets as a signature."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in slices(batches):
                each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("members")]
                sizes = np.array(list(map(len, each)), np.int64)
                yield np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(batch.column("node").to_numpy(), sizes)

        yield from _gathered(parts())

    return sets.select("node", "members").mapInArrow(found, "k long, sig long, node long")


def close_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) of ``sets`` in different components that can link, by the rarest members of each; staged."""
    members = shared(member_rows(sets))
    own = Window.partitionBy("node")
    sized = members.join(sets.select("node", "n"), "node")
    rank, count = F.row_number().over(own.orderBy("df", "sig")), F.count("*").over(own)
    placed = sized.select("sig", "node", "df", "n", (F.col("n") - count + rank).alias("place"), (count - rank + 1).alias("rest"))
    # From the first member in common on, both need 3/7 of the sizes' sum; so many are left to a set at this one.
    first = placed.where("place <= n - ceil(3 * n / 4) + 1 and 4 * rest >= 3 * n").withColumn("reach", F.expr("floor(7 * rest / 3) - n"))
    rows = first.join(labels, "node").select("sig", "node", "n", "reach", "label")
    # Of every group the component with the most sets; its sets are not matched with each other.
    sizes = rows.groupBy("sig", "label").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("sig").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("sig", "top")
    rows = stage(rows.join(tops, "sig"), "prefixes")
    fits = "x.label <> y.label and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n) and x.n <= y.reach and y.n <= x.reach"
    met = rows.where("label <> top").alias("x").join(rows.alias("y"), F.expr(f"x.sig = y.sig and (y.label = y.top or x.node < y.node) and {fits}"))
    out = stage(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    drop_staged(rows)
    drop_staged(members)
    return out


def named(groups: DataFrame, labels: DataFrame) -> DataFrame:
    return groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def resolve(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label): components of the links within groups (sig, node)."""
    links = verified(star_pairs(groups), sets)
    left = stage(several(named(groups, components(links))).select("node", "label").distinct(), "open")
    more = verified(close_pairs(sets.join(left.select("node"), "node"), left), sets)
    return components(links.unionByName(more))


TEXT_KEY = ["__k1", "__k2"]


def grouped(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_shingles and ``__label``, equal for linked documents and null without a set; staged.

    Texts are read three times and told apart by digests, never by their place.
    """
    python_ready(docs.sparkSession)
    info = stage(nodes(keyed(docs, "text")), "nodes")
    segments = shared(segment_rows(docs))
    groups = allocated(info, segments)
    drop_staged(segments)
    inside = groups.select("node").distinct()
    chosen = stage(info.join(inside, "node").select("node", *TEXT_KEY).groupBy("node").agg(F.min(F.struct(*TEXT_KEY)).alias("k")).select("node", "k.*"), "chosen")
    sets = set_rows(keyed(docs.select("text"), "text").join(few(chosen), TEXT_KEY))
    labels = resolve(groups, sets)
    drop_staged(sets)
    drop_staged(groups)
    own = [c for c in info.columns if c not in ("node", "__spare", *TEXT_KEY)]
    return stage(info.join(labels.withColumnRenamed("label", "__label"), "node", "left").select(*own, F.coalesce("__label", "node").alias("__label")), "labelled")


def classes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without text, with n_shingles and component_id."""
    rows = grouped(docs.drop("n_shingles", "component_id").withColumnRenamed("node", "__node"))
    least = stage(rows.where("__label is not null").groupBy("__label").agg(F.min("doc_id").alias("__least")), "least")
    out = rows.join(least, "__label", "left")
    return out.select(*[F.col(c).alias(c.removeprefix("__")) if c == "__node" else c for c in rows.columns if c not in ("n_shingles", "__label")], "n_shingles", F.coalesce("__least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; rows without a set all stay."""
    key = ["__d1", "__d2"]
    digested = lambda d: keyed(d, "doc_id", "text").withColumnsRenamed(dict(zip(TEXT_KEY, key, strict=True)))
    rows = grouped(digested(docs.select("doc_id", "text")))
    each = rows.where("__label is not null").groupBy("__label", *key).agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *key)
    first = each.groupBy("__label").agg(F.min(order).alias("first"), F.sum("copies").alias("all")).where("all > 1")
    # Rows that leave; of rows equal in doc_id and text one stays, and those are told apart by nothing else.
    judged = each.join(first, "__label").select(*key, "copies", (order == F.col("first")).alias("wins"))
    judged = stage(judged.where("copies > 1 or not wins"), "judged")
    source = digested(docs)
    out = source.join(few(judged.select(*key)), key, "left_anti")
    repeated = judged.where("wins").select(*key)
    if not repeated.isEmpty():
        out = out.unionByName(source.join(few(repeated), key).dropDuplicates(key))
    return out.select(*docs.columns)
