"""Near-duplicate classes from SetSketch registers.

A text's set is its distinct word shingles. Each of m registers holds the
minimum of one hash of the set, truncated to an exponentially spaced grid:
K = clip(floor(1 - log_b(h)), 0, q + 1) with h exponential at rate a. Registers
of a union are the maxima of the registers, and equal registers become likelier
as sets grow alike. Bands of registers propose pairs; the Jaccard similarity is
estimated jointly by maximum likelihood from the counts of larger, smaller and
equal registers; what is left is verified on the full sets.

Texts with the same set form one class by fingerprint, and only one of them is
compared. Inside a bucket every member meets the bucket's leader. Classes that
still share a bucket after that compare the registers of their members there;
those that agree in enough of them form families, whose sets are compared in
blocks. Blocks give links and not pairs, and members of one class do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import written_table
from . import bits
from . import words as W

Q = 32_000


@dataclass(frozen=True)
class NearSettings:
    """``width`` words a shingle, ``percent`` the least similarity.

    With registers that agree with probability of at least 0.8 on a linked
    pair, 32 bands of 4 miss it with probability (1 - 0.8**4)**32 = 5e-8.
    ``prune`` is the estimate below which a pair is not verified: at 0.8 the
    estimate has a standard deviation of 0.035, as has the share of equal
    registers, which is held against it inside a bucket. ``block`` and
    ``block_members`` bound the shingles and the members of a block of texts that
    are compared with each other, ``sketch_members`` the members of a block of
    registers. ``deal`` bucket rows or so go to a task's group.
    """

    width: int = 5
    percent: int = 80
    registers: int = 128
    bands: int = 32
    base: float = 1.02
    rate: float = 20.0
    prune: float = 0.58
    block: int = 200_000
    block_members: int = 500
    sketch_members: int = 2000
    deal: int = 8192


def registers(values: np.ndarray, first: np.ndarray, s: NearSettings) -> np.ndarray:
    """(groups, m) registers of non-empty groups of distinct 64-bit values."""
    draw = np.random.default_rng(7).integers(1, 1 << 63, (2, s.registers), dtype=np.uint64)
    out = np.empty((len(first) - 1, s.registers), np.int16)
    scale = 1.0 / np.log(s.base)
    for i in range(s.registers):
        v = (values ^ draw[0, i]) * (draw[1, i] | np.uint64(1))
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum.reduceat(v, first[:-1]).astype(np.float64)
        h = -np.log1p(-np.minimum((least + 0.5) / 2.0**64, 1 - 1e-16)) / s.rate
        out[:, i] = np.clip(np.floor(1 - np.log(h) * scale), 0, Q + 1)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float, grid: int = 100) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows with known set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, grid + 1)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = W.Words(*W.text_bytes(batch.column("text")))
    return W.distinct_sorted(*W.shingles(words, words.hashes(), width))


def _sketch(table: Iterator[pa.RecordBatch], s: NearSettings) -> Iterator[pa.RecordBatch]:
    rows = s.registers // s.bands
    for batch in W.batches(table):
        values, first = _sets(batch, s.width)
        n = np.diff(first)
        full = n > 0
        starts = np.concatenate([first[:-1][full], first[-1:]])
        regs = np.zeros((len(n), s.registers), np.int16)
        marks = np.zeros((len(n), 2), np.uint64)
        if full.any():
            regs[full] = registers(values, starts, s)
            for k, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
                marks[full, k] = np.add.reduceat(W.mix(values ^ np.uint64(salt)), starts[:-1])
        keys = np.zeros((len(n), s.bands), np.uint64)
        for j in range(rows):
            keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + regs[:, j::rows].astype(np.uint64) + np.uint64(1))
        keys = W.mix(keys + np.arange(s.bands, dtype=np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)),
            pa.array([r.tobytes() for r in regs], pa.binary()),
            W.list_column(keys.ravel(), np.arange(len(n) + 1) * s.bands, pa.int64()),
        ], ["doc_id", "n_shingles", "mark_a", "mark_b", "registers", "bands"])


def _set_rows(table: Iterator[pa.RecordBatch], width: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in table:
        keep = bits.inside(batch.column("doc_id").fill_null(0).to_numpy(), wanted)
        yield from _full_sets(batch.filter(pa.array(keep)), width)


def _full_sets(rows: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    for batch in W.batches([rows]):
        values, first = _sets(batch, width)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), W.list_column(values.view(np.int64), first, pa.int64())], ["doc_id", "items"]
        )


def _likely(table: Iterator[pa.RecordBatch], s: NearSettings) -> Iterator[pa.RecordBatch]:
    for batch in table:
        if batch.num_rows:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int16).reshape(batch.num_rows, s.registers)
                for c in ("registers_a", "registers_b")
            )
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = estimate(a, b, na, nb, s.base) >= s.prune
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets_of(ids: DataFrame, docs: DataFrame, s: NearSettings) -> DataFrame:
    """(doc_id, items) of these documents, and of a few more; the texts are not shuffled."""
    return docs.mapInArrow(partial(_set_rows, width=s.width, wanted=bits.table_of(ids)), "doc_id bigint, items array<bigint>")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, s: NearSettings) -> DataFrame:
    """Pairs (a, b) whose full sets have the least similarity."""

    def side(name: str) -> DataFrame:
        return sketches.select(
            F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"registers_{name}")
        )

    close = pairs.join(side("b"), "b").join(side("a"), "a")
    close = close.filter("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % s.percent)
    likely = written_table(close.mapInArrow(partial(_likely, s=s), "a bigint, b bigint").distinct())
    sets = _sets_of(likely.select(F.explode(F.array("a", "b"))), docs, s)
    both = likely.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a"
    )
    shared = both.withColumn("n", F.size(F.array_intersect("items_a", "items_b")))
    return shared.filter(f"100 * n >= {s.percent} * (size(items_a) + size(items_b) - n)").select("a", "b")


def _block_links(table: pa.Table, s: NearSettings) -> pa.Table:
    """Links between different classes inside a block pair, by exact intersections.

    Shingles that only one member has count in its size and nowhere else, so
    the product runs over the shared ones, a slice of columns at a time.
    """
    ids, classes = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
    items = table.column("items").combine_chunks()
    sizes = np.diff(items.offsets.to_numpy())
    _, column, often = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(ids)), sizes)
    seen, label = np.unique(classes, return_inverse=True)
    ask = np.flatnonzero(label != np.bincount(label).argmax())  # members of the largest class need no row of their own
    place = np.full(len(ids), -1)
    place[ask] = np.arange(len(ask))
    shared = often[column] > 1
    column, member = (np.cumsum(often > 1) - 1)[column[shared]], member[shared]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    both = np.zeros((len(ask), len(ids)), np.float32)
    width = 1024
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [at, at + width])
        full = np.zeros((len(ids), width), np.float32)
        full[member[i:j], column[i:j] - at] = 1
        both += full[ask] @ full.T
    union = sizes[ask][:, None] + sizes[None, :] - both
    x, y = np.nonzero((100 * both >= s.percent * union) & (label[ask][:, None] != label[None, :]))
    x = ask[x]
    _, first = np.unique(x * len(seen) + label[y], return_index=True)  # one link of a member with a class says it all
    x, y = x[first], y[first]
    return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])})


def _dealt(members: DataFrame, group: str, cost: Column, full: int) -> DataFrame:
    """(group, doc_id, component, own, lo, hi): a member's block and each pair of blocks in which it is compared.

    A block costs about ``full``. A class that fills one has blocks of its own,
    which meet the blocks of others and not each other; the other classes of
    the group share blocks, all pairs of which meet. Costs are whole numbers,
    so that a task that runs again deals alike.
    """

    def blocks(c: Column) -> Column:
        return F.floor((c + (full - 1)) / full)

    classes = members.groupBy(group, "component").agg(F.sum(cost).cast("bigint").alias("cost"))
    large = F.col("cost") >= full
    groups = classes.groupBy(group).agg(
        F.array_sort(F.collect_list(F.when(large, F.struct("component", blocks(F.col("cost")).alias("n"))))).alias("large"),
        blocks(F.coalesce(F.sum(F.when(~large, F.col("cost"))), F.lit(0))).alias("rest"),
    )
    before = F.expr("transform(large, (c, i) -> struct(c.component, rest + aggregate(slice(large, 1, i), 0L, (t, y) -> t + y.n) AS start, c.n AS n))")
    total = F.expr("rest + aggregate(large, 0L, (t, y) -> t + y.n)")
    placed = members.join(groups.select(group, "rest", total.alias("total"), before.alias("large")), group)
    placed = placed.withColumn("class", F.expr("get(filter(large, c -> c.component = component), 0)")).drop("large")
    own = F.expr("if(class IS NULL, pmod(xxhash64(doc_id), rest), class.start + pmod(xxhash64(doc_id), class.n))")
    other = F.expr("explode(filter(sequence(0L, total - 1), p -> class IS NULL OR p < class.start OR p >= class.start + class.n))")
    met = placed.withColumn("own", own).withColumn("other", other)
    return met.select(group, "doc_id", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected to by the pairs (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) number of equal registers."""
    out = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        out += x[:, None] == y
    return out


def _bucket_links(table: pa.Table, s: NearSettings) -> pa.Table:
    """Links (b, a) that connect the members of different classes whose registers agree, of some pairs of blocks of buckets.

    A pair of blocks gives fewer links than it has members, however many of
    its pairs agree.
    """
    table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("own", "ascending")])
    ids, node = np.unique(table.column("doc_id").to_numpy(), return_inverse=True)
    regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.int16).reshape(len(node), s.registers)
    label, sizes, own = (table.column(c).to_numpy() for c in ("component", "n_shingles", "own"))
    least = s.prune * s.registers
    marks = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
    cuts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, [len(node)]]).tolist()

    def likely(x: np.ndarray, y: np.ndarray, same: np.ndarray) -> np.ndarray:
        near_size = 100 * np.minimum(sizes[x], sizes[y]) >= s.percent * np.maximum(sizes[x], sizes[y])
        return (same >= least) & near_size & (label[x] != label[y])

    few, links = [], []
    for i, j in zip(cuts[:-1], cuts[1:]):
        if j - i <= 32:
            x, y = np.triu_indices(j - i, 1)
            few.append((x + i, y + i))
            continue
        rows = np.arange(i, j)
        if own[i] == own[j - 1]:  # members of the largest class need no row of their own
            seen, at = np.unique(label[i:j], return_inverse=True)
            ask = rows[at != np.bincount(at).argmax()]
        else:
            ask, rows = rows[own[i:j] == own[i]], rows[own[i:j] != own[i]]
        step = max(1, (2 << 20) // len(rows))
        for k in range(0, len(ask), step):
            part = ask[k : k + step]
            same = _equal(regs[part], regs[rows])
            x, y = np.nonzero(same >= least)
            same, x, y = same[x, y], part[x], rows[y]
            keep = likely(x, y, same)
            x, y = x[keep] - i, y[keep] - i
            root = _forest(j - i, x, y)
            to = np.flatnonzero(root != np.arange(j - i))
            links.append((node[to + i], node[root[to] + i]))
    if few:
        x, y = (np.concatenate(z) for z in zip(*few))
        for k in range(0, len(x), 1 << 16):
            a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            keep = likely(a, b, np.count_nonzero(regs[a] == regs[b], axis=1))
            links.append((node[a[keep]], node[b[keep]]))
    x, y = (np.concatenate(z) for z in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    root = _forest(len(ids), x, y)
    to = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"b": ids[to], "a": ids[root[to]]})


def _families(rows: DataFrame, sketches: DataFrame, s: NearSettings) -> DataFrame:
    """(doc_id, family): members of different classes that share a bucket and agree in their registers, connected over such pairs."""
    dealt = _dealt(rows.select("key", "doc_id", "component").distinct(), "key", F.lit(1), s.sketch_members)
    full = dealt.join(sketches.select("doc_id", "n_shingles", "registers"), "doc_id")
    deal = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(1 + rows.count() // s.deal))

    def links(table: pa.Table) -> pa.Table:
        return _bucket_links(table, s)

    found = written_table(full.withColumn("deal", deal).groupBy("deal").applyInArrow(links, "b bigint, a bigint"))
    return _classes(found).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))


def _within_families(rows: DataFrame, sketches: DataFrame, docs: DataFrame, s: NearSettings) -> DataFrame:
    """Links (a, b) left between classes that still share a bucket.

    Sharing a bucket by chance connects nothing: a family is what agreeing
    registers connect. Its members are dealt into blocks of a bounded number of
    shingles, pairs of blocks that may hold links are compared once, and only
    links leave the task, so that a large family is neither gathered nor
    written out as pairs.
    """
    members = written_table(rows.select("doc_id", "component").distinct().join(_families(rows, sketches, s), "doc_id"))
    sized = members.join(sketches.select("doc_id", "n_shingles"), "doc_id")
    cost = F.greatest(F.col("n_shingles") * s.block_members, F.lit(s.block))
    dealt = _dealt(sized, "family", cost, s.block * s.block_members).drop("own")
    pairs = dealt.join(_sets_of(members.select("doc_id"), docs, s), "doc_id")

    def links(table: pa.Table) -> pa.Table:
        return _block_links(table, s)

    return pairs.groupBy("family", "lo", "hi").applyInArrow(links, "a bigint, b bigint").distinct()


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Bucket rows with the class of each member, for the buckets whose members are in several classes."""
    named = rows.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return named.join(mixed, "key")


def near_classes(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id bigint, text).

    component_id is the smallest doc_id reachable over links. A null, empty or
    blank text has no shingles and no links. Rows with the same doc_id are one
    node: it is linked to what any of its texts is linked to, and every row of
    it is returned. A null doc_id is never linked: component_id is null and the
    row is kept. An empty table gives no rows.
    """
    s = settings
    docs = docs.select("doc_id", "text")
    kinds = "doc_id bigint, n_shingles bigint, mark_a bigint, mark_b bigint, registers binary, bands array<bigint>"
    sketches = written_table(docs.mapInArrow(partial(_sketch, s=s), kinds))
    known = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    mark = ["mark_a", "mark_b", "n_shingles"]
    copies = known.groupBy(*mark).agg(F.min("doc_id").alias("first_id"))
    firsts = known.join(copies.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "leftsemi")
    keys = firsts.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    buckets = written_table(keys.join(shared, "key"))

    links = known.join(copies, mark).select(F.col("doc_id").alias("node"), F.col("first_id").alias("hub")).distinct()
    links = written_table(links.filter("node <> hub"))
    found = links.select(F.col("node").alias("b"), F.col("hub").alias("a"))
    order = F.struct(F.xxhash64("doc_id").alias("rank"), F.col("doc_id").alias("doc_id"))
    leads = buckets.groupBy("key").agg(F.min(order).alias("lead"))
    meet = buckets.join(leads, "key").filter("lead.doc_id <> doc_id")
    pairs = meet.select(F.least("lead.doc_id", "doc_id").alias("a"), F.greatest("lead.doc_id", "doc_id").alias("b")).distinct()
    found = found.unionByName(written_table(_verified(pairs, firsts, docs, s)).select("b", "a"))
    classes = _classes(found)
    rows = written_table(_labelled(buckets, classes))
    rest = written_table(_within_families(rows, firsts, docs, s)).select("b", "a")
    if not rest.isEmpty():
        settled = classes.filter("node <> component").select(F.col("node").alias("b"), F.col("component").alias("a"))
        classes = _classes(settled.unionByName(rest))
    named = sketches.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _classes(found: DataFrame) -> DataFrame:
    """(node, component) over links (b, a)."""
    ends = found.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("hub")), F.struct(F.col("a").alias("node"), F.col("a").alias("hub")))).alias("x"))
    return written_table(connected_components(ends.select("x.*").distinct(), "node", "hub"))
