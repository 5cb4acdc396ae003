"""Tokens of one text under two tokenizers, aligned by their bytes.

Both token sequences spell the same bytes. The byte offsets at which tokens of
both end are the intersection of two hash sets, the keys of dictionaries from
end to index; in ascending order they cut both sequences into groups, and the
pairs of tokens whose byte ranges overlap are listed inside each group.

A text is cut before a space between two characters that are not white space.
Neither tokenizer makes a token over such a border: byte-level pieces have white
space at their beginning only, and no piece of the other vocabulary has its
space mark behind another character, which is tested when it is loaded. A
distinct piece of text is therefore encoded and aligned once in a worker, and a
document gathers the groups and links of its pieces. Other tokenizers get whole texts.

Links of a document are kept as distinct id pairs with their number. How many
documents hold a pair is summed over all documents in Spark; up to ``pairs``
distinct pairs are broadcast for the lookup, more are joined.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from . import words as W

MARK = "▁"


@dataclass(frozen=True)
class AlignSettings:
    """Vocabulary files, pieces of text a worker remembers, bytes of a segment, and id pairs that are broadcast at most."""

    byte_level: str = "byte_bpe_50k.json"
    pieces: str = "piece_bpe_32k.model"
    known: int = 600_000
    segment: int = 1 << 20
    pairs: int = 3_000_000


def align(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(groups, links): where the groups end in both id lists, and the index pairs whose bytes overlap."""
    end_a, end_b = list(accumulate([size_a[i] for i in a])), list(accumulate([size_b[i] for i in b]))
    index_a, index_b = dict(zip(end_a, range(1, len(a) + 1))), dict(zip(end_b, range(1, len(b) + 1)))
    groups, links = [], []
    i = j = start = 0
    for end in sorted(index_a.keys() & index_b.keys()):
        p, q = index_a[end], index_b[end]
        groups.append((p, q))
        if p - i == 1 == q - j and end > start:
            links.append((i, j))
        else:
            links += _overlaps(end_a, end_b, i, p, j, q)
        i, j, start = p, q, end
    return groups, links


def _overlaps(end_a: list[int], end_b: list[int], i: int, p: int, j: int, q: int) -> Iterator[tuple[int, int]]:
    """Overlapping pairs of the tokens i to p and j to q; a token without bytes overlaps nothing."""
    while i < p and j < q:
        if end_a[i] > (end_a[i - 1] if i else 0) and end_b[j] > (end_b[j - 1] if j else 0):
            yield i, j
        i, j = i + (end_a[i] <= end_b[j]), j + (end_b[j] <= end_a[i])


class Aligner:
    """Both tokenizers, and the alignments of the pieces of text seen so far."""

    def __init__(self, s: AlignSettings):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.settings = s
        self.a = Tokenizer.from_file(public_tokenizers.path(s.byte_level))
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(s.pieces))
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [x for x in range(256) if x not in printable]
        byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(True))]
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.names = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        made = json.loads(self.a.to_str())
        regular = made["normalizer"] is None and made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuts = regular and not any(MARK in p.lstrip(MARK) for p in pieces)
        # bytes beside a space that may belong to white space: ASCII, and the ends and beginnings of longer ones
        self.before, self.after = np.ones(256, bool), np.ones(256, bool)
        self.before[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
        self.after[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = False
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.good, self.texts = bytearray(), []
        self.counts = array("q")  # n_a, n_b, n_groups, n_links of each piece
        self.first, self.links_a, self.links_b = array("q", [0]), array("i"), array("i")

    def borders(self, data: np.ndarray) -> np.ndarray:
        """Whether a text may be cut before each byte."""
        out = np.zeros(len(data), bool)
        if self.cuts and len(data) > 2:
            out[1:-1] = (data[1:-1] == 0x20) & self.before[data[:-2]] & self.after[data[2:]]
        return out

    def segments(self, raw: bytes) -> Iterator[bytes]:
        """A long text in parts of about ``segment`` bytes, cut where it may be."""
        at, size = 0, self.settings.segment
        while at < len(raw):
            stop, step = at + size, 4096
            while stop < len(raw):
                near = np.flatnonzero(self.borders(np.frombuffer(raw, np.uint8, min(len(raw), stop + step) - stop, stop)))
                if len(near):
                    stop += int(near[0])
                    break
                stop, step = stop + step - 2, min(step * 2, size)
            stop = min(stop, len(raw))
            yield raw[at:stop]
            at = stop

    def learn(self, new: list[bytes]) -> None:
        """Encode and align pieces of text; each begins with a space, which the second tokenizer adds itself."""
        bytes_a, bytes_b, size_a, size_b = self.bytes_a, self.bytes_b, self.size_a, self.size_b
        known = len(self.index)
        self.index.update(zip(new, range(known, known + len(new))))
        self.held += sum(map(len, new))
        for k in range(0, len(new), 2000):  # encodings are large objects
            some = new[k : k + 2000]
            texts = [x.decode() for x in some]
            ids_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
            links_a, links_b, first, counts = [], [], [], []
            at = len(self.links_a)
            for raw, a, b in zip(some, ids_a, ids_b):
                good = b"".join([bytes_a[x] for x in a]) == raw == b"".join([bytes_b[x] for x in b])
                self.good.append(good)
                if good:
                    groups, links = align(a, b, size_a, size_b)
                    for i, j in links:
                        links_a.append(a[i])
                        links_b.append(b[j])
                    self.texts.append(self.written(a, b, groups))
                    counts += (len(a), len(b), len(groups), len(links))
                else:
                    self.texts.append(b"")
                    counts += (0, 0, 0, 0)
                first.append(at + len(links_a))
            self.counts.extend(counts)
            self.links_a.extend(links_a)
            self.links_b.extend(links_b)
            self.first.extend(first)

    def written(self, a: list[int], b: list[int], groups: list[tuple[int, int]]) -> bytes:
        """Groups as ids: ``a1,a2|b1;a3|b2,b3``."""
        name, out = self.names, []
        i = j = 0
        for p, q in groups:
            if p - i == 1 == q - j:
                out.append(f"{name[a[i]]}|{name[b[j]]}")
            else:
                out.append(",".join([name[x] for x in a[i:p]]) + "|" + ",".join([name[x] for x in b[j:q]]))
            i, j = p, q
        return ";".join(out).encode()

    def measure(self, parts: list[bytes]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """(bytes agree, counts, distinct links a << 32 | b, their numbers, group texts) of each part; parts begin with a space."""
        if len(self.index) > self.settings.known or self.held > 64 << 20:
            self._forget()
        whole = b"".join(parts)
        ends = np.cumsum([len(x) for x in parts])
        cut = self.borders(np.frombuffer(whole, np.uint8))
        cut[np.concatenate([[0], ends[:-1]])] = True
        at = np.flatnonzero(cut).tolist()
        pieces = [whole[i:j] for i, j in zip(at, [*at[1:], len(whole)])]
        new = [x for x in dict.fromkeys(pieces) if x not in self.index]
        if new:
            self.learn(new)
        where = list(map(self.index.__getitem__, pieces))
        index = np.array(where)
        first = np.concatenate([[0], np.searchsorted(at, ends)])
        good = np.frombuffer(self.good, np.bool_)[index]
        counts = np.frombuffer(self.counts, np.int64).reshape(-1, 4)[index]
        before = np.frombuffer(self.first, np.int64)
        start, size = before[index], counts[:, 3]
        ends = np.cumsum(size)
        place = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
        links = np.frombuffer(self.links_a, np.int32)[place].astype(np.int64) << 32 | np.frombuffer(self.links_b, np.int32)[place] if len(place) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], ends])
        del before
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            yield bool(good[i:j].all()), counts[i:j].sum(axis=0), *np.unique(links[ends[i] : ends[j]], return_counts=True), list(map(self.texts.__getitem__, where[i:j]))


_ALIGNERS: dict[AlignSettings, Aligner] = {}


class _Digest:
    """Group texts of a document, as a digest and if wanted as they are."""

    def __init__(self, keep: bool):
        self.hash, self.any, self.kept = sha256(), False, [] if keep else None

    def add(self, texts: list[bytes]) -> None:
        text = b";".join(texts)
        self.hash.update(b";" + text if self.any else text)
        self.any = True
        if self.kept is not None:
            self.kept.append(text)


def _documents(batch: pa.RecordBatch, aligner: Aligner, keep: bool) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, digest, groups, links, times) of each text."""
    texts = [b" " + (x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
    none = (0, 0, 0, 0, "", "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(texts) == 1 and len(texts[0]) > 2 * aligner.settings.segment:
        good, counts, links, digest = True, np.zeros(4, np.int64), [], _Digest(keep)
        for part in aligner.segments(texts[0]):
            for ok, n, pair, times, groups in aligner.measure([part]):
                good = good and ok
                counts += n
                links.append((pair, times))
                digest.add(groups)
            if len(links) > 16:
                links = [_summed(links)]
        pair, times = _summed(links)
        yield (*counts.tolist(), digest.hash.hexdigest(), b";".join(digest.kept or []), pair, times) if good else none
        return
    full = [i for i, x in enumerate(texts) if len(x) > 1]
    measured = iter(aligner.measure([texts[i] for i in full]) if full else ())
    for x in texts:
        if len(x) == 1:
            yield none
            continue
        ok, counts, pair, times, groups = next(measured)
        if not ok:
            yield none
            continue
        digest = _Digest(keep)
        digest.add(groups)
        yield *counts.tolist(), digest.hash.hexdigest(), b";".join(digest.kept or []), pair, times


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, link_a array<int>, link_b array<int>, link_times array<int>"


def _aligned(table: Iterator[pa.RecordBatch], s: AlignSettings, keep: bool) -> Iterator[pa.RecordBatch]:
    aligner = _ALIGNERS.setdefault(s, None) or Aligner(s)
    _ALIGNERS[s] = aligner
    for batch in W.batches(table, limit=s.segment):
        n_a, n_b, n_groups, n_links, digest, groups, pairs, times = zip(*_documents(batch, aligner, keep))
        first = np.concatenate([[0], np.cumsum([len(x) for x in pairs])])
        pairs, times = np.concatenate(pairs), np.concatenate(times)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_extra"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(digest, pa.string())]
            + [pa.array(groups, pa.binary()).cast(pa.string()) if keep else pa.nulls(batch.num_rows, pa.string())]
            + [W.list_column(x.astype(np.int32), first, pa.int32()) for x in (pairs >> 32, pairs & 0xFFFFFFFF, times)],
            ["doc_id", "_extra", *(c.split()[0] for c in ALIGNED.split(", "))],
        )


def _pair_counts(table: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(a, b, documents) of the documents of a task, summed while few enough."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array(keys.astype(np.int32)), pa.array(n)], ["a", "b", "documents"])

    rows = 0
    for batch in table:
        keys = batch.column("link_a").flatten().to_numpy().astype(np.int64) << 32 | batch.column("link_b").flatten().to_numpy()
        held.append(np.unique(keys, return_counts=True))
        rows += len(held[-1][0])
        if rows > limit:
            held = [_summed(held)]
            rows = len(held[0][0])
            if rows > limit // 2:
                yield made(*held[0])
                held, rows = [], 0
    if held:
        yield made(*_summed(held))


def _looked_up(table: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum in place of the links; ``known`` has keys in order, their documents and whether they are best."""
    keys, documents, best = known.value
    for batch in table:
        lists = batch.column("link_a")
        key = lists.flatten().to_numpy().astype(np.int64) << 32 | batch.column("link_b").flatten().to_numpy()
        times = batch.column("link_times").flatten().to_numpy().astype(np.int64)
        at = np.searchsorted(keys, key)
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        sums = []
        for value in (times * best[at] if len(key) else times, times * documents[at] if len(key) else times):
            before = np.concatenate([[0], np.cumsum(value)])
            sums.append(pa.array(before[ends[1:]] - before[ends[:-1]], pa.int64()))
        others = [c for c in batch.schema.names if not c.startswith("link_")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *sums], [*others, "n_best", "count_sum"])


def pair_documents(aligned: DataFrame) -> DataFrame:
    """a, b, documents that hold the pair linked, and whether that is the highest number for a."""
    counts = aligned.select("link_a", "link_b").mapInArrow(_pair_counts, "a int, b int, documents bigint")
    counts = written_table(counts.groupBy("a", "b").agg(F.sum("documents").alias("documents")))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return written_table(counts.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best")))


def with_counts(aligned: DataFrame, settings: AlignSettings = AlignSettings()) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of its links."""
    spark, counts = aligned.sparkSession, pair_documents(aligned)
    documents = aligned.drop("link_a", "link_b", "link_times")
    if counts.count() <= settings.pairs:
        found = counts.select((F.shiftleft(F.col("a").cast("bigint"), 32) + F.col("b")).alias("key"), "documents", "best").sort("key").toArrow()
        known = spark.sparkContext.broadcast((found["key"].to_numpy(), found["documents"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema)
        return aligned.mapInArrow(partial(_looked_up, known=known), f"{kinds}, n_best bigint, count_sum bigint").drop("row")
    links = aligned.select("row", F.explode(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_times").alias("times"))).alias("l")).select("row", "l.*")
    sums = links.join(counts, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum")
    )
    out, zero = documents.join(sums, "row", "left"), F.lit(0).cast("bigint")
    return out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("n_best", "count_sum")}).drop("row")


def align_documents(docs: DataFrame, settings: AlignSettings = AlignSettings(), groups: bool = False) -> DataFrame:
    """Columns of ``docs`` but text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum; ``groups`` adds the groups as a string.

    The first tokenizer gets a space and the text, the second the text, to which
    it adds one; strings of special tokens are plain text. A group is written
    ``a1,a2|b1`` by ids, groups are joined by ``;``. n_best counts the links
    whose id pair is linked in the highest number of documents for its first id,
    ties included; count_sum adds that number over all links. A text that is
    null, empty, or not spelled by the tokens of both has no tokens: zeros and
    an empty digest. Each row is a document of its own, repeated rows and null
    ids included; further columns pass through, but for those named like a
    result. An empty table gives no rows.
    """
    made = {c.split()[0] for c in ALIGNED.split(", ")} | {"n_best", "count_sum"}
    extra = [c for c in docs.columns if c not in ("doc_id", "text") and c not in made]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra))).alias("_extra"))
    kinds = rows.select("_extra").schema[0].dataType.simpleString()
    aligned = rows.mapInArrow(partial(_aligned, s=settings, keep=groups), f"doc_id bigint, _extra {kinds}, {ALIGNED}")
    # written once: the row numbers stay, and encoding is not repeated for the second look
    out = with_counts(written_table(aligned.withColumn("row", F.monotonically_increasing_id())), settings)
    results = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    return out.select("doc_id", *(F.col("_extra")[f"c{i}"].alias(c) for i, c in enumerate(extra)), *results)
