"""Near copies by true Jaccard similarity of word shingles, found by SimHash and, beyond its radius, by MinHash bands.

Two texts link when their sets of five-word shingles have a Jaccard similarity of ``SHARE`` or more.
Texts of equal sets are one node.  First come the links of ``simhash``: nodes whose fingerprints over the same
shingles differ in at most ``RADIUS`` bits, by the generalised pigeonhole principle.  That radius reaches
similarities of some 0.95 only, so the rest is found by bands.  Nodes that agree in all ``ROWS`` minima of one of ``BANDS`` bands are
candidates: at 0.8 a pair shares no band with probability (1 - 0.8^4)^24, about 3 in a million.  Every
link is verified on the whole sets.

Candidates are tried in three rounds.  First come the pairs of near fingerprints, with each node against three of its
bands' centres, then each node is tried against the node of another component that agrees with it in most minima, band by band; both are linear and
join nearly all of a dense group.  Last, all pairs of a band's nodes that are still in different components
are compared on their whole sets inside a task, unless their 96 minima agree in so few places (under 53)
that a pair at 0.8 does so with a chance below one in a million.  A pair is compared in the first band it
shares only, pairs are never written out, and only nodes that have such a pair bring their sets.  Crowded
bands are cut into blocks by rows and bytes, and pairs of blocks are compared apart.

Defined cases: null and empty texts have no shingles and are equal; texts of fewer words than a shingle
are one shingle; repeated rows, and rows of one id with different texts, are rows like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, HashMemo, ascii_words, materialise, skew_safe_semi, sliced
from .simhash import BLOCK, _lookup, components, fingerprint, first_rows, links

WIDTH, SHARE = 5, 0.8
#: Differing bits of fingerprints that link.
RADIUS = 4
BANDS, ROWS = 24, 4
#: Minima that agree at least, for a pair to be verified.
AGREE = 53
#: Bytes of sets in a block.
BYTES = 16 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(5).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingles(text: str | None, memo: HashMemo, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    code = memo.array(ascii_words(text))
    if not len(code):
        return code
    width = min(width, len(code))
    out = np.full(len(code) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ code[i : len(code) - width + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions, odd_i * low + high modulo 2^32."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low, high = h.astype(np.uint32)[:, None], (h >> np.uint64(32)).astype(np.uint32)[:, None]
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):
            v = low[at : at + 4096] * _ODD
            v += high[at : at + 4096]
            np.minimum(least, v.min(0), out=least)
    return least


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, node, sketch, keys, fp) of each row: its set, its minima, its bands, its fingerprint."""

    def run(batches):
        memo = HashMemo()
        for big in batches:
            for b in sliced(big):
                node, sketch, keys, fp = [], [], [], []
                for text in b.column(2).to_pylist():
                    h = shingles(text, memo)
                    low = minima(h)
                    node.append(xxhash.xxh64_intdigest(h.tobytes()))
                    fp.append(fingerprint(text, WIDTH))
                    sketch.append(low.tobytes())
                    keys.append([xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)])
                signed = np.array(keys, np.uint64).reshape(-1, BANDS).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sketch, pa.binary()), pa.array(list(signed), pa.list_(pa.int64())), pa.array(fp, pa.int64())],
                    ["doc_id", "row_hash", "node", "sketch", "keys", "fp"],
                )

    d = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, row_hash long, node long, sketch binary, keys array<long>, fp long")


def _near_prints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes that connect just what fingerprints of at most ``radius`` differing bits connect."""
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    same = _lookup(nodes.select("node", "fp"), first, "fp", "n", "first", nodes.count()).where("node <> first")
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    near = links(first, radius).join(a, "a").join(b, "b")
    return same.select(F.col("first").alias("a"), F.col("node").alias("b")).union(near.select("first_a", "first_b"))


def _known(docs: DataFrame, marks: DataFrame, live: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sketch, set) of the nodes in ``live``, from one of their texts each; all rounds read this table.

    Texts that many rows repeat and that no node here needs, HEAVY at most, stay out of the shuffle.
    """
    wanted = live.select("node").distinct().join(nodes.select("node", "row_hash", "copies", "sketch"), "node")
    wanted = materialise(wanted, "wanted")
    total = docs.count()
    often = marks.groupBy("row_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, total // HEAVY))
    idle = often.select("row_hash").join(wanted.select("row_hash"), "row_hash", "left_anti")
    texts = docs.select(F.xxhash64("text").alias("row_hash"), "text").join(F.broadcast(idle), "row_hash", "left_anti")
    texts = skew_safe_semi(texts, wanted.select("row_hash", "copies"), ["row_hash"], "copies", total)

    def sets(batches):
        memo = HashMemo()
        for big in batches:
            for b in sliced(big):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, memo).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["row_hash", "set"])

    one = texts.dropDuplicates(["row_hash"]).mapInArrow(sets, "row_hash long, set binary")
    return materialise(wanted.join(one, "row_hash").select("node", "sketch", "set"), "shingle-sets")


def _matched(rows: DataFrame, table: DataFrame, key: str, weight: str, value: str, total: int) -> DataFrame:
    """``rows`` whose key is in ``table``, with its ``value``.

    The keys that meet many rows are at most HEAVY in number; they are told apart as literals, in one parsed text, so only
    their own rows meet the broadcast and only the others are shuffled.
    """
    limit = max(1, total // HEAVY)
    many = table.where(F.col(weight) > limit)
    keys = [r[0] for r in many.select(key).collect()]
    hot = F.expr(f"{key} in ({', '.join(f'{k}L' for k in keys)})") if keys else F.lit(False)
    cold = rows.where(~hot) if keys else rows
    cold = cold.join(table.where(F.col(weight) <= limit).select(key, value).hint("merge"), key)
    return cold.unionByName(rows.where(hot).join(F.broadcast(many.select(key, value)), key)) if keys else cold


def _verified(known: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose shingle sets are at least ``share`` alike."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    used = materialise(known.select("node", "set").join(ends, "node"), "used-sets")
    left = used.select(F.col("node").alias("a"), "uses", F.col("set").alias("set_a"))
    right = used.select(F.col("node").alias("b"), "uses", F.col("set").alias("set_b"))
    n = pairs.count()
    both = _matched(_matched(pairs, left, "a", "uses", "set_a", n), right, "b", "uses", "set_b", n)

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= share * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"), "verified")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Run:
    """The rows of a band, or of two of its blocks: side 2 is a block with itself, else 0 meets 1."""

    def __init__(self, rows: list[tuple]):
        self.side, self.node, self.label, self.band = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        self.sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), -1)
        self.sets = [np.frombuffer(r[5], np.uint64) for r in rows] if rows[0][5] is not None else []

    def near(self):
        """(row, rows of other components that agree with it enough, in how many minima)."""
        own = self.side[0] == 2
        for i in range(len(self.node)) if own else np.flatnonzero(self.side == 0).tolist():
            other = np.flatnonzero(self.label[i + 1 :] != self.label[i]) + i + 1 if own else np.flatnonzero((self.side == 1) & (self.label != self.label[i]))
            if len(other):
                same = self.sketch[other] == self.sketch[i]
                agree = same.sum(1)
                some = agree >= AGREE
                if some.any():
                    yield i, other[some], agree[some], same[some]

    def best(self) -> list[tuple[int, int]]:
        """For each row the one that agrees with it most."""
        top: dict[int, tuple[int, int]] = {}
        for i, other, agree, _ in self.near():
            for j, n in ((i, (int(agree.max()), int(other[agree.argmax()]))), *((int(j), (int(n), i)) for j, n in zip(other, agree, strict=True))):
                if n > top.get(j, (0, 0)):
                    top[j] = n
        return [(int(self.node[i]), int(self.node[j])) for i, (_, j) in top.items()]

    def open(self) -> list[tuple[int, int]]:
        """Rows that have such a pair in this band first."""
        out: set[int] = set()
        for i, other, _, same in self.near():
            first = self._first(same) == self.band[i]
            if first.any():
                out.update([i, *other[first].tolist()])
        return [(int(self.node[i]), 0) for i in out]

    def links(self, share: float) -> list[tuple[int, int]]:
        """Pairs that are alike, as far as they join different components."""
        out = []
        for i, other, _, same in self.near():
            other = other[self._first(same) == self.band[i]]
            if not len(other):
                continue
            x, ys = self.sets[i], [self.sets[j] for j in other.tolist()]
            size = np.array([len(y) for y in ys])
            flat = np.concatenate(ys)
            hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat if len(x) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(size)])]
            common = np.diff(ends)
            alike = common >= share * (len(x) + size - common)
            for j in other[alike].tolist():
                if self.label[i] != self.label[j]:
                    out.append((int(self.node[i]), int(self.node[j])))
                    self.label[self.label == self.label[j]] = self.label[i]
        return out

    def _first(self, same: np.ndarray) -> np.ndarray:
        """The first band in which both agree."""
        return same.reshape(len(same), BANDS, ROWS).all(2).argmax(1)


def _blocks(rows: DataFrame, what) -> DataFrame:
    """(key, a, b): what ``what`` tells of each band, from rows of (key, n, band, node, label, sketch, set); n is its blocks."""
    spark = rows.sparkSession
    # a row of block i takes part in the pairs (i, j) and (j, i)
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    dealt = dealt.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), side.cast("int").alias("side"), "node", "label", "band", "sketch", "set")

    def out(at, held):
        got = what(_Run(held)) if len(held) > 1 else []
        if got:
            a, b = (np.array([p[k] for p in got], np.int64) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), at[0], np.int64)), pa.array(a), pa.array(b)], ["key", "a", "b"])

    def run(batches):
        at, held = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in range(9)]
            for *key, side, node, label, band, sketch, own in zip(*cols, strict=True):
                if key != at:
                    yield from out(at, held)
                    at, held = key, []
                held.append((side, node, label, band, sketch, own))
        yield from out(at, held)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "key long, a long, b long")


def _joined(stars: DataFrame, more: DataFrame) -> DataFrame:
    """Edges that connect what the stars (node, root) and the edges ``more`` connect."""
    return stars.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more.select("a", "b"))


def _parted(live: DataFrame, known: DataFrame, stars: DataFrame, block: int) -> DataFrame:
    """(key, n, band, node, label) of the bands that hold nodes of different ``stars`` (node, root); n is its blocks."""
    label = known.select("node").join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("label"))
    rows = materialise(live.select("key", "band", "node").join(label, "node"), "labelled-bands")
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    mixed = materialise(mixed.select("key", "rows", F.ceil(F.col("rows") / F.lit(block)).cast("int").alias("n")), "open-bands")
    return _matched(rows, mixed, "key", "rows", "n", rows.count())


def _filled(rows: DataFrame, known: DataFrame, sets: bool = False) -> DataFrame:
    """``rows`` for ``_blocks``: sketches, and sets if asked for, come last, on the way to their blocks."""
    own = F.col("set") if sets else F.lit(None).cast("binary")
    return rows.join(known.select("node", "sketch", own.alias("set")), "node").select("key", "n", "band", "node", "label", "sketch", "set")


def grouped(docs: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, row_hash, node, root) of each row; rows of one root are one group of near copies."""
    marks = materialise(_marks(docs), "marks")
    same = marks.groupBy("node").agg(F.min("row_hash").alias("row_hash"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    nodes = materialise(same, "nodes")
    filed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    middle = F.min(F.struct(F.xxhash64("node", "key").alias("x"), "node"))["node"]
    bands = materialise(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), middle.alias("centre")).where("n > 1"), "bands")
    live = materialise(_matched(filed, bands, "key", "n", "centre", filed.count()).select("key", "band", "node", "centre"), "shared-bands")
    prints = materialise(_near_prints(nodes), "near-fingerprints")
    known = _known(docs, marks, live.select("node").union(prints.select("a")).union(prints.select("b")), nodes)
    some = live.where("node <> centre").select("node", "centre").distinct()
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "centre")))).where("k <= 3")
    tried = materialise(_ordered(some.select(F.col("node").alias("a"), F.col("centre").alias("b")).union(prints)), "first-pairs")
    stars = components(_verified(known, tried, share))
    more = _ordered(_blocks(_filled(_parted(live, known, stars, block), known), _Run.best))
    more = _verified(known, materialise(more.join(tried, ["a", "b"], "left_anti"), "best-pairs"), share)
    stars = components(_joined(stars, more))
    rows = _parted(live, known, stars, block)
    left = materialise(_blocks(_filled(rows, known), _Run.open).select("key", F.col("a").alias("node")).distinct(), "open-nodes")
    length = known.select("node", F.length("set").alias("bytes"))
    left = materialise(rows.drop("n").join(left, ["key", "node"], "left_semi").join(length, "node"), "open-rows")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("bytes") / F.lit(BYTES))).cast("int")
    size = materialise(left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), parts.alias("n")), "open-sizes")
    full = _filled(_matched(left, size, "key", "rows", "n", left.count()), known, True)
    last = materialise(_blocks(full, lambda run: run.links(share)).select("a", "b"), "last-links")
    roots = nodes.join(components(_joined(stars, last)), "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root"))
    out = _lookup(marks.select("doc_id", "row_hash", "node"), materialise(roots, "node-roots"), "node", "copies", "root", marks.count())
    return materialise(out, "near-copies")


def one_of_each(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` with every column, one row for each group of near copies: one of the smallest id."""
    return first_rows(docs, grouped(docs, share))
