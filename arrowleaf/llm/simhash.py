"""SimHash near-duplicates found with the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most ``radius`` bits differ.  The bits are grouped into m
partitions, correlated bits together; partition i gets a threshold t_i with
sum(t_i + 1) = radius + 1, so that any linked pair agrees up to t_i bits in some partition i.  A
dynamic programme over estimated candidate counts (measured on all fingerprints) picks the unequal
thresholds, and the cheapest m.  Each fingerprint is filed under its value in a partition and, where
t_i > 0, probes the values up to t_i bits away; candidates of a value are verified in full.

Large values are cut into blocks, and pairs of blocks are verified apart, so no group is gathered
whole.  A verified block yields a spanning forest of its links, never all its pairs.  Components are
then joined by alternating star steps over edges in the shared folder.

Defined cases: null and empty texts have no shingles and the fingerprint zero, which links like any
other; texts of fewer words than a shingle are one shingle; a null id takes its component's smallest
id; repeated rows give repeated results; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, ascii_words, columns, materialise, sliced, unused

#: Relative costs of filing a row and of verifying a pair, as measured.
ROW_COST, PAIR_COST = 1.0, 0.001
#: Fingerprints of a block.
BLOCK = 2048


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, as a signed 64-bit integer."""
    words = ascii_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= width:
        h = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        h = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, row_hash, fp) of each row's whole text; row_hash tells texts of one id apart."""

    def run(batches):
        for big in batches:
            for b in sliced(big):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t, width) for t in b.column(2).to_pylist()], pa.int64())], ["doc_id", "row_hash", "fp"])

    d = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, row_hash long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often each two bits are set together (64 x 64)."""

    def run(batches):
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float64)
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(4097), pa.int32()), "n": pa.array([float(n), *both.ravel()])})

    got = classes.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    if got.empty:
        return 0, np.zeros((64, 64))
    v = got["n"].to_numpy()
    return int(v[0]), v[1:].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size; each takes, bit by bit, the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for g in range(m):
        size = len(left) // (m - g)
        seed = max(left, key=lambda b: corr[b, left].max() if len(left) > 1 else 0)
        own = [seed]
        left.remove(seed)
        while len(own) < size:
            best = max(left, key=lambda b: corr[b, own].sum())
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def estimate(n: int, p: np.ndarray, own: list[int], collisions: float, t: int) -> float:
    """Candidate pairs within t bits in the partition, from the measured pairs that agree in it all."""
    agree = 1 - 2 * p[own] * (1 - p[own])
    odds = (1 - agree) / np.maximum(agree, 1e-9)
    ways = [1.0]  # elementary symmetric sums: pairs that differ in exactly j of the bits
    for o in odds:
        ways = [a + o * b for a, b in zip([*ways, 0.0], [0.0, *ways], strict=True)]
    return min(float(n) * n / 2, collisions * sum(ways[: t + 1]))


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t_i + 1) = total of least cost; cost[i][s] is that of t_i = s - 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, way) in best.items():
            for s in range(min(total - used, len(row) - 1) + 1):
                if used + s not in new or c + row[s] < new[used + s][0]:
                    new[used + s] = (c + row[s], [*way, s - 1])
        best = new
    return best[total]


def _collisions(classes: DataFrame, groups: list[list[int]]) -> list[float]:
    """Pairs that agree in all bits of each group, over all fingerprints.

    Groups of up to 16 bits are counted exactly by value.  Wider ones are cut into parts of up to 8
    bits, whose exact shares multiply.
    """
    parts = [(g, own[i : i + w]) for g, own in enumerate(groups) for w in [16 if len(own) <= 16 else 8] for i in range(0, len(own), w)]

    def run(batches):
        counts = [np.zeros(1 << len(own), np.int64) for _, own in parts]
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.int64)
            for c, (_, own) in zip(counts, parts, strict=True):
                c += np.bincount(x[:, own] @ (1 << np.arange(len(own))), minlength=len(c))
        for k, c in enumerate(counts):
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(v), k), pa.int32()), "value": pa.array(v, pa.int64()), "n": pa.array(c[v], pa.int64())})

    got = classes.select("fp").mapInArrow(run, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").cast("double").alias("n"))
    stats = {r["part"]: (r["sq"], r["n"]) for r in got.groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("n")).collect()}
    out = [0.0] * len(groups)
    for g in range(len(groups)):
        share, n = 1.0, 0.0
        for k, (og, _) in enumerate(parts):
            if og == g and k in stats:
                sq, n = stats[k]
                share *= sq / (n * n)
        out[g] = max(0.0, (share * n * n - n) / 2)
    return out


def plan(classes: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that are probed."""
    n, both = _moments(classes)
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, radius + 2):
        groups = group_bits(n, both, m)
        same = _collisions(classes, groups)
        cost = []
        for own, c in zip(groups, same, strict=True):
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(comb(len(own), j) for j in range(t + 1))
                row.append(float("inf") if probes > 5000 else n * (probes + bool(t)) * ROW_COST + estimate(n, p, own, c, t) * PAIR_COST)
            cost.append(row)
        c, way = allocate(cost, radius + 1)
        if c < best[0] or not best[1]:
            best = (c, [(own, t) for own, t in zip(groups, way, strict=True) if t >= 0])
    return best[1]


def _signatures(classes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, probe): a row for each value that a fingerprint is filed under or probes."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            x = _bits(fp).astype(np.int64)
            for k, (own, t) in enumerate(parts):
                key = x[:, own] @ (1 << np.arange(len(own), dtype=np.int64))
                flips = [0, *(sum(1 << i for i in c) for j in range(1, t + 1) for c in combinations(range(len(own)), j))]
                for f in flips:
                    yield pa.RecordBatch.from_pydict(
                        {"part": pa.array(np.full(len(fp), k), pa.int32()), "key": pa.array(key ^ f, pa.int64()), "fp": pa.array(fp, pa.int64()), "probe": pa.array(np.full(len(fp), f != 0))}
                    )

    return classes.select("fp").mapInArrow(run, "part int, key long, fp long, probe boolean")


def spanning(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or between a and b when b is given."""
    u = a.view(np.uint64)
    v = u if b is None else b.view(np.uint64)
    nodes = a if b is None else np.concatenate([a, b])
    root = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    shift = 0 if b is None else len(a)
    for i in range(len(u)):
        begin = i + 1 if b is None else 0
        near = np.flatnonzero(np.bitwise_count(v[begin:] ^ u[i]) <= radius) + begin + shift
        if len(near):
            ri = top(i)
            for j in near[root[near] != ri].tolist():
                rj = top(j)
                if rj != ri:
                    root[rj] = ri
                    edges.append((int(nodes[i]), int(nodes[j])))
            root[near] = ri
    return edges


def _verify(fp: np.ndarray, probe: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one value (or pair of blocks): filed with filed, and filed with probing rows."""
    filed = ~probe
    if side[0] == 2:
        x, y = fp[filed], fp[probe]
        edges = spanning(x, None, radius) if len(x) > 1 else []
        return edges + (spanning(x, y, radius) if len(x) and len(y) else [])
    edges = []
    for a, b in ((fp[filed & (side == 0)], fp[side == 1]), (fp[filed & (side == 1)], fp[probe & (side == 0)])):
        if len(a) and len(b):
            edges += spanning(a, b, radius)
    return edges


def links(classes: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints that connect just what the links connect."""
    spark = classes.sparkSession
    sig = _signatures(classes, plan(classes, radius))
    crowd = materialise(sig.groupBy("part", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block), "crowded-values")
    n_crowd = crowd.count()
    over = F.broadcast(crowd) if n_crowd <= 16 * HEAVY else crowd
    n_blocks = F.ceil(F.col("rows") / F.lit(block)).cast("int")
    dealt = sig.join(over, ["part", "key"], "left").withColumn("n", F.coalesce(n_blocks, F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    # a row of block i takes part in the pairs (i, j) and (j, i); side 2 is a block with itself
    dealt = dealt.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(
        "part", "key", "fp", "probe",
        F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"),
        F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).cast("int").alias("side"),
    )

    def run(batches):
        held: list[list[np.ndarray]] = []

        def cut(last: bool):
            """Verify the runs of equal (part, key, lo, hi); the last run waits for more rows."""
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            ends = [0, *new.tolist(), *([len(cols[0])] if last else [])]
            edges: set[tuple[int, int]] = set()
            fp, probe, side = cols[4:]
            for a, b in zip(ends, ends[1:], strict=False):
                if b - a > 1:
                    edges.update((min(e), max(e)) for e in _verify(fp[a:b], probe[a:b], side[a:b], radius) if e[0] != e[1])
            held[:] = [[c[ends[-1] :] for c in cols]]
            pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

        rows = 0
        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "lo", "hi", "fp", "probe", "side")])
            rows += b.num_rows
            if rows >= 20_000:
                yield cut(False)
                rows = len(held[0][0])
        if held:
            yield cut(True)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "part", "key", "lo", "hi").sortWithinPartitions("part", "key", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component, by alternating large and small stars.

    Every step is a grouped minimum and one explode; a node's neighbours are never collected.  The steps end
    when only stars are left: no root is below another and no node is below two.
    """
    e = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    size = e.count()
    for _ in range(60):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: the neighbours above u go to the smallest of u and its neighbours
        large = _lookup(both, low, "u", "n", "m", 2 * size).where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        # small star: u and its neighbours below go to the smallest of them
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _lookup(large, least, "u", "n", "m", large.count()).select(F.col("v").alias("x"), "m").union(least.select("u", "m")).where("x <> m").distinct()
        e = materialise(small.select(F.col("m").alias("a"), F.col("x").alias("b")), "stars")
        ends = e.select(F.col("b").alias("node"), F.lit(1).alias("below")).union(e.select("a", F.lit(0)))
        seen = ends.groupBy("node").agg(F.sum("below").alias("roots"), F.min("below").alias("least"))
        if not seen.where("roots > 1 or (roots = 1 and least = 0)").count():
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        size = e.count()
    raise RuntimeError("components did not settle")


def _grouped(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """(doc_id, row_hash, fp, root) with a root fingerprint for each component."""
    fps = materialise(fingerprints(docs, width), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")), "classes")
    comp = components(links(classes, radius))
    roots = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"))
    return materialise(_lookup(fps, materialise(roots, "class-roots"), "fp", "copies", "root", fps.count()), "grouped")


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest id reachable) of each row."""
    rows = _grouped(docs, width, radius)
    least = materialise(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "component-ids")
    out = _lookup(rows, least, "root", "n", "component_id", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, value: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of its key; keys that meet many rows are broadcast, the rest shuffled."""
    limit = max(1, total // HEAVY)
    heavy = table.where(F.col(weight) > limit).select(key, F.col(value).alias("_hot"), F.lit(True).alias("_is"))
    light = table.where(F.col(weight) <= limit).select(key, value)
    first = rows.join(F.broadcast(heavy), key, "left")
    hot = first.where(F.col("_is")).withColumn(value, F.col("_hot")).drop("_hot", "_is")
    cold = first.where(F.col("_is").isNull()).drop("_hot", "_is").join(light.hint("merge"), key, "left")
    return hot.unionByName(cold)


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with every column, one row for each component: one of the smallest id."""
    return first_rows(docs, _grouped(docs, width, radius))


def first_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``rows`` (doc_id, row_hash, root)."""
    ident, row, own = unused(docs, "_id", "_row", "_hash")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias(ident), F.col("k.row_hash").alias(row)).distinct()
    d = docs.withColumn(own, F.xxhash64("text"))
    kept = d.join(keep, d["doc_id"].eqNullSafe(keep[ident]) & (d[own] == keep[row]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*columns(docs))
