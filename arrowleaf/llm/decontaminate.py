"""Benchmark decontamination by template windows.

Words become templates: numbers, units after numbers and names (capitalised inside a sentence) turn
into typed placeholders, other words are stripped of punctuation and lower-cased.  Numbers are split from
letters and equals signs beside them.  A capitalised word that opens a sentence may be a name or not:
windows that hold one are taken in both forms.  Windows of five template words are hashed; windows of
documents that a Bloom filter of the benchmark lets pass are hash-joined with those of the items.
Windows that are mostly placeholders are alike everywhere, so they stay out of that join: they are looked
up only where a plain window of the same item has already placed the item in the document.

A match must be slot-consistent: in one occurrence of the item, however words were put in or left out,
each value of the item stands for one value of the document, else the windows that hold it do not count;
so re-parameterised questions are caught and chance matches of placeholders are not.  A value that only
openers taken as names contradict costs those windows alone.  A document holds an item when the matched
windows of one occurrence cover at least ``share`` of the item's words.

Defined cases: null and empty texts hold nothing; items of fewer than five words match only a text
that is no longer; items without words match nothing; repeated rows and equal items give each
pair once; rows of one id (a null one too) with different texts are judged apart, ``leaks`` giving the
best of them; windows that are mostly placeholders take part only beside others; no rows give no rows;
other columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialise, sliced, unused

WIDTH = 5
#: Benchmark windows, and contaminated rows, that are broadcast at most; more go through a shuffle.
BROADCAST_WINDOWS, BROADCAST_ROWS, SALT = 200_000, 1_000_000, 32
#: Unit words that a number may carry.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml l litre litres liter liters "
    "gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years cent cents dollar dollars usd euro euros eur "
    "percent degree degrees celsius fahrenheit kelvin joule joules watt watts volt volts amp amps newton newtons hz khz mhz ghz kmh mph".split()
)
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*%?")
_MIXED = re.compile(r"(?<=\d)(?=-?[^\W\d_])|(?<=[^\W\d_])(?=\d)|(?<=[^\W\d_]-)(?=\d)|(?<==)(?=[+\-]?[$€£]?\d)|(?<=\d)(?==)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_TITLE = re.compile(r"[^\W\d_][^\W\d_A-Z]*[a-z][\w'’-]*")
_N, _U, _P = (xxhash.xxh64_intdigest(f"<{x}>") for x in ("number", "unit", "name"))
_ROLL = np.uint64(0x9E3779B97F4A7C15)
#: The low bits of a word's code.
STOP, TITLE, UNIT, NUMBER, EMPTY, MIXED = 1, 2, 4, 8, 16, 32
FLAGS = 63


class Words(dict):
    """token -> hash of the plain word with six flag bits; at most ``limit`` are remembered."""

    limit = 500_000

    def __missing__(self, token: str) -> int:
        mark = token[-1]
        flags = STOP * (mark in ".!?:" or token[-2:-1] in (".", "!", "?"))
        plain = token if mark.isalpha() else token[:-1]
        if not plain.isalpha() or plain is not token and mark not in ".,;:!?":  # not a word with at most one mark after it
            plain = _EDGES.sub("", token)
        low = plain.lower()
        if not plain:
            flags |= EMPTY
        elif not plain.isalpha() and _NUMBER.fullmatch(plain):
            flags |= NUMBER
        elif not token.isalpha() and _MIXED.search(token):
            flags |= MIXED
        else:
            flags |= UNIT * (low in UNITS) | TITLE * (low != plain and plain[0].isupper() and bool(_TITLE.fullmatch(plain)))
        if len(self) >= self.limit:
            self.clear()
        self[token] = code = xxhash.xxh64_intdigest(low) & ~FLAGS | flags
        return code


@dataclass
class Templates:
    """The words of several texts in a row, without tokens of punctuation alone."""

    tokens: list[str]
    of: np.ndarray  # each token's text
    code: np.ndarray  # of the template word
    slot: np.ndarray  # whether it is a placeholder
    opener: np.ndarray  # whether it opens a sentence and may be a name
    size: np.ndarray  # words of each text


def canonical(texts: list[str | None], words: Words) -> Templates:
    """The template words of the texts."""
    cut = [t.split() if t else [] for t in texts]
    tokens = [*chain.from_iterable(cut)]
    of = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    code = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    flags = (code & np.uint64(FLAGS)).astype(np.uint8)
    if (mixed := flags & MIXED != 0).any():
        times, parts, at = np.ones(len(tokens), np.int64), [], 0
        for i in np.flatnonzero(mixed).tolist():
            own = _MIXED.split(tokens[i])
            times[i] = len(own)
            parts += tokens[at:i]
            parts += own
            at = i + 1
        tokens, of = parts + tokens[at:], np.repeat(of, times)
        code = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
        flags = (code & np.uint64(FLAGS)).astype(np.uint8)
    begin = np.ones(len(code), bool)  # of a sentence
    begin[1:] = (flags[:-1] & STOP != 0) | (of[1:] != of[:-1])
    some = flags & EMPTY == 0
    if not some.all():
        at = np.flatnonzero(some)
        code, flags, begin, of = code[at], flags[at], begin[at], of[at]
        tokens = [tokens[i] for i in at.tolist()]
    number = flags & NUMBER != 0
    unit = np.zeros(len(code), bool)
    unit[1:] = (flags[1:] & UNIT != 0) & number[:-1] & (of[1:] == of[:-1])
    title = flags & TITLE != 0
    name = title & ~begin
    slot = number | unit | name
    out = code & ~np.uint64(FLAGS)
    out[number], out[unit], out[name] = _N, _U, _P
    return Templates(tokens, of, out, slot, title & begin & ~slot, np.bincount(of, minlength=len(texts)))


def windows(code: np.ndarray, width: int) -> np.ndarray:
    if len(code) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(code) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ code[i : len(code) - width + 1 + i]) * _ROLL
            out ^= out >> np.uint64(29)
        return out + np.uint64(width)


def _values(tokens: list[str], slot: np.ndarray, at: int, width: int) -> list[str]:
    return [_EDGES.sub("", tokens[i]).lower() for i in range(at, at + width) if slot[i]]


def _inside(flags: np.ndarray, width: int) -> np.ndarray:
    """How many flags each window holds."""
    ends = np.concatenate([[0], np.cumsum(flags)])
    return ends[width:] - ends[:-width]


def _windows_of(df: DataFrame, id_col: str, widths: list[int], bloom) -> DataFrame:
    """(id, row, w, at, width, n_words, plain, opened, slots): windows with positions and slot values.

    Windows shorter than WIDTH are whole texts.  ``opened`` windows take the capitalised words that open
    sentences as names.
    """

    def run(batches):
        words = Words()
        for big in batches:
            for b in sliced(big, 2_000_000):
                t = canonical(b.column(2).to_pylist(), words)
                first = np.cumsum(t.size) - t.size
                found = []
                for width in widths:
                    n = len(t.code) - width + 1
                    if n < 1:
                        continue
                    fits = t.of[:n] == t.of[width - 1 :]
                    if width < WIDTH:
                        fits &= t.size[t.of[:n]] == width
                    for opened, code, slot in ((False, t.code, t.slot), (True, np.where(t.opener, np.uint64(_P), t.code), t.slot | t.opener)):
                        if opened and not t.opener.any():
                            continue
                        w = windows(code, width)
                        keep = fits if bloom is None else fits & _passes(bloom.value, w)
                        at = np.flatnonzero(keep & (_inside(t.opener, width) > 0) if opened else keep)
                        found.append((at, w[at].view(np.int64), np.full(len(at), width), _inside(slot, width)[at], np.full(len(at), opened), slot))
                slots = [_values(t.tokens, slot, i, width) if k else [] for at, _, size, n, _, slot in found for i, width, k in zip(at.tolist(), size.tolist(), n.tolist(), strict=True)]
                at, w, width, n, opened = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(5))
                of = t.of[at]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
                values = [w, at - first[of], width, t.size[of], 2 * n <= width, opened.astype(bool), slots]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))],
                    ["id", "row", "w", "at", "width", "n_words", "plain", "opened", "slots"],
                )

    d = df.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("row"), "text")
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, row long, w long, at int, width int, n_words int, plain boolean, opened boolean, slots array<string>")


def _bloom(items: DataFrame, bits: int | None) -> tuple[np.ndarray, list[int]]:
    """A table of ``2**bits`` one-bit cells of the items' windows, packed, and the windows' widths.

    Without ``bits`` there are some 128 cells a window, 32 MB at the most; a fuller table only lets more pass.
    """
    if bits is None:
        bits = min(28, max(16, int(items.count()).bit_length() + 7))
    cell = items.select(F.expr(f"w & {(1 << bits) - 1}").alias("c"), "width").distinct()
    flags = np.zeros(1 << bits, bool)
    got = cell.toArrow()  # a row a set cell
    flags[got.column("c").to_numpy()] = True
    return np.packbits(flags, bitorder="little"), sorted(set(got.column("width").to_pylist()))


def _passes(cells: np.ndarray, w: np.ndarray) -> np.ndarray:
    at = w & np.uint64(8 * len(cells) - 1)
    return (cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def occurrences(rows: list[dict], n_words: int) -> list[list[dict]]:
    """The matched windows of one text and item, parted into occurrences of the item.

    Alignments (document position less item position) that lie close together are one occurrence; in it
    each item position takes the alignment that most windows share.
    """
    votes = Counter(r["at"] - r["item_at"] for r in rows)
    group, last, groups = {}, None, 0
    for along in sorted(votes):
        if last is not None and along - last > max(n_words // 2, WIDTH):
            groups += 1
        group[along], last = groups, along
    best: dict[tuple[int, int], int] = {}
    for r in rows:
        along = r["at"] - r["item_at"]
        key = (group[along], r["item_at"])
        if key not in best or (votes[along], -along) > (votes[best[key]], -best[key]):
            best[key] = along
    out: dict[int, list[dict]] = {}
    for r in rows:
        along = r["at"] - r["item_at"]
        if best[group[along], r["item_at"]] == along:
            out.setdefault(group[along], []).append(r)
    return list(out.values())


def judge(rows: list[dict], n_words: int) -> tuple[float, bool, int]:
    """(coverage, whether all values are the item's own, windows) of one occurrence's matched windows."""

    def torn(some) -> set[str]:
        stands: dict[str, set[str]] = {}
        for r in some:
            for v, d in zip(r["item_slots"], r["slots"], strict=True):
                stands.setdefault(v, set()).add(d)
        return {v for v, d in stands.items() if len(d) > 1}

    bad, bad_opened = torn(r for r in rows if not r["opened"]), torn(rows)
    kept = [r for r in rows if not (bad_opened if r["opened"] else bad).intersection(r["item_slots"])]
    if not any(r["plain"] for r in kept):
        return 0.0, False, 0
    own: dict[int, bool] = {}
    for r in kept:
        own[r["item_at"]] = own.get(r["item_at"], False) or r["slots"] == r["item_slots"]
    covered = {i for r in kept for i in range(r["item_at"], r["item_at"] + r["width"])}
    return len(covered) / n_words, all(own.values()), len(own)


def _held(docs: DataFrame, benchmark: DataFrame, share: float, bits: int | None) -> DataFrame:
    """(doc_id, row, item_id, coverage, n_windows, kind): which items each text holds; row is its hash."""
    spark = docs.sparkSession
    items = materialise(_windows_of(benchmark, "item_id", [*range(1, WIDTH + 1)], None), "item-windows")
    cells, widths = _bloom(items, bits)
    found = materialise(_windows_of(docs, "doc_id", widths or [WIDTH], spark.sparkContext.broadcast(cells)), "windows")  # read twice below
    doc = found.select("w", "width", F.struct(F.col("id").alias("doc_id"), "row").alias("text"), "at", "plain", "opened", "slots")
    item = items.select("w", "width", F.struct(F.col("id").alias("item_id"), F.col("row").alias("item_row")).alias("item"), F.col("at").alias("item_at"), "plain", "n_words", F.col("opened").alias("item_opened"), F.col("slots").alias("item_slots"))
    side = item.where("plain").drop("plain")
    if items.count() <= BROADCAST_WINDOWS:
        met = doc.where("plain").join(F.broadcast(side), ["w", "width"])
    else:  # a window that a third of all texts holds is spread over SALT tasks
        salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = doc.where("plain").withColumn("salt", F.pmod(F.xxhash64("text", "at"), F.lit(SALT)).cast("int")).join(salted, ["w", "width", "salt"]).drop("salt")
    met = materialise(met.withColumn("opened", F.col("opened") | F.col("item_opened")).drop("item_opened", "w"), "matches")
    # where an item has been placed, its windows of placeholders are looked up at just that place
    places = met.select("text", "item", (F.col("at") - F.col("item_at")).alias("along")).distinct()
    slotted = item.where("NOT plain").drop("plain")
    slotted = F.broadcast(slotted) if items.count() <= BROADCAST_WINDOWS else slotted
    wanted = places.join(slotted, "item").withColumn("at", F.col("along") + F.col("item_at")).drop("along")
    beside = wanted.join(doc.where("NOT plain"), ["text", "at", "w", "width"])
    beside = beside.withColumn("opened", F.col("opened") | F.col("item_opened")).select(*met.columns)
    each = met.unionByName(beside).groupBy("text", "item").agg(
        F.max("n_words").alias("n_words"), F.collect_set(F.struct("at", "item_at", "width", "plain", "opened", "slots", "item_slots")).alias("rows")
    )  # a set is bounded by one text and one item, however often the row is repeated

    def verdicts(batches):
        for b in batches:
            out = []
            for n, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.append(max(judge(o, n) for o in occurrences(rows, n)))
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.float64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), *cols], ["doc_id", "row", "item_id", "coverage", "own", "n_windows"])

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    judged = each.select("n_words", "rows", "text.doc_id", "text.row", "item.item_id").mapInArrow(verdicts, f"doc_id {kinds[0]}, row long, item_id {kinds[1]}, coverage double, own boolean, n_windows long")
    kind = F.when(F.col("own"), "exact").otherwise("reparameterised")
    return judged.where(F.col("coverage") >= share).select("doc_id", "row", "item_id", "coverage", "n_windows", kind.alias("kind"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, bits: int | None = None) -> DataFrame:
    """(doc_id, item_id, coverage, n_windows, kind): which items each document holds.

    kind is 'exact' when all slot values are the item's own, else 'reparameterised'.
    """
    best = F.max(F.struct("coverage", (F.col("kind") == "exact").alias("own"), "n_windows", "kind")).alias("b")
    return _held(docs, benchmark, share, bits).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.coverage", "b.n_windows", "b.kind")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, bits: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    ident, row, own = unused(docs, "_id", "_row", "_hash")
    bad = materialise(_held(docs, benchmark, share, bits).select(F.col("doc_id").alias(ident), F.col("row").alias(row)).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    d = docs.withColumn(own, F.xxhash64("text"))
    return d.join(bad, d["doc_id"].eqNullSafe(F.col(ident)) & (F.col(own) == F.col(row)), "left_anti").select(*columns(docs))
