"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that is a vocabulary entry
resolves in one probe.  Tier two merges the bytes of the others with a heap over a linked list of
parts, so that a pre-token of n bytes costs O(n log n).  Text is cut by the public pattern, each
match is encoded by itself, and there are no special tokens.

Defined cases: null and empty texts have no ids (the digests are those of no bytes); long texts and
long pre-tokens are encoded whole; repeated rows give repeated results; other columns of the input
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

_M64 = (1 << 64) - 1
_K1, _K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: White space as Unicode has it; Python's \s also takes the four separators from 0x1C on.
_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pre-token pattern with white space spelled out."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\s":
                pair = _SPACE if in_class else f"[{_SPACE}]"
            elif pair == r"\S" and not in_class:
                pair = f"[^{_SPACE}]"
            out.append(pair)
            i += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(c)
        i += 1
    return regex.compile("".join(out))


class PerfectHash:
    """Minimal perfect hash (hash and displace): n keys onto 0..n-1, one displacement a bucket."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat")
        self.n, self.buckets = n, n // 4 + 1
        self.shift = np.zeros(self.buckets, np.int64)
        where = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        sizes = np.bincount(where, minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own, d = h[order[ends[b] - sizes[b] : ends[b]]], 0
            while True:
                tries = np.arange(d, d + 256, dtype=np.uint64)
                slots = self._mix(own[None, :], tries[:, None])
                ok = free[slots].all(1)
                for j in np.flatnonzero(ok):
                    if len(np.unique(slots[j])) == len(own):
                        free[slots[j]] = False
                        self.shift[b] = d + int(j)
                        break
                else:
                    d += 256
                    continue
                break
        left = iter(np.flatnonzero(free))  # buckets of one key name their slot
        for b in np.flatnonzero(sizes == 1):
            self.shift[b] = -1 - int(next(left))

    def _mix(self, h, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(_K1))) * np.uint64(_K2)
        return (((x >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._mix(h, d.astype(np.uint64)))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for one table of ranks; ``memo`` bounds the remembered pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.ranks, self.pattern, self.memo = ranks, pattern, memo
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        at = self.hash.slots(keys)
        self.slot_key: list[bytes] = [b""] * len(keys)
        self.slot_id = np.zeros(len(keys), np.uint32)
        for k, s in zip(keys, at.tolist(), strict=True):
            self.slot_key[s] = k
            self.slot_id[s] = ranks[k]
        self.bytes_of = {i: k for k, i in ranks.items()}
        self._ready()

    def _ready(self) -> None:
        self.find, self.known = compile_pattern(self.pattern).findall, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties, over linked parts."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        back = list(range(-1, n - 1))  # where the part before begins
        live = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, a, mid, stop = heappop(heap)
            if not live[a] or end[a] != mid or not live[mid] or end[mid] != stop:
                continue
            live[mid] = False
            end[a] = stop
            if stop < n:
                back[stop] = a
                if (r := ranks.get(piece[a : end[stop]])) is not None:
                    heappush(heap, (r, a, stop, end[stop]))
            if (p := back[a]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heappush(heap, (r, p, a, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Resolve pre-tokens: those in the vocabulary by the perfect hash, the rest by merging."""
        if len(self.known) + len(pieces) > self.memo:
            self.known.clear()
        else:
            pieces = pieces.difference(self.known)
        names = list(pieces)
        raw = [p.encode() for p in names]
        if not raw:
            return
        known, slot_key = self.known, self.slot_key
        slots = self.hash.slots(raw)
        whole = self.slot_id[slots].astype("<u4").tobytes()
        for j, (name, piece, s) in enumerate(zip(names, raw, slots.tolist(), strict=True)):
            if slot_key[s] == piece:
                known[name] = whole[4 * j : 4 * j + 4]
            else:
                known[name] = np.array(self.merge(piece), "<u4").tobytes()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # the vocabulary: its size is that of the file

    def run(batches):
        for big in batches:
            for b in sliced(big):
                ids = shared.value.encode_many(b.column(1).to_pylist())
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids, and return counts and digests of both."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for big in batches:
            for b in sliced(big):
                own = shared.value
                ids = own.encode_many(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
