"""Token ids in ORC files: stripes with integer run-length encoding, row indexes, Bloom filters on ids.

Documents are range-partitioned and sorted by id, encoded, ended with one end id and written as ORC,
so files, stripes and row groups follow the id order.  Readers split files at stripes; a filter on
doc_id prunes files, stripes and row groups by their minimum, maximum and Bloom filter.

A file row holds part (the task), doc_id, at (ids before it in its part), n_tokens and ids.  Global
starts come from the parts' totals, one number a part.

Defined cases: null and empty texts hold the end id alone; null ids come first; rows of equal id are
ordered by the hash of their text; long texts are encoded whole; no rows give an empty file set;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sliced

ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.stripe.size": str(16 << 20)}


#: Marks that are a piece of their own at the end of a word.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Letters that normalisation only lower-cases and that pre-tokenization keeps together.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The parts of a tokenizer file under which chunks between white space stand for themselves.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _known_kind(spec: dict) -> bool:
    """Whether the file has just the parts that the way by chunks relies on."""
    model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    added = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
    return spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_PIECES, _BYTES]} and model == _MODEL and added


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, .. of each of the runs, in order."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Chunks:
    """Texts -> ids, by the tokenizers library; ids of chunks between white space are remembered.

    For a tokenizer of the known kind a text's ids are those of its chunks between ASCII white space in
    order.  Marks at the end of a word are a chunk too.  Chunks of plain Latin-1 letters skip the
    normaliser and go to the library's model at once.  Other kinds encode each text as a whole.
    """

    def __init__(self, spec: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_str(spec), limit
        self.direct = _known_kind(json.loads(spec))
        self.letters = {b: c for b, c in _byte_letters().items() if b != 10}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remember new chunks with their ids, one after another."""
        first, need = len(self.known), self.used + len(ids)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(names) > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        at = slice(first, first + len(names))
        self.flat[self.used : need] = ids
        self.start[at] = self.used + np.cumsum(size) - size
        self.size[at] = size
        self.known.update(zip(names, range(first, first + len(names)), strict=True))
        self.used = need

    def _resolve(self, chunks: list[str]) -> None:
        """Remember distinct chunks that are not known yet."""
        plain, low, other, ended = [], [], [], []
        for c in chunks:
            if c.isalpha() and _PLAIN.fullmatch(c):
                plain.append(c)
                low.append(c.lower())
                continue
            word = c.rstrip(_MARKS) if "<|" not in c else c
            if word and len(word) < len(c) and "a" <= word[-1] <= "z":
                ended.append((c, word, c[len(word) :]))
            else:
                other.append(c)
        tokenize = self.tokenizer.model.tokenize
        names = "\n".join(low).encode().decode("latin-1").translate(self.letters).split("\n") if low else []
        self._keep(plain, [[t.id for t in tokenize(n)] for n in names])
        for at in range(0, len(other), 5_000):
            got = self.tokenizer.encode_batch_fast(other[at : at + 5_000], add_special_tokens=False)
            self._keep(other[at : at + 5_000], [e.ids for e in got])
        if ended:
            self._resolve(list({p for _, *parts in ended for p in parts}.difference(self.known)))
            at = np.array([[self.known[w], self.known[m]] for _, w, m in ended])
            size = self.size[at]
            self._add([c for c, _, _ in ended], self.flat[_ragged(self.start[at].ravel(), size.ravel())], size.sum(1))

    def _keep(self, names: list[str], ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(names, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids start and end."""
        texts = pc.fill_null(texts, "")
        if not self.direct:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)])
        # lower-casing A-Z first changes no ids, but could make a special token's string
        cut = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        chunks = cut.flatten().dictionary_encode()
        names = chunks.dictionary.to_pylist()
        if len(self.known) + len(names) > self.limit:
            kept = [c for c in names if c in self.known]  # the common ones stay
            at = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
            ids, size = self.flat[_ragged(self.start[at], self.size[at])], self.size[at]
            self._forget()
            self._add(kept, ids, size)
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(at < 0)):
            fresh = [names[i] for i in new.tolist()]
            self._resolve(fresh)
            at[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        at = at[chunks.indices.to_numpy()]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[_ragged(self.start[at], size)], ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]


@lru_cache(maxsize=1)
def _chunks(spec: str) -> Chunks:
    """A Python worker's own chunks, kept from task to task."""
    return Chunks(spec)


def write(docs: DataFrame, path: str, spec: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents below ``path`` in ascending id order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    def run(batches):
        chunks, part, before = _chunks(shared.value), TaskContext.get().partitionId(), 0
        for big in batches:
            for b in sliced(big, 4_000_000):
                ids, ends = chunks.encode(b.column(1))
                ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
                n = np.diff(ends)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part), pa.int32()), b.column(0), pa.array(before + ends[:-1], pa.int64()), pa.array(n), lists], ["part", "doc_id", "at", "n_tokens", "ids"]
                )
                before += int(ends[-1])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    d = d.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    d.mapInArrow(run, f"part int, doc_id {kind}, at long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, read by stripes."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a writing task
    first = totals.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("first"))
    return rows.join(F.broadcast(first), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read`` with the crc32 of the ids in place of the ids."""

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat = ids.flatten().to_numpy().astype("<u4", copy=False)
            ends = np.cumsum([0, *ids.value_lengths().to_pylist()]).tolist()
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
