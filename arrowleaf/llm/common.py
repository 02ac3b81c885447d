"""Helpers shared by the corpus operators: words, hashes, the shared folder, skew-safe lookups."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast lookup side has at most this many rows: no more keys can each hold 1/HEAVY of a total.
HEAVY = 4096
_own_dir: dict[str, str] = {}
_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is missing, a temporary folder stands in on a local master and goes with the
    process; on a cluster no machine's own folder will do, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _own_dir:
            _own_dir["dir"] = tempfile.mkdtemp(prefix="arrowleaf-")
            atexit.register(shutil.rmtree, _own_dir["dir"], ignore_errors=True)
        base = _own_dir["dir"]
    _made.append(f"{base.rstrip('/')}/arrowleaf/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many intermediate tables this process has named so far; a mark for ``discard``."""
    return len(_made)


def discard(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the intermediate tables named since the mark, once nothing reads them any more."""
    for path in _made[since:]:
        if path not in keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _made[since:] = keep


def drop_shuffles(spark: SparkSession) -> None:
    """Free the shuffle files of finished steps: Spark deletes them once the driver has collected its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such columns, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def columns(df: DataFrame) -> list:
    """All columns of ``df``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at ASCII white space; ``None`` gives no words."""
    return text.encode().lower().split() if text else []


class HashMemo(dict):
    """word -> unsigned XXH64, remembered for at most ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 300_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def id_text(id_col: str = "doc_id"):
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def crc_fold(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(id_text(id_col).cast("binary")) % mod


def labelled_sample(labels: DataFrame, label: str, fold_ok, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` (id, y) rows of the learnable folds, the same ones on every run.

    Null labels and null ids are left out; an id with several labels takes the largest.
    """
    return (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & fold_ok)
        .groupBy(F.col(id_col).alias("sample_id")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("sample_id"), "sample_id").limit(bound)
    )


def skew_safe_semi(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Rows whose key is in ``keys`` (unique keys, with a count of the rows each will meet).

    Keys that meet over 1/HEAVY of ``total`` rows are at most HEAVY in number, so they are
    broadcast; the others go through a shuffle in which no key is large.
    """
    limit = max(1, total // HEAVY)
    heavy = keys.where(F.col(weight) > limit).select(*on)
    light = keys.where(F.col(weight) <= limit).select(*on)
    hot = rows.join(F.broadcast(heavy), on, "left_semi")
    cold = rows.join(F.broadcast(heavy), on, "left_anti").join(light.hint("merge"), on, "left_semi")
    return hot.unionByName(cold)



def strings(column) -> list[str | None]:
    """An Arrow column as Python strings."""
    return column.to_pylist()


def sliced(batch, chars: int = 4_000_000):
    """Split an Arrow batch so that the texts of each piece stay small."""
    step = max(1, min(batch.num_rows, int(chars // max(1, batch.nbytes / max(1, batch.num_rows)))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
