"""What the operators of this subpackage share: folders, staged tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from shelfwise.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows for the plans that run inside, if the session does not ask for smaller ones."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; whatever other columns are called, they are gone."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def ddl(kind: DataType) -> str:
    """A type in DDL, with the names of its fields quoted."""
    if isinstance(kind, StructType):
        return "struct<" + ",".join("`" + f.name.replace("`", "``") + "`:" + ddl(f.dataType) for f in kind) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{ddl(kind.keyType)},{ddl(kind.valueType)}>"
    return kind.simpleString()


#: Rows of a list up to this number are sent to all tasks to drop or pick rows (24 bytes each); beyond, a join.
BROADCAST_IDS = 1_000_000
#: Arrow rows in a batch while tables are staged: texts are long, and tasks hold a batch or two.
BATCH_ROWS = 1000


def few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """df, marked for broadcast if it has `most` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256: with the id, the name of a row."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text: Callable[[Column], Column] = lambda c: c, text_col: str = "text") -> DataFrame:
    """docs less the rows named in gone; of rows that share a name in repeated, one stays.

    gone and repeated: (doc_id, h) with h the text_key of text(text_col), a null text being the empty one. While these
    lists are few no text is shuffled. Of rows that share a name, the first by their columns as JSON stays.
    """
    gone, repeated = (staged(x.toDF("__id", "__h").distinct(), n) for x, n in ((gone, "gone"), (repeated, "repeated")))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])  # in one column, so that no name can clash
    named = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"), text_key(text(F.coalesce(docs[text_col], F.lit("")))).alias("h"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    if repeated.isEmpty():
        return named.join(few(gone), same, "left_anti").select("row.*")
    repeated = few(repeated)
    once = named.join(repeated, same, "left_semi").groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return named.join(few(gone.unionAll(repeated)), same, "left_anti").select("row").unionAll(once.select("row")).select("row.*")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


#: What Python workers remember between tasks: name and how to forget it. Tasks that do not use it drop it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def remembered(name: str, most: int = 4) -> Callable:
    """A function's last results stay known until a Python worker runs tasks that do not use `name`."""

    def around(f: Callable) -> Callable:
        kept = lru_cache(maxsize=most)(f)

        @wraps(f)
        def get(*args):
            REMEMBERED.setdefault(f"{name} {f.__name__}", kept.cache_clear)
            return kept(*args)

        return get

    return around


#: Of glibc: from this size on memory is mapped by itself.
M_MMAP_THRESHOLD = -3


def give_back() -> None:
    """Returns what a Python worker has freed to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def forget(but: str = "") -> None:
    """What other kinds of tasks remember goes; arrays of a megabyte or more go back to the system as soon as they are freed."""
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, 1 << 20)
    stale = [k for k in REMEMBERED if k.split()[0] != but]
    for k in stale:
        REMEMBERED.pop(k)()
    if stale:
        give_back()


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, cut: int = 1 << 23, uses: str = "") -> DataFrame:
    """mapInArrow over batches that hold about `cut` bytes at most (a single row may be larger).

    uses: what f wants its Python worker to remember from earlier tasks; all else is forgotten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(uses)
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * cut / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                out = f(batch.slice(at, step))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back()

    return df.mapInArrow(run, schema)
