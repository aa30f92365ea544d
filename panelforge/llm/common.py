"""What the training-data operators share: table access, lineage cuts, connected components."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set, a temporary one serves a local master alone; a cluster whose machines share none is an error.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs a re-read, not the work before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that later steps read the columns and blocks they need alone."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no table reads any more, wherever it is stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to; used to size groups, never to drop any."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def constant(values: object, kind: str) -> Column:
    """A nested literal of bounded size (folded once by the optimiser)."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def drawn(share: float, hashed: Column) -> Column:
    """Whether a row with this 64-bit hash is among a share of all: all bits count, so a share may be as small as it likes."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * (1 << 64)) - (1 << 63))


def drawn_texts(docs: DataFrame, text_col: str, target: int, salt: str, by: str | None = None, most_values: int = 1_000) -> DataFrame:
    """About ``target`` distinct texts, chosen by their hash: rows ``(text)``, or with ``by`` ``(by, text)`` and the target for each of its values.

    Copies count once, both in the share and in the draw, so a text that a third of all rows hold is one draw at most and the
    sample is bounded whatever the table's size and skew. Null texts (and null values of ``by``) are left out; of ``by`` the ``most_values`` values with
    the most texts are drawn. Distinct texts are estimated to some hundredths, in one pass with partial sums.
    """
    keys = [F.col(by).alias("by")] if by else []
    rows = docs.select(*keys, F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.col("by").isNotNull() if by else F.lit(True)))
    hashed = F.xxhash64("text", F.lit(salt))
    sizes = rows.groupBy(*(["by"] if by else [])).agg(F.approx_count_distinct(F.xxhash64("text"), 0.03).alias("n"))
    if not by:
        return rows.where(drawn(target / max(1, sizes.first()["n"]), hashed)).distinct()
    found = sizes.orderBy(F.desc("n"), "by").limit(most_values).collect()
    below = {x["by"]: min((1 << 63) - 1, int(target / max(1, x["n"]) * (1 << 64)) - (1 << 63)) for x in found}
    limit = F.element_at(constant(below, "map<string, bigint>"), F.col("by").cast("string"))
    return rows.where(F.coalesce(hashed <= limit, F.lit(False))).distinct().withColumnRenamed("by", by)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column's UTF-8 bytes; ill-formed strings cannot fail here."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def as_text(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column with null as empty and ill-formed bytes replaced."""
    return ["" if x is None else x.decode("utf-8", "replace") for x in as_bytes(batch, column)]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``: bounds a worker's memory for long texts."""
    for batch in batches:
        start, held = 0, 0
        for i, x in enumerate(batch.column(column)):
            n = 0 if not x.is_valid else x.as_buffer().size
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(node, label)``, label the smallest node reachable.

    Hooking plus pointer jumping on DataFrames: each round, a node and its present root take the smallest label among
    the node's neighbours, then labels jump to their label's label; rounds grow with the logarithm of a component's
    diameter. Every round is checkpointed. Minimums are pre-aggregated, so that a label which a third of all nodes
    share meets no single task; look-ups by label are joins that adaptive execution may split. Null ends are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(links.union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    for _ in range(rounds):
        near = (
            both.join(labels.toDF("other", "near"), "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
            .join(labels, "node")
            .select("node", "label", F.least("near", "label").alias("near"))
        )
        near = cut(near)
        roots = near.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        hooked = near.join(roots, "node", "left").select("node", "label", F.least("near", "hook").alias("next"))
        up = hooked.select(F.col("node").alias("next"), F.col("next").alias("top"))
        after = cut(hooked.join(up, "next").select("node", "label", F.least("next", "top").alias("next")))
        changed = after.where("label <> next").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
