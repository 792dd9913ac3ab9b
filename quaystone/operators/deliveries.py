"""One copy of every message that was delivered at least once.

Only the identifier, the delivery order and the position of the row in its file
are shuffled. The rows that lose become bitmaps, one per file and run of 32,768
rows, and those bitmaps are applied while the wide payload is scanned, so the
payload itself never moves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.mailids import message_key, path_key
from quaystone.session import cut, shared_dir

#: Deletion vectors are broadcast up to this many bytes, beyond it they are read from the shared folder file by file.
BROADCAST_BYTES = 32 << 20
_VECTOR_BYTES = 4096 + 64


def with_position(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(_payload, _file, _row): the named columns as one struct, a hash of the path of the file, and the row in it.

    What isn't a scan of files has no positions and is written to the shared folder first.
    """
    place = [F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row")]
    payload = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_payload")
    try:
        return rows.select(payload, *place)
    except AnalysisException:
        return cut(rows).select(payload, *place)


def surplus_positions(placed: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """(_file, _row) of every row that another row with its key precedes.

    Rows whose key is null are never surplus. Nulls in the order come last, and
    equal rows are told apart by their position, so exactly one row of a key stays.
    A key that holds a third of all rows is combined before the shuffle, and its rows
    meet a single winner in a join that adaptive execution splits.
    """
    rank = F.struct(*[F.struct(o.isNull().alias("n"), o.alias("v")).alias(f"o{i}") for i, o in enumerate(order)], F.col("_file").alias("f"), F.col("_row").alias("r"))
    slim = placed.select(key.alias("_key"), rank.alias("_rank")).where("_key is not null")
    winners = slim.groupBy("_key").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")
    return slim.join(winners, "_key").where(F.col("_rank") > F.col("_first")).select(F.col("_rank.f").alias("_file"), F.col("_rank.r").alias("_row"))


def deletion_vectors(positions: DataFrame) -> DataFrame:
    """(_file, _bucket, _bits): a bitmap for each 32,768 rows of a file that hold a surplus row."""
    n = F.col("_row") + 1
    return positions.groupBy("_file", F.bitmap_bucket_number(n).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_bits"))


def _marked_by_join(placed: DataFrame, vectors: DataFrame) -> DataFrame:
    n = F.col("_row") + 1
    bit = F.bitmap_bit_position(n)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_row + 1) % 8 as int))")) != 0, F.lit(False))
    return placed.withColumn("_bucket", F.bitmap_bucket_number(n)).join(vectors, ["_file", "_bucket"], "left").withColumn("_surplus", hit).drop("_bucket", "_bits")


def _qualified(spark: SparkSession, where: str) -> str:
    """A path with the scheme of the file system that Spark writes it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def _store(uri: str):
    """(file system, path) by which Python reads what Spark wrote under a qualified path."""
    import pyarrow.fs as fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def _readable(uri: str, files: int) -> bool:
    """Whether Python sees as many files' vectors under a folder as Spark wrote."""
    import pyarrow.fs as fs

    try:
        store, root = _store(uri)
        return sum("_file=" in x.path for x in store.get_file_info(fs.FileSelector(root))) == files
    except (OSError, ValueError, NotImplementedError):
        return False


def _marked_from_files(placed: DataFrame, vectors: DataFrame) -> DataFrame:
    spark = placed.sparkSession
    where = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.write.partitionBy("_file").parquet(where)
    uri = _qualified(spark, where)
    if not _readable(uri, vectors.select("_file").distinct().count()):
        return _marked_by_join(placed, vectors)

    @F.pandas_udf("boolean")
    def surplus(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        held: dict[int, dict[int, np.ndarray]] = {}
        store, root = _store(uri)
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"the deletion vectors under {uri} are gone")
        for file, row in parts:
            out = np.zeros(len(row), bool)
            for f in file.unique():
                if f not in held:
                    held.clear()
                    own: dict[int, np.ndarray] = {}
                    for x in store.get_file_info(fs.FileSelector(f"{root}/_file={f}", allow_not_found=True)):
                        if x.path.endswith(".parquet"):
                            t = pq.read_table(x.path, filesystem=store, columns=["_bucket", "_bits"], partitioning=None)
                            own |= {b: np.unpackbits(np.frombuffer(v, np.uint8), bitorder="little") for b, v in zip(t["_bucket"].to_pylist(), t["_bits"].to_pylist())}
                    held[f] = own
                mine = np.flatnonzero(file.to_numpy() == f)
                at = row.to_numpy()[mine]
                for b in np.unique(at // 32768):
                    bits = held[f].get(int(b) + 1)
                    if bits is not None:
                        here = mine[at // 32768 == b]
                        out[here] = bits[row.to_numpy()[here] % 32768] == 1
            yield pd.Series(out)

    return placed.withColumn("_surplus", surplus("_file", "_row"))


def mark(placed: DataFrame, positions: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """placed with _surplus, without a shuffle of its rows.

    Small vectors are broadcast, larger ones read from the shared folder by the tasks that scan their files. Only
    where Python can't read that folder as Spark wrote it are the rows joined with them by a shuffle.
    """
    vectors = cut(deletion_vectors(positions))
    if vectors.count() * _VECTOR_BYTES <= broadcast_bytes:
        return _marked_by_join(placed, F.broadcast(vectors))
    return _marked_from_files(placed, vectors)


def _payload_marked(messages: DataFrame, columns: list[str]) -> DataFrame:
    wanted = [c for c in dict.fromkeys([*columns, "message_id", "received_at", "delivery_id"]) if c in messages.columns]
    placed = with_position(messages, wanted)
    lost = surplus_positions(placed, message_key(F.col("_payload.message_id")), [F.col("_payload.received_at"), F.col("_payload.delivery_id")])
    return mark(placed, lost)


def deliveries_marked(messages: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of messages, whatever else it has, and _surplus.

    Of the rows with one message_id the earliest received_at stays, then the smallest
    delivery_id; a null received_at is latest. A null or blank message_id never matches.
    Rows alike in all of these are told apart by their place, so one stays. An empty table gives an empty result.
    """
    return _payload_marked(messages, columns).select(*[F.col(f"_payload.`{c}`") for c in columns], F.col("_surplus"))


def kept_messages(messages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The row of each message that stays, in full width or with the named columns; chosen as deliveries_marked says."""
    columns = columns or messages.columns
    return _payload_marked(messages, columns).where("not _surplus").select(*[F.col(f"_payload.`{c}`") for c in columns])


def surplus_rows(messages: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(src_table, row_id) of every surplus delivery and of the attachments it brought."""
    lost = cut(deliveries_marked(messages, ["delivery_id", "source_path"]).where("_surplus"))
    paths = lost.select(path_key(F.col("source_path")).alias("_path")).where("_path is not null").distinct()
    brought = occurrences.select("occ_id", path_key(F.col("message_source")).alias("_path")).where("_path is not null").join(paths, "_path", "left_semi")
    return (
        lost.select(F.lit("messages").alias("src_table"), F.col("delivery_id").cast("long").alias("row_id"))
        .unionByName(brought.select(F.lit("occurrences").alias("src_table"), F.col("occ_id").cast("long").alias("row_id")))
        .distinct()
    )
