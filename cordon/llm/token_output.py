"""Packed token matrices: rows of padded ids, cumulative segment lengths and position resets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.llm.common import written
from cordon.llm.packing import CAPACITY, END_ID, cut, id_type, placed

PAD_ID = 0


def padded_length(used: int, capacity: int) -> int:
    """Rows are padded to the capacity; a row whose length is a power of two stays as it is."""
    return used if used & (used - 1) == 0 else capacity


def matrices(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence: sequence_id, n_tokens, n_segments, input_ids and position_ids
    (binary, little-endian unsigned 32-bit, padded), cu_seqlens (from 0 to n_tokens), doc_ids, starts.

    Positions restart at 0 with each segment; padding has position 0. Documents are split
    without loss: doc_ids and starts say where each segment belongs. Null and empty texts are
    a segment of the end id alone; repeated rows are segments of their own; an empty table
    gives no rows; other columns are ignored. A sequence has at most `capacity` ids, so that
    its group is bounded.
    """
    # Texts are encoded once; ids are kept compressed, each piece under a number that the written table gives it.
    pieces = written(cut(docs, path, capacity, end_id, id_col, text_col, True).withColumn("piece_row", F.monotonically_increasing_id()), "token-pieces")
    places = placed(pieces.drop("ids"), capacity).select("piece_row", "sequence_id", "offset")
    # a place takes some 20 bytes to a piece's thousands, so a partition's places fit in memory wherever its ids do
    segments = pieces.select("piece_row", F.col(id_col).alias("doc"), "start", "ids").join(places.hint("shuffle_hash"), "piece_row")
    rows = segments.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc", "start", "ids"))).alias("s"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"sequence_id long, n_tokens long, n_segments long, cu_seqlens array<int>, input_ids binary, position_ids binary, doc_ids array<{kind}>, starts array<long>"

    def run(batches):
        narrow, plain = np.dtype(id_type(path, end_id)), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                segments = part.column(1)
                bounds = segments.offsets.to_numpy()
                flat = segments.values.slice(bounds[0], bounds[-1] - bounds[0])
                data, docs_, starts = [plain(x) for x in flat.field("ids").to_pylist()], flat.field("doc"), flat.field("start")
                bounds = bounds - bounds[0]
                used, many, cuts, matrix, restarts = [], [], [], [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    lengths = np.fromiter(map(len, data[a:b]), np.int64, b - a) // narrow.itemsize
                    ends = np.r_[0, np.cumsum(lengths)]
                    n = int(ends[-1])
                    wide = padded_length(n, capacity)
                    ids, positions = np.full(wide, pad_id, "<u4"), np.zeros(wide, "<u4")
                    ids[:n] = np.frombuffer(b"".join(data[a:b]), narrow)
                    positions[:n] = np.arange(n) - np.repeat(ends[:-1], lengths)
                    used.append(n)
                    many.append(int(b - a))
                    cuts.append(ends.astype(np.int32))
                    matrix.append(ids.tobytes())
                    restarts.append(positions.tobytes())
                lists = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(used, pa.int64()), pa.array(many, pa.int64()), pa.array(cuts, pa.list_(pa.int32())), pa.array(matrix, pa.binary()), pa.array(restarts, pa.binary()), pa.ListArray.from_arrays(lists, docs_), pa.ListArray.from_arrays(lists, starts)],
                    ["sequence_id", "n_tokens", "n_segments", "cu_seqlens", "input_ids", "position_ids", "doc_ids", "starts"],
                )

    return rows.select("sequence_id", "s").mapInArrow(run, schema)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes the matrices as Parquet files, rows in sequence order within a file."""
    packed.sortWithinPartitions("sequence_id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """The matrices with checksums in place of their two binary columns."""
    crc = lambda c: F.crc32(c).alias(f"{c}_crc32")
    return packed.select("sequence_id", "n_tokens", "n_segments", (F.octet_length("input_ids") / 4).cast("long").alias("padded_to"), "cu_seqlens", crc("input_ids"), crc("position_ids"), "doc_ids", "starts")
