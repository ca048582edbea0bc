"""Operator 3: token ids in a block file format of compressed bit or byte planes.

A block holds up to ``block_ids`` unsigned 32-bit ids. Its planes (four byte planes, or 32 bit planes) are compressed
one by one with zstandard; a plane of zeros takes no bytes. Each block row carries its chunk index: where each plane
lies in the payload, the position of its first id in the part, and which documents' ids it holds from where to where.
Parts are written in ascending order of ``doc_id`` (equal ids by text, null ids first) as one Parquet table in the
shared folder, so any store that Spark reaches can hold them; blocks decode independently of each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import encode, spans, store

BLOCKS = (
    "part int, block long, first_id long, n_ids int, plane_bytes array<int>, payload binary, "
    "row_no array<long>, row_from array<long>, row_to array<long>, doc_id array<long>"
)


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> tuple[list[int], bytes]:
    """Sizes of the compressed planes, and the planes one after the other."""
    import zstandard

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0)
    press = zstandard.ZstdCompressor(level=level)
    planes = [press.compress(p.tobytes()) if p.any() else b"" for p in np.ascontiguousarray(raw.T)]
    return [len(p) for p in planes], b"".join(planes)


def from_planes(n: int, sizes: list[int], payload: bytes) -> np.ndarray:
    """The ids of a block; 32 sizes mean bit planes, 4 mean byte planes."""
    import zstandard

    rows = n if len(sizes) == 4 else -(-n // 8)
    open_, at, planes = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        raw = open_.decompress(payload[at : at + size]) if size else bytes(rows)
        planes.append(np.frombuffer(raw, dtype=np.uint8))
        at += size
    raw = np.stack(planes, axis=1)
    if len(sizes) == 32:
        raw = np.packbits(np.unpackbits(raw, axis=0, count=n), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def write_blocks(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 16, bits: bool = False
) -> None:
    """Encodes every text (null: empty), appends ``end_id`` and writes the blocks of all documents to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encode.shared(tokenizer), TaskContext.get().partitionId()
        held, held_n, base, block, row = [], 0, 0, 0, 0
        seen: list[tuple[int, int, int, int | None]] = []  # row, first and last id in the part, doc_id

        def flush(n: int):
            nonlocal held, held_n, base, block, seen
            ids = np.concatenate(held) if len(held) != 1 else held[0]
            sizes, payload = to_planes(ids[:n], bits)
            here = [s for s in seen if s[1] < base + n]
            out = {
                "part": part, "block": block, "first_id": base, "n_ids": n, "plane_bytes": sizes, "payload": payload,
                "row_no": [s[0] for s in here],
                "row_from": [max(s[1] - base, 0) for s in here], "row_to": [min(s[2] - base, n) for s in here],
                "doc_id": [s[3] for s in here],
            }
            seen = [s for s in seen if s[2] > base + n]
            held, held_n, base, block = [ids[n:]], held_n - n, base + n, block + 1
            return pa.RecordBatch.from_pylist([out], schema=schema)

        for batch in spans.slices(batches, "text"):
            ids, sizes = coder.batch(batch["text"])
            to = np.cumsum(sizes)
            ids = np.insert(ids, to, np.uint32(end_id))
            sizes = sizes + 1
            at = base + held_n + np.cumsum(sizes) - sizes
            for k, (a, n, d) in enumerate(zip(at.tolist(), sizes.tolist(), batch["doc_id"].to_pylist(), strict=True)):
                seen.append((row + k, a, a + n, d))
            row += batch.num_rows
            held.append(ids)
            held_n += len(ids)
            while held_n >= block_ids:
                yield flush(block_ids)
        if held_n:
            yield flush(held_n)

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types |= {f"array<{k}>": pa.list_(v) for k, v in types.items()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split(" ") for c in BLOCKS.split(", "))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal ids are told apart by a hash of their text, so that a hot id is dealt to several parts
    ordered = rows.withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(path)


def crc_shift(n: int) -> list[int]:
    """What n zero bytes do to a CRC-32, as the images of its 32 bits (squaring the map of one zero bit)."""

    def times(m, v):
        total = 0
        for k in range(32):
            if v >> k & 1:
                total ^= m[k]
        return total

    step = [0xEDB88320] + [1 << k for k in range(31)]
    out, n = [1 << k for k in range(32)], 8 * n
    while n:
        if n & 1:
            out = [times(step, v) for v in out]
        step = [times(step, v) for v in step]
        n >>= 1
    return out


def crc_join(crcs: list[int], sizes: list[int]) -> int:
    """CRC-32 of consecutive byte strings, by their CRCs and sizes."""
    total = crcs[0]
    for crc, n in zip(crcs[1:], sizes[1:], strict=True):
        shifted = 0
        for k, image in enumerate(crc_shift(n)):
            if total >> k & 1:
                shifted ^= image
        total = shifted ^ crc
    return total


def read_pieces(blocks: DataFrame) -> DataFrame:
    """Decodes blocks; a row for each document and block: where its ids begin in the part, their number and CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                raw = from_planes(b["n_ids"], b["plane_bytes"], b["payload"]).tobytes()
                span = list(zip(b["row_from"], b["row_to"], strict=True))
                n = len(span)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b["part"]] * n, pa.int32()),
                        pa.array(b["row_no"], pa.int64()),
                        pa.array(b["doc_id"], pa.int64()),
                        pa.array([b["first_id"] + a for a, _ in span], pa.int64()),
                        pa.array([z - a for a, z in span], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in span], pa.int64()),
                    ],
                    names=["part", "row_no", "doc_id", "at", "n", "crc"],
                )

    return blocks.mapInArrow(run, "part int, row_no long, doc_id long, at long, n long, crc long")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the blocks: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    A row for each row written, repeated ids too. Documents that span several blocks are joined by the CRCs of
    their pieces. The starts of parts are running sums over one row per part.
    """
    from pyspark.sql import Window

    blocks = spark.read.parquet(path)
    pieces = read_pieces(blocks)
    docs = pieces.groupBy("part", "row_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("p"),
    )
    docs = docs.select(
        "part",
        "doc_id",
        F.col("p")[0]["at"].alias("at"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"),
        F.when(F.size("p") == 1, F.col("p")[0]["crc"])
        .otherwise(_joined(F.col("p")["crc"], F.transform("p", lambda x: x["n"] * 4)))
        .alias("ids_crc32"),
    )
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return docs.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _joined(crcs, sizes):
    @F.udf("long")
    def join(c, n):
        return crc_join(c, n)

    return join(crcs, sizes)


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's ids written in blocks and read back."""
    import public_tokenizers

    path = store.folder(spark, "id-blocks")
    write_blocks(store.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return document_digests(spark, path)
