"""Token-ID / binary output: documents as blocks of range-coded token ids, and their reader.

``write`` tokenizes whole texts in ascending ``doc_id`` order (null first; equal ids by text), appends the
end id to each, and writes a folder: ``table`` (one row: the frequency table that all blocks share) and
``blocks`` (a row per block: shard, number, first token within the shard, counts and the coded bytes of
:mod:`gleaner.llm.rans` behind a compressed document index).  Blocks are rows of a table that Spark commits,
so retried tasks leave no partial or double files, in any store that Spark writes to.  ``read`` decodes the
blocks in parallel.  Token counts for the table come from all documents.

Edge cases: a null text is an empty one and holds the end id alone; null and repeated ``doc_id`` stay rows
of their own; an empty table gives no blocks; extra columns are ignored; a document longer than a block
makes one larger block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import rans
from gleaner.llm.common import chunks, forget, new_path, written
from gleaner.llm.tokens import coder as coder_of

TOKENIZER, END_ID = "word_bpe_49k.json", 1
BLOCK_TOKENS = 1 << 20
#: Characters that are tokenized at once.
TEXT_CHARS = 2_000_000

_RAW = "shard int, block long, first_token long, n_docs long, n_tokens long, docs binary, ids binary"
_CODED = "shard int, block long, first_token long, n_docs long, n_tokens long, payload binary"


def _doc_index(ids: list[int], null: list[bool], lengths: np.ndarray) -> bytes:
    return zlib.compress(np.array(null, np.uint8).tobytes() + np.array(ids, "<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)


def _read_index(data: bytes, n: int) -> tuple[list, np.ndarray]:
    raw = zlib.decompress(data)
    null, keys = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n)
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)


def _raw_blocks(tokenizer: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(tokenizer)
        shard, block, first = 0, 0, 0
        ids, docs, null, lens, held = [], [], [], [], 0
        counts = np.zeros(0, np.int64)

        def flush():
            nonlocal ids, docs, null, lens, held, block, first, counts
            flat, n = np.concatenate(ids), np.concatenate(lens)
            own = np.bincount(flat, minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
            row = (shard, block, first, len(docs), held, _doc_index(docs, null, n), flat.astype("<u4" if flat.max(initial=0) > 65535 else "<u2").tobytes())
            block, first = block + 1, first + held
            ids, docs, null, lens, held = [], [], [], [], 0
            return pd.DataFrame([row], columns=["shard", "block", "first_token", "n_docs", "n_tokens", "docs", "ids"])

        for pdf in batches:
            if len(pdf):
                shard = int(pdf["shard"].iloc[0])
            rows = zip(pdf["doc_id"], pdf["no_id"], pdf["text"], strict=True)
            for part in chunks(rows, lambda r: len(r[2] or ""), TEXT_CHARS):
                flat, n = coder.encode([t for *_, t in part])
                ends = np.cumsum(n)
                flat, n = np.insert(flat, ends, end_id), n + 1
                ids.append(flat)
                docs += [d for d, *_ in part]
                null += [z for _, z, _ in part]
                lens.append(n)
                held += len(flat)
                if held >= block_tokens:
                    yield flush()
        if docs:
            yield flush()
        coder.rest()
        if len(counts):  # the task's token counts, as a block of number -1
            yield pd.DataFrame([(shard, -1, 0, 0, 0, b"", zlib.compress(counts.tobytes(), 1))], columns=["shard", "block", "first_token", "n_docs", "n_tokens", "docs", "ids"])

    return run


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for pdf in batches:
        for data in pdf["ids"]:
            c = np.frombuffer(zlib.decompress(data), "<i8").copy()
            short, long = sorted((c, total), key=len)
            long[: len(short)] += short
            total = long
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"token": seen, "n": total[seen]})


def _coder(freq: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = rans.Table.of_freq(np.frombuffer(freq, "<u8"))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                body = struct.pack("<2I", len(r.docs), zlib.crc32(r.docs)) + r.docs + rans.encode(_ids(r.ids, r.n_tokens), shared)
                yield pd.DataFrame([(r.shard, r.block, r.first_token, r.n_docs, r.n_tokens, body)], columns=["shard", "block", "first_token", "n_docs", "n_tokens", "payload"])

    return run


def write(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> str:
    """Write ``docs`` (doc_id, text) to the folder ``path`` (a fresh one in the shared folder by default); returns the path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-blocks")
    order = ["doc_id", "tie", "text"]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    # Equal ids are parted by the text's hash, so that one id can't fill a task.
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions(*order).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text", F.spark_partition_id().alias("shard"))
    raw = written(dealt.mapInPandas(_raw_blocks(tokenizer, end_id, block_tokens), _RAW), "token-ids", **{"parquet.enable.dictionary": "false"})
    counted = raw.filter("block < 0").select("ids").mapInPandas(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = counted.toPandas()  # at most the tokenizer's vocabulary
    counts = np.zeros(int(seen["token"].max()) + 1 if len(seen) else 1, np.int64)
    counts[seen["token"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    freq = rans.Table.of_counts(counts).freq.astype("<u8").tobytes()
    spark.createDataFrame([(end_id, rans.SCALE_BITS, bytearray(freq))], "end_id long, scale_bits int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    raw.filter("block >= 0").mapInPandas(_coder(freq), _CODED).write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(f"{path}/blocks")
    forget(raw)
    return path


def _decoder(freq: bytes, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = rans.Table.of_freq(np.frombuffer(freq, "<u8"))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                size, crc = struct.unpack_from("<2I", r.payload)
                index = r.payload[8 : 8 + size]
                if zlib.crc32(index) != crc:
                    raise ValueError(f"the document index of shard {r.shard}, block {r.block} is damaged")
                docs, lens = _read_index(index, r.n_docs)
                ids = rans.decode(r.payload[8 + size :], shared)
                ends = np.cumsum(lens)
                starts = ends - lens
                flat = ids.astype("<u4")
                out = {
                    "doc_id": pd.Series(docs, dtype="Int64"),
                    "start": starts + r.first_token + r.base,
                    "n_tokens": lens,
                    "ids_crc32": [zlib.crc32(flat[a:b]) for a, b in zip(starts, ends, strict=True)],
                }
                if keep_ids:
                    out["ids"] = [flat[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame(out)

    return run


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Decode a folder of ``write``: doc_id, start, n_tokens, ids_crc32, and the ids themselves on request."""
    head = spark.read.parquet(f"{path}/table").select("freq").head()
    blocks = spark.read.parquet(f"{path}/blocks")
    # A row per shard, and there are as many shards as tasks wrote.
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toPandas()
    base = spark.createDataFrame(pd.DataFrame({"shard": sizes["shard"].astype("int32"), "base": (sizes["n"].cumsum() - sizes["n"]).astype("int64")}), "shard int, base long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return blocks.join(F.broadcast(base), "shard").mapInPandas(_decoder(bytes(head["freq"]), keep_ids), schema)
