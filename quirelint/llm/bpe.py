"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts over ``chunk`` code points are cut into chunks that overlap by ``overlap``; the chunks
are pre-tokenised as rows of their own. Where the boundaries that two neighbours find in their
overlap meet for the first time, at a boundary after a character that isn't white space, both
scans agree from there on (a match depends on nothing before it), so the text is cut there.
The pieces between cuts are encoded in parallel and put together in order. A text with two
neighbours that never meet (one endless run) is encoded whole. Decoding joins the tokens' bytes.

Null texts count as empty and give no ids; repeated rows are encoded one by one; other columns are not read; an empty table gives
an empty one.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, type_of

CHUNK, OVERLAP = 1 << 16, 1 << 11


@functools.lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    enc = encoding(path, pattern)
    try:
        ids = enc.encode_ordinary(text)
    except BaseException as error:  # the library's pattern engine gives up on very long runs
        if type(error).__name__ != "PanicException":
            raise
        ids = [i for m in regex.finditer(pattern, text) for i in enc.encode_single_piece(m[0].encode())]
    return np.array(ids, "<u4").tobytes()


def _encoder(path: str, pattern: str, keys: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                ids = [encode_text(x or "", path, pattern) for x in texts[at : at + 256]]
                cols = [batch.column(k).slice(at, len(ids)) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], [*keys, "ids"])

    return run


def boundaries(chunk: str, pattern: str, start: int, last: bool) -> list[int]:
    """Ends of matches after a character that isn't white space, in the whole text's positions.

    A match that touches the chunk's end may go on beyond it, and one before it may depend on what follows.
    """
    ends = [m.end() for m in regex.finditer(pattern, chunk)]
    return [start + e for e in (ends if last else ends[:-2]) if not chunk[e - 1].isspace()]


def _scanner(pattern: str, stride: int, overlap: int):
    def run(batches):
        for batch in batches:
            heads, tails = [], []
            for start, text, last in zip(*(batch.column(c).to_pylist() for c in ("start", "text", "last")), strict=True):
                found = boundaries(text, pattern, start, last)
                heads.append([x for x in found if x <= start + overlap])
                tails.append([x for x in found if x > start + stride])
            cols = [batch.column(c) for c in ("row", "start", "last")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["row", "start", "last", "head", "tail"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids): ids is binary, unsigned 32-bit little-endian."""
    kind, stride = type_of(docs, id_col), chunk - overlap
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    short = arrow_map(rows.where(~is_long), _encoder(path, pattern, ["id"]), f"id {kind}, ids binary")

    long = rows.where(is_long).withColumn("row", F.struct("id", F.xxhash64("text").alias("h"), F.length("text").alias("n")))
    # equal rows would meet in the stitching: each is worked once and counted
    long = long.groupBy("row").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)).cast("int"), F.lit(stride))
    chunks = long.select("row", "text", F.explode(starts).alias("start"))
    chunks = chunks.select("row", F.col("start").cast("long"), F.col("text").substr(F.col("start") + 1, F.lit(chunk)).alias("text"), (F.col("start") + chunk >= F.length("text")).alias("last"))
    scanned = arrow_map(chunks.repartition("row", "start"), _scanner(pattern, stride, overlap), f"row struct<id:{kind},h:bigint,n:int>, start bigint, last boolean, head array<bigint>, tail array<bigint>")
    after = scanned.select("row", (F.col("start") - stride).alias("start"), F.col("head").alias("next"))
    met = scanned.join(after, ["row", "start"], "left").select("row", "last", F.array_min(F.array_intersect("tail", "next")).alias("cut"))
    cuts = met.groupBy("row").agg(F.max((~F.col("last") & F.col("cut").isNull())).alias("unmet"), F.array_sort(F.collect_set("cut")).alias("cuts"))
    cuts = cuts.select("row", F.when(F.col("unmet"), F.array().cast("array<bigint>")).otherwise(F.col("cuts")).alias("cuts"))
    froms = F.concat(F.array(F.lit(0).cast("bigint")), "cuts")
    tos = F.concat("cuts", F.array(F.col("row.n").cast("bigint")))
    pieces = long.join(cuts, "row").select("row", "copies", "text", F.posexplode(F.arrays_zip(froms.alias("a"), tos.alias("b"))).alias("k", "span"))
    pieces = pieces.select("row", "copies", "k", F.col("text").substr((F.col("span.a") + 1).cast("int"), (F.col("span.b") - F.col("span.a")).cast("int")).alias("text"))
    coded = arrow_map(pieces.repartition("row", "k"), _encoder(path, pattern, ["row", "copies", "k"]), f"row struct<id:{kind},h:bigint,n:int>, copies bigint, k int, ids binary")
    whole = coded.groupBy("row", "copies").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"))
    whole = whole.select(F.col("row.id").alias("id"), F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["ids"])), "")).alias("ids"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return short.unionByName(whole.select("id", "ids")).withColumnRenamed("id", id_col)


def _decoder(path: str, pattern: str, id_col: str):
    def run(batches):
        for batch in batches:
            enc, ids = encoding(path, pattern), batch.column("ids")
            for at in range(0, len(ids), 256):
                texts = [enc.decode_bytes(np.frombuffer(x.as_buffer(), "<u4").tolist()) for x in ids.slice(at, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(at, 256), ids.slice(at, 256), pa.array(texts, pa.binary())], [id_col, "ids", "bytes"])

    return run


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, bytes): the tokens' bytes joined."""
    return arrow_map(coded.select(id_col, "ids"), _decoder(path, pattern, id_col), f"{id_col} {type_of(coded, id_col)}, ids binary, bytes binary")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digest(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, by name, ``ids`` or ``bytes``."""
    path, pattern = public_vocabulary()
    out = decode(encode(docs, path, pattern), path, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), *more)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
