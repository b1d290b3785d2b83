"""Token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, sorted within them, encoded, and written by Spark's ORC writer
as arrays of integers, so a folder of files in ascending doc_id order, each cut into stripes that are
read in parallel. The row indexes (minima and maxima every ``orc.row.index.stride`` rows) and the Bloom
filters let a reader skip stripes and row groups for a doc_id (``lookup``). Beside the ids a row holds
its part and its offset within the part; the parts' totals, one row a file, give the global start.

Pre-tokens are encoded once per worker while they are remembered. A text with a special token's string in
it goes to the library whole, which gives it the special token's id.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows that share a
doc_id, null too, keep the order they are read in and may be cut into several ranges; an empty table gives an empty folder and result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import batched
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import id_and_text, new_path, partitions_for, table
from .memo import Memo

END_ID = 1
#: Pre-tokens of a generation that a Python worker keeps; two take about 260 MB.
MEMO_WORDS = 600_000
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}
SCHEMA = "doc_id long, part int, first long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes by the tokenizers library, each pre-token once as long as it is remembered.

    A text of Latin-1 letters, ASCII white space and visible signs is lower-cased and cut here as the
    library would; any other text is cut at spaces and line feeds only, which is safe whatever it holds.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # strings that the library finds in a text before it cuts it; they are never longer than a few characters
        self.added = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.anywhere = re.compile("|".join(map(re.escape, self.added)), re.IGNORECASE) if self.added else None
        self.plain = _is_plain(definition)
        self.memo = Memo(self.learn, MEMO_WORDS)

    def cut(self, text: str) -> list[str]:
        if self.plain:
            try:
                if not text.encode("latin-1").translate(None, PLAIN_BYTES):
                    return PLAIN_CUT.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.anywhere and self.anywhere.search(text):
            return self.whole([text])[0]
        return self.memo.join(self.cut(text))

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as the library finds them, special tokens' strings as special tokens."""
        return [pack(f"<{len(ids := e.ids)}I", *ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        out = {}
        if self.plain:  # one pre-token each: the library's model alone, on its letters for bytes
            model, letters = self.tokenizer.model, BYTE_LETTERS
            for p in filter(_is_single, parts):
                found = model.tokenize(p if p.isascii() else "".join(map(letters.__getitem__, p.encode())))
                out[p] = pack(f"<{len(found)}I", *[t.id for t in found])
        for some in batched(parts - out.keys(), 10_000):
            out |= dict(zip(some, self.whole(list(some)), strict=True))
        return out


#: Latin-1 without control characters and the spaces beyond ASCII, whose classes libraries disagree on.
PLAIN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x100)])
#: The definition's own pattern on lower-cased plain texts.
PLAIN_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
#: The letters that byte-level models write for bytes: visible Latin-1 as itself, the rest from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = [chr(b) if b in _SEEN else chr(256 + sum(c not in _SEEN for c in range(b))) for b in range(256)]
#: The steps of a definition that PLAIN_CUT stands for.
PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _is_single(part: str) -> bool:
    """Whether a part is one pre-token of a plain text, already lower-cased."""
    try:
        plain = not part.encode("latin-1").translate(None, PLAIN_BYTES)
    except UnicodeEncodeError:
        return False
    return plain and part == part.lower() and PLAIN_CUT.fullmatch(part) is not None


def _is_plain(definition: str) -> bool:
    d = json.loads(definition)
    steps, cuts = ((d.get(k) or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    return [x["type"] for x in steps] == PLAIN_NORMALIZERS and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"].get("Regex") == PLAIN_PATTERN


_MADE: dict[int, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    """One encoder a Python worker, kept over its tasks."""
    key = hash(definition)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = WordEncoder(definition)
    return _MADE[key]


def write(df: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``df`` and write the ORC folder ``path``."""
    spark = df.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # under 2 MB, whatever the data
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = _encoder(definition.value), 0
        for b in batches:
            for lo in range(0, len(b), 256):
                some = b.slice(lo, 256)
                raw = [coder.encode(t.as_py()) + end for t in some.column(2)]
                n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                starts = first + np.cumsum(n) - n
                first += int(n.sum())
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(0), pa.array(starts), ids], ["doc_id", "part", "first", "ids"])

    # the row number cuts ids that very many rows share
    docs = id_and_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    docs = docs.repartitionByRange(partitions_for(df), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, SCHEMA)
    rows.write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document, from the files alone."""
    rows = spark.read.schema(SCHEMA).orc(path)
    size = F.size("ids").cast("long")
    totals = rows.groupBy("part").agg(F.max(F.col("first") + size).alias("total"))  # one row a file
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    # one row of two numbers for each file of 256 MB of input and more: some MB for 100 TB
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of some documents; row indexes and Bloom filters prune what is read."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            crc = [zlib.crc32(flat[x:y].astype("<i4", copy=False).data) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    write(table(spark, sf_dir, "documents"), path)
    return digest(read(spark, path))
