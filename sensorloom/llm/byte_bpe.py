"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: the vocabulary's byte strings lie in the slots of a minimal perfect hash; a batch's distinct
pre-tokens are hashed together, and those whose slot holds the same bytes are done. Tier two: a miss is
merged over a doubly linked list of its bytes with a heap of (rank, position), so each merge costs
O(log n) however long the pre-token. Pre-tokens are the matches of the published pattern;
the results for those met before are kept in each worker, two generations of up to ``MEMO_PIECES``.

Defined results: null and empty texts have no ids and decode to the empty string; lone surrogates can't
occur in Spark's strings; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_and_text, table
from .memo import Memo
from .mph import MinimalPerfectHash, fold_bytes

#: Pre-tokens of a generation that a Python worker keeps; two take about 140 MB.
MEMO_PIECES = 300_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        ranks = dict(line.split() for line in lines.splitlines() if line)
        words = [base64.b64decode(w) for w in ranks]
        ids = np.array(list(map(int, ranks.values())), np.int64)
        self.pattern = regex.compile(pattern)
        self.hash = MinimalPerfectHash(fold_bytes(words))
        at = self.hash.lookup(fold_bytes(words))
        self.slot_word: list[bytes] = [b""] * len(words)
        self.slot_id = np.zeros(len(words), np.int64)
        self.slot_id[at] = ids
        for s, w in zip(at.tolist(), words, strict=True):
            self.slot_word[s] = w
        self.bytes_of = [b""] * (int(ids.max()) + 1)
        for i, w in zip(ids.tolist(), words, strict=True):
            self.bytes_of[i] = w
        self.rank = {w: i for w, i in zip(words, ids.tolist(), strict=True)}
        self.memo = Memo(self.learn, MEMO_PIECES)

    def whole(self, tokens: list[bytes]) -> list[int]:
        """The ids of tokens that are in the vocabulary as a whole, else -1."""
        at = self.hash.lookup(fold_bytes(tokens)).tolist()
        words, ids = self.slot_word, self.slot_id
        return [int(ids[s]) if s >= 0 and words[s] == t else -1 for s, t in zip(at, tokens, strict=True)]

    def merge(self, token: bytes) -> bytes:
        """The ids of a token that isn't in the vocabulary: lowest rank first, leftmost of equals."""
        n, rank = len(token), self.rank
        part: list[bytes | None] = [token[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i] += part[j]
            part[j] = None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get(both := part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if (h := left[i]) >= 0 and (r := rank.get(both := part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(both)))
        return np.array([rank[p] for p in part if p is not None], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each pre-token, all looked up together; the misses merged."""
        tokens = [p.encode() for p in pieces]
        ids = self.whole(tokens)
        return {p: i.to_bytes(4, "little") if i >= 0 else self.merge(t) for p, t, i in zip(pieces, tokens, ids, strict=True)}

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.memo.join(self.pattern.findall(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_MADE: dict[tuple[int, str], ByteBpe] = {}


def _coder(lines: bytes, pattern: str) -> ByteBpe:
    """One coder a Python worker, kept over its tasks."""
    key = hash(lines), pattern
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = ByteBpe(lines, pattern)
    return _MADE[key]


def encode(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row. ``ids`` is an array of ints.

    The rank file (under 1 MB) is read on the driver and broadcast: its size doesn't depend on the data.
    """
    with open(ranks_path or default_ranks(), "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(lines.value, pattern)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                n, sha, back, kept = [], [], [], []
                for text in part.column(1):
                    raw = coder.encode(text.as_py())
                    n.append(len(raw) // 4)
                    sha.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(coder.decode(np.frombuffer(raw, "<u4").tolist())).hexdigest())
                    if with_ids:
                        kept.append(raw)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = np.frombuffer(b"".join(kept), "<i4")
                    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with a further column ``text``, decoded from an array of ids; bytes that are no UTF-8 become U+FFFD, null stays null."""
    with open(ranks_path or default_ranks(), "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(ids):
        coder = _coder(lines.value, default_pattern())
        return ids.map(lambda x: None if x is None else coder.decode(x).decode("utf-8", "replace"))

    return df.withColumn("text", text(F.col(ids_col)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
