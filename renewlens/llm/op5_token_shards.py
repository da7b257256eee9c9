"""Token-id output: one compressed wavelet matrix per shard.

Documents are range-partitioned by id, encoded in that order, and cut into shards of about
``SHARD_TOKENS`` ids. A shard is one row in a Parquet file of its own: the ids as a wavelet matrix
(one bit plane per bit of the vocabulary, zstd-compressed, each with rank counts), and beside it
the document keys and token counts. :class:`WaveletMatrix` answers access, rank, select, counting
and occurrence lookup from the stored bytes without restoring the sequence.

Encoding keeps a bounded table of white-space separated words already encoded. White space is
dropped by the tokenizer and no normalisation, piece or merge crosses it, so a text's ids are its
words' ids in a row; a text that may hold a special token's marker is encoded whole.

Defined results: null text is empty (only the end id); empty tables give no rows; equal ids are
ordered by a hash of their text; a null id comes first.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.llm.common import byte_texts, table
from renewlens.session import staging_root

SHARD_TOKENS = 1 << 21
END_ID = 2
VOCABULARY_FILE = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000
LONG_WORD = 64  # bytes up to which a word is remembered
RANK_BITS = 2048  # bits between two stored rank counts


_LETTERS_THEN_MARKS = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)\Z").match

# --- encoding ---------------------------------------------------------------------------


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet as a translation of Latin-1: printable bytes stand for themselves,
    the others, in order, for code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


class _Known(dict):
    """Words met so far and their ids, in two generations; an unknown word is encoded when asked for.

    The older generation is dropped when the younger is full, so frequent words stay. Words over
    LONG_WORD bytes are not remembered, which bounds the table in bytes too.
    """

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.half, self.older = encode, limit // 2, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts word by word with a bounded table of known words; ids as uint16 bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids over 16 bits are not supported")
        self.model_ids = self.tokenizer.model.tokenize
        self.normal = self.tokenizer.normalizer.normalize_str
        self.pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = _byte_letters()
        self.known = _Known(self._word, cache_words)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    def whole(self, text: bytes) -> bytes:
        return self._packed(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        """Ids of a word with a-z for A-Z and without a special token's marker.

        Letters of a-z, or Latin letters that normalisation leaves alone, are one piece, and so are
        punctuation marks after them (but for the apostrophe, which may start a piece of letters):
        such pieces go to the merges directly, and the letters are remembered for other endings.
        Other words go through normalisation and splitting first.
        """
        if word.isalpha():
            return self._packed([t.id for t in self.model_ids(word.decode())])
        if cut := _LETTERS_THEN_MARKS(word):
            letters, marks = cut.groups()
            text = letters.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0130":
                if marks:
                    return self.known[letters] + self.known[marks]
                piece = text.lower().encode().decode("latin-1").translate(self.letters)
                return self._packed([t.id for t in self.model_ids(piece)])
        text = word.decode("utf-8", "replace")
        return self._packed([t.id for p, _ in self.pieces(self.normal(text)) for t in self.model_ids(p)])

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; its table lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- wavelet matrix ---------------------------------------------------------------------


class WaveletMatrix:
    """Sequence of unsigned ids as bit planes, each stably partitioned by the one above."""

    MAGIC = b"WMX1"

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[np.ndarray]):
        self.n, self.zeros, self.width = n, zeros, len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = ranks

    @classmethod
    def from_ids(cls, ids: np.ndarray, width: int = 16) -> WaveletMatrix:
        current, zeros, planes, ranks = ids.astype(np.uint16 if width <= 16 else np.uint32), [], [], []
        for level in range(width - 1, -1, -1):
            bit = (current & current.dtype.type(1 << level)) != 0
            plane = np.packbits(bit)
            planes.append(plane.tobytes())
            ranks.append(cls._directory(plane))
            zeros.append(len(current) - int(np.count_nonzero(bit)))
            if level:
                # positions first: a boolean mask as an index costs several times as much
                current = np.concatenate([current[np.flatnonzero(~bit)], current[np.flatnonzero(bit)]])
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        step = RANK_BITS // 8
        ones = np.bitwise_count(plane)
        per = np.add.reduceat(ones, np.arange(0, len(ones), step), dtype=np.uint32) if len(ones) else ones[:0]
        return np.r_[0, np.cumsum(per)].astype(np.uint32)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [(pack(p.tobytes()), pack(r.tobytes())) for p, r in zip(self.planes, self.ranks)]
        head = self.MAGIC + struct.pack("<QB", self.n, self.width)
        for zero, (p, r) in zip(self.zeros, parts):
            head += struct.pack("<QII", zero, len(p), len(r))
        return head + b"".join(x for pair in parts for x in pair)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != cls.MAGIC:
            raise ValueError("not a wavelet matrix")
        n, width = struct.unpack_from("<QB", data, 4)
        sizes = [struct.unpack_from("<QII", data, 13 + 16 * k) for k in range(width)]
        at, unpack, planes, ranks = 13 + 16 * width, zstandard.ZstdDecompressor().decompress, [], []
        for _, p, r in sizes:
            planes.append(unpack(data[at : at + p]))
            ranks.append(np.frombuffer(unpack(data[at + p : at + p + r]), np.uint32))
            at += p + r
        return cls(n, [z for z, _, _ in sizes], planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before position i."""
        block = i // RANK_BITS
        lo, plane = block * RANK_BITS // 8, self.planes[level]
        total = int(self.ranks[level][block]) + int(np.bitwise_count(plane[lo : i >> 3]).sum())
        return total + (int(plane[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else total

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.width - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._nth(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """The whole sequence, by undoing the partitions from the last plane up."""
        value = np.zeros(self.n, np.uint32 if self.width > 16 else np.uint16)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty_like(value)
            above[np.flatnonzero(~bit)] = value[: self.zeros[level]]
            above[np.flatnonzero(bit)] = value[self.zeros[level] :] | value.dtype.type(1 << (self.width - 1 - level))
            value = above
        return value


# --- shards -----------------------------------------------------------------------------

SHARD_SCHEMA = "part int, seq int, n_tokens bigint, keys array<bigint>, counts array<int>, matrix binary"
_SHARD_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("seq", pa.int32()),
        ("n_tokens", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())),
        ("matrix", pa.binary()),
    ]
)


def write_shards(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode ``docs`` in ascending key order into shard files under ``path``."""
    end = struct.pack("<H", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        part, seq, keys, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            ids = np.frombuffer(b"".join(parts), "<u2")
            got = (part, seq, len(ids), keys, [len(p) // 2 for p in parts], WaveletMatrix.from_ids(ids).to_bytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(got, _SHARD_ARROW)], schema=_SHARD_ARROW
            )

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                parts.append(encode(t) + end)
                keys.append(k)
                held += len(parts[-1]) // 2
                if held >= shard_tokens:
                    yield row()
                    seq, keys, parts, held = seq + 1, [], [], 0
        if keys:
            yield row()

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    # rows of one id are spread by a hash of their text, rows alike by their number: no hot id is one task
    rows = rows.withColumns({"h": F.xxhash64("t"), "u": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("k", "h", "u").sortWithinPartitions("k", "h", "u")
    shards = ordered.select("k", "t").mapInArrow(write, SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, _, keys, counts, matrix = (batch.column(c)[i].as_py() for c in range(6))
                ids = WaveletMatrix.from_bytes(matrix).ids()
                ends = np.cumsum(counts)
                crcs = [
                    zlib.crc32(ids[e - c : e].astype("<u4").tobytes()) for e, c in zip(ends.tolist(), counts)
                ]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([seq] * n, pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array(ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(
        read, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    counts = shards.select("part", "seq", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per writing task, then one per shard of a task
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    first = (
        counts.select("part", "seq", within.alias("within"))
        .join(before, "part")
        .select("part", "seq", (F.col("within") + F.col("before")).alias("first"))
    )
    return docs.join(first, ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def vocabulary_path(name: str = VOCABULARY_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_shards(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Write the shards in the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    path = f"{staging_root(spark)}/renewlens/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, vocabulary=vocabulary_path(), key=key)
    return read_tokens(spark, path)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))
