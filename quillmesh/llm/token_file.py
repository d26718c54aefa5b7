"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, least first. Level k holds the k-th chunk of all ids that have one, a bitmap that
says which of them go on to level k + 1, and a directory of how many continued before every 512th entry. The place of
an id's next chunk is a rank in the bitmap, so any id of a file is read by a few look-ups, without decoding a block.

A shard is one row: the documents it holds, in order, and their codes; shards hold whole documents and about
SHARD_TOKENS ids. Documents are in ascending doc_id order (null first, then by a hash of the text among equal ids),
range partitioned before they are encoded. Spark's writer keeps the shards, so a lost task's file never counts.

A null text is empty: only the end id. An empty table gives no shard and no row. Rows that repeat a doc_id are
documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SHARD_TOKENS = 1 << 20
ROWS = 256
CHUNK = 8
DIRECTORY = 512
MAGIC = b"DAC1"
#: A word that ends in ASCII symbols; an apostrophe may belong to letters.
TAIL = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")
SYMBOLS = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Entries of one of the two generations of a worker's memo of words.
MEMO = 600_000
SHARD_SCHEMA = "part int, seq int, part_start long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


# --- the codes


def pack(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids."""
    rest, parts, levels = ids.astype("<u4"), [], 0
    while levels == 0 or len(rest):
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), DIRECTORY), dtype="<u4") if len(more) else np.zeros(0, "<u4")
        ranks = np.concatenate([np.zeros(1, "<u4"), np.cumsum(counts, dtype="<u4")])
        parts += [np.array([len(rest)], "<u8").tobytes(), (rest & 0xFF).astype("u1").tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
        rest, levels = rest[more] >> CHUNK, levels + 1
    return b"".join([MAGIC, bytes([levels]), *parts])


class Codes:
    """Reader of pack()'s bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at, self.levels = 5, []
        for _ in range(data[4]):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            n_bits, n_ranks = (n + 7) // 8, (n + DIRECTORY - 1) // DIRECTORY + 1
            chunks, bitmap = np.frombuffer(data, "u1", n, at + 8), np.frombuffer(data, "u1", n_bits, at + 8 + n)
            self.levels.append((chunks, bitmap, np.frombuffer(data, "<u4", n_ranks, at + 8 + n + n_bits)))
            at += 8 + n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Continued entries before i."""
        _, bitmap, ranks = self.levels[level]
        block = i // DIRECTORY
        bits = np.unpackbits(bitmap[block * DIRECTORY // 8 : i // 8 + 1], bitorder="little")
        return int(ranks[block]) + int(bits[: i - block * DIRECTORY].sum())

    def __getitem__(self, i: int) -> int:
        """One id, by at most one look-up a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("an id goes on past the last level")

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop]; only their own chunks are touched."""
        out = np.zeros(stop - start, "<u4")
        places, first, last = np.arange(stop - start), start, stop
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if first >= last:
                break
            out[places] |= chunks[first:last].astype("<u4") << np.uint32(CHUNK * level)
            byte = first >> 3
            more = np.unpackbits(bitmap[byte : (last + 7) >> 3], bitorder="little")[first - 8 * byte : last - 8 * byte].astype(bool)
            places = places[more]
            if not len(places):
                break
            first = self._rank(level, first)
            last = first + len(places)
        return out


# --- the tokenizer


class WordEncoder:
    """The tokenizers library, with a memo of words.

    The vocabulary's pattern drops white space and never looks past it, so words between ASCII spaces are encoded apart.
    New words of many texts go through the library in one call, with a separator of a known single id between them.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo = Memo()
        separator = self.whole([self.SEPARATOR])[0]
        self.separator = int(separator[0]) if len(separator) == 1 else None

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def words(text: str) -> list[bytes]:
        data = text.encode()
        # The library lower-cases; doing so before is safe unless a special token or a combining mark may be hit.
        if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
            data = data.lower()
        return data.split()

    def learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        # Letters and the symbols that follow them are separate matches of the pattern.
        apart = {w: m.groups() for w in missing if w[-1] in SYMBOLS and (m := TAIL.fullmatch(w)) and b"<|" not in w and self.letters(m[1])}
        wanted = {w for w in missing if w not in apart}
        known: dict[bytes, bytes] = {}
        for part in {part for parts in apart.values() for part in parts} - wanted:
            ids = self.memo.get(part) or self.memo.old.get(part)
            if ids is None:
                wanted.add(part)
            else:
                known[part] = ids
        listed = list(wanted)
        for start in range(0, len(listed), 1000):
            self.learn_some(listed[start : start + 1000], found)
        for w, (core, tail) in apart.items():
            found[w] = (known.get(core) or found[core]) + (known.get(tail) or found[tail])
        return found

    @staticmethod
    def letters(word: bytes) -> bool:
        """Only letters below U+0250, which every version of Unicode agrees on, in the lower case that the library takes: İ becomes two characters, the second no letter."""
        return word.isalpha() or max(text := word.decode().lower()) < "ɐ" and text.isalpha()

    def learn_some(self, wanted: list[bytes], found: dict[bytes, bytes]) -> None:
        plain = [w for w in wanted if b"<|" not in w and b"\x01" not in w] if self.separator is not None else []
        if plain:
            ids = self.whole([f" {self.SEPARATOR} ".join(w.decode() for w in plain)])[0]
            ends = [*np.flatnonzero(ids == self.separator).tolist(), len(ids)]
            if len(ends) == len(plain):
                start = 0
                for w, end in zip(plain, ends, strict=True):
                    found[w] = ids[start:end].tobytes()
                    start = end + 1
            else:
                plain = []
        plain_set = set(plain)
        odd = [w for w in wanted if w not in plain_set]
        for w, ids in zip(odd, self.whole([w.decode() for w in odd]), strict=True):
            found[w] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        get, memo.unknown = memo.__getitem__, set()
        split = [self.words(t) for t in texts]
        ids = [list(map(get, ws)) for ws in split]
        if memo.unknown:
            learned = self.learn(list(memo.unknown))
            # One batch may bring more words than the memo holds; they are all known until it is written.
            ids = [vs if None not in vs else [learned[w] if v is None else v for v, w in zip(vs, ws, strict=True)] for vs, ws in zip(ids, split, strict=True)]
            if len(memo) + len(learned) > MEMO:
                self.memo = Memo(memo)
            self.memo.update(learned)
        return [b"".join(vs) for vs in ids]


class Memo(dict):
    """Ids of words; what is not there is taken over from the generation before or noted as unknown."""

    def __init__(self, old: Memo | None = None) -> None:
        self.old: dict[bytes, bytes] = {} if old is None else old
        self.unknown: set[bytes] = set()
        if old is not None:
            # Only one generation before is kept.
            old.old = {}

    def __missing__(self, word: bytes) -> bytes | None:
        ids = self.old.get(word)
        if ids is None:
            self.unknown.add(word)
        else:
            self[word] = ids
        return ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- writing and reading


def write(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the ids of docs (doc_id, text) to a folder of shards; returns the folder."""
    spark, vocabulary = docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY)
    path = path or new_path(spark, "token-file")
    end = np.array([end_id], "<u4").tobytes()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(width, *order).sortWithinPartitions(*order)

    def work(batches):
        words, part = encoder(vocabulary), TaskContext.get().partitionId()
        doc_ids, lengths, data, seq, begun, held = [], [], [], 0, 0, 0

        def shard():
            ids = np.frombuffer(b"".join(data), "<u4")
            values = [[part], [seq], [begun], [len(ids)], [doc_ids], [lengths], [pack(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "seq", "part_start", "n_tokens", "doc_ids", "lengths", "codes"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    doc_ids.append(doc_id)
                    data.append(ids + end)
                    lengths.append(len(ids) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield shard()
                        doc_ids, lengths, data, seq, begun, held = [], [], [], seq + 1, begun + held, 0
        if doc_ids:
            yield shard()

    rows.mapInArrow(work, SHARD_SCHEMA).write.parquet(path)
    return path


def shards(spark, path: str) -> DataFrame:
    """All shards with `start`, the ids in all shards before; the offsets of partitions are few enough to broadcast."""
    found = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return found.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the codes alone."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, at = Codes(row["codes"]), 0
                n, crc = row["lengths"], []
                for length in n:
                    crc.append(zlib.crc32(codes.slice(at, at + length).tobytes()))
                    at += length
                if at != len(codes):
                    raise ValueError("a shard's lengths do not fit its codes")
                starts = row["start"] + np.cumsum([0, *n])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = shards(spark, path).select("start", "doc_ids", "lengths", "codes")
    return found.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark, path: str, positions: list[int]) -> list[int]:
    """The ids at global positions: one shard row each and one access in its codes."""
    where = shards(spark, path)
    wanted = where.select("part", "seq", "start", "n_tokens").where(" OR ".join(f"(start <= {p} AND {p} < start + n_tokens)" for p in positions))
    held = where.join(F.broadcast(wanted.select("part", "seq")), ["part", "seq"]).select("start", "codes").orderBy("start").collect()
    starts = [r["start"] for r in held]
    return [Codes(bytes(held[k := bisect_right(starts, p) - 1]["codes"]))[p - starts[k]] for p in positions]


def op8_token_file(spark, sf_dir: str) -> DataFrame:
    return read(spark, write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
