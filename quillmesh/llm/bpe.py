"""Byte-level BPE encoding and decoding by a rank queue under a hierarchical bitmap.

Merging keeps the tokens of all new pre-tokens of a batch where they start in one list; the next one stands a token's length
further on. Pairs of bytes enter the queue sorted, all at once. Every mergeable pair stands in the bucket of its merge rank; a three-level bitmap over the ranks finds the first non-empty bucket with three find-first-set steps; entries whose pair
has changed meanwhile are stale and skipped. The cost is near linear in the pre-token's length, where scanning for the
best pair would be quadratic, so a pre-token of a megabyte is no special case.

A null text is empty and has no tokens. Texts are encoded whole, without special tokens. Rows are independent: ties
and repeated rows need no rule, empty tables give empty tables, and an input column whose name clashes with an output
is replaced by the output.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of one of the two generations of a worker's memo; pre-tokens longer than MEMO_CHARS are not kept.
MEMO = 250_000
MEMO_CHARS = 64
#: Ranks of neighbouring tokens that a worker remembers.
JOINS = 1_000_000
#: Rows worked on at a time inside an Arrow batch.
ROWS = 256
#: What encode() can add: column -> (Spark type, Arrow type).
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


class RankQueue:
    """Buckets of positions by rank, and the smallest rank that has any."""

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [at])
        else:
            bucket.append(at)

    def open(self, rank: int, bucket: list[int]) -> None:
        self.buckets[rank] = bucket
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The smallest rank with a bucket, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = (a << 6) + (m & -m).bit_length() - 1
        w = self.low[b]
        return (b << 6) + (w & -w).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """A rank's positions from left to right; the bucket leaves the queue and the bitmap."""
        bucket = self.buckets.pop(rank)
        b = rank >> 6
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[b >> 6] &= ~(1 << (b & 63))
            if not self.mid[b >> 6]:
                self.top &= ~(1 << (b >> 6))
        bucket.sort()
        return bucket


class Memo:
    """Values of about the last 2 * MEMO keys, made for many keys at a time."""

    def __init__(self) -> None:
        self.now: dict = {}
        self.old: dict = {}
        self.long: list = []

    def fill(self, keys: set, make) -> dict:
        """A dict with the values of at least these keys; make() may leave out keys, which then have none.

        Long keys are there until the next call only.
        """
        for k in self.long:
            self.now.pop(k, None)
        new = keys.difference(self.now)
        here = {k: v for k in new if (v := self.old.get(k)) is not None}
        here |= make(list(new.difference(here)))
        if len(self.now) + len(here) > MEMO:
            self.old, self.now = self.now, {}
            here |= {k: v for k in keys if (v := self.old.get(k)) is not None}
        self.now |= here
        self.long = [k for k in here if len(k) > MEMO_CHARS]
        return self.now


class ByteBPE:
    """Encoder and decoder for a vocabulary file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pieces = {rank: token for token, rank in self.ranks.items()}
        self.named = {str(rank): token for token, rank in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        byte_pairs = [-1] * (1 << 16)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                byte_pairs[token[0] << 8 | token[1]] = rank
        self.byte_pairs = np.array(byte_pairs)
        self.shared = np.array(byte_pairs, dtype=object)
        self.lengths = {rank: len(token) for rank, token in self.pieces.items()}
        self.written_id = {rank: str(rank) for rank in self.pieces}
        self.with_next: dict[int, dict[int, int]] = {}
        self.with_last: dict[int, dict[int, int]] = {}
        self.n_joins = 0
        self.queue = RankQueue(max(self.pieces) + 1)
        self.split = regex.compile(pattern).findall
        self.pretoken, self.at_start, self.after_space = Memo(), Memo(), Memo()

    def join(self, known: dict[int, int], key: int, a: int, b: int) -> int:
        """The rank of two neighbouring tokens' bytes, or -1; `known` remembers it under `key`."""
        if self.n_joins >= JOINS:
            for held in (self.with_next, self.with_last):
                for ranks in held.values():
                    ranks.clear()
            self.n_joins = 0
        self.n_joins += 1
        rank = known[key] = self.ranks.get(self.pieces[a] + self.pieces[b], -1) if a >= 0 and b >= 0 else -1
        return rank

    def opened(self, pretokens: list[bytes]) -> tuple[list[int], list[int]]:
        """Ids and pair ranks of all bytes, with an id of -1 after each pre-token; the pairs' positions are in the queue."""
        joined = b"\0".join(pretokens) + b"\0"
        raw = np.frombuffer(joined, np.uint8).astype(np.int64)
        ends = (np.cumsum([len(p) + 1 for p in pretokens]) - 1).tolist()
        bytes_at = raw[:-1] << 8 | raw[1:]
        ids, pair, ranks = list(map(self.bytes.__getitem__, joined)), self.shared[bytes_at].tolist(), self.byte_pairs[bytes_at]
        pair.append(-1)
        for end in ends:
            ids[end] = pair[end] = pair[end - 1] = -1
        ranks[[end - 1 for end in ends]] = -1
        ranks[ends[:-1]] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        distinct, starts = np.unique(ranks[at], return_index=True)
        where, stops = at.tolist(), [*starts.tolist(), len(at)][1:]
        for rank, start, stop in zip(distinct.tolist(), starts.tolist(), stops, strict=True):
            self.queue.open(rank, where[start:stop])
        return ids, pair

    def merge(self, pretokens: list[bytes]) -> list[list[int]]:
        """The ids of many pre-tokens, which stand in one list and go through one queue.

        A token's id and pair are where it starts; `begin` tells for its last byte where that is.
        """
        out = [[r] if (r := self.ranks.get(p)) is not None else None for p in pretokens]
        long = [p for p, ids in zip(pretokens, out, strict=True) if ids is None]
        if not long:
            return out
        ids, pair = self.opened(long)
        begin = list(range(len(ids)))
        join, queue, lengths = self.join, self.queue, self.lengths
        bucket_of, push = queue.buckets.get, queue.push
        while (rank := queue.first()) >= 0:
            bucket, length = queue.take(rank), lengths[rank]
            with_next, with_last = self.with_next.setdefault(rank, {}), self.with_last.setdefault(rank, {})
            next_rank, last_rank = with_next.get, with_last.get
            for at, i in enumerate(bucket, 1):
                if pair[i] != rank:
                    continue
                j, k, p = i + lengths[ids[i]], i + length, begin[i - 1]
                ids[i], ids[j], pair[j], begin[k - 1] = rank, -1, -1, i
                if (right := next_rank(x := ids[k])) is None:
                    right = join(with_next, x, rank, x)
                pair[i] = right
                if right >= 0:
                    if (others := bucket_of(right)) is not None:
                        others.append(i)
                    else:
                        push(right, i)
                if (left := last_rank(x := ids[p])) is None:
                    left = join(with_last, x, x, rank)
                pair[p] = left
                if left >= 0:
                    if (others := bucket_of(left)) is not None:
                        others.append(p)
                    else:
                        push(left, p)
                if 0 <= right < rank or 0 <= left < rank:
                    # A pair of a smaller rank has come up: it goes first, the rest of this bucket waits.
                    if rest := bucket[at:]:
                        queue.open(rank, rest)
                    break
        start, merged = 0, []
        for p in long:
            merged.append([x for x in ids[start : start + len(p)] if x >= 0])
            start += len(p) + 1
        found = iter(merged)
        return [next(found) if x is None else x for x in out]

    def name_pretokens(self, pretokens: list[str]) -> dict[str, str]:
        return {p: " ".join(map(self.written_id.__getitem__, ids)) for p, ids in zip(pretokens, self.merge([p.encode() for p in pretokens]), strict=True)}

    def name_chunks(self, lead: str, chunks: list[str]) -> dict[str, str]:
        """Chunks with white space at an edge are left out: the pattern must see the whole text."""
        split = {c: self.split(lead + c) for c in chunks if c and not c[0].isspace() and not c[-1].isspace()}
        known = self.pretoken.fill(set().union(*split.values()), self.name_pretokens)
        return {c: " ".join(map(known.__getitem__, ps)) for c, ps in split.items()}

    def written(self, texts: list[str]) -> list[str]:
        """The ids of every text in decimal, joined by one space.

        Between two characters that are no white space, one space always opens the next pre-token and one line end is
        always a pre-token of its own, so chunks of text can be looked up apart. Any other white space goes by the
        pattern over the whole text.
        """
        lines = [[x.split(" ") for x in t.split("\n")] for t in texts]
        first = self.at_start.fill({x[0] for t in lines for x in t}, lambda cs: self.name_chunks("", cs))
        rest = self.after_space.fill(set().union(*(x[1:] for t in lines for x in t)), lambda cs: self.name_chunks(" ", cs))
        line_end = f" {self.name_pretokens([chr(10)])[chr(10)]} "
        out: list[str | None] = []
        for t in lines:
            try:
                out.append(line_end.join([" ".join([first[x[0]], *map(rest.__getitem__, x[1:])]) for x in t]))
            except KeyError:
                out.append(None)
        split = {i: self.split(texts[i]) for i, x in enumerate(out) if x is None}
        known = self.pretoken.fill(set().union(*split.values()), self.name_pretokens) if split else {}
        for i, ps in split.items():
            out[i] = " ".join(map(known.__getitem__, ps))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.written([text])[0].split()]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_encoders: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """One for each worker process and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteBPE(path, pattern)
    return _encoders[path, pattern]


def encoded(docs: DataFrame, outputs=("ids", "n_tokens"), text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with the columns named in `outputs`; decoded_sha256 is of the bytes that decoding the ids gives back.

    Texts are taken in pieces where the default pattern always breaks; another pattern, which may not, is refused.
    """
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("the pieces of a text are known for the default pattern only")
    path = path or public_tokenizers.path(VOCABULARY)
    keep = [c for c in docs.columns if c.lower() not in outputs]
    docs = docs.select(*[f"`{c}`" for c in keep])
    at = keep.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, OUTPUTS[c][0]) for c in outputs]])

    def work(batches):
        bpe = encoder(path, pattern)
        make = {
            "ids": lambda s: [int(x) for x in s.split()],
            "n_tokens": lambda s: s.count(" ") + 1 if s else 0,
            "ids_sha256": lambda s: hashlib.sha256(s.encode()).hexdigest(),
            "decoded_sha256": lambda s: hashlib.sha256(b"".join(map(bpe.named.__getitem__, s.split()))).hexdigest(),
        }
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                written = bpe.written([t or "" for t in batch.column(at).to_pylist()])
                new = [pa.array([make[c](s) for s in written], OUTPUTS[c][1]) for c in outputs]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*keep, *outputs])

    return docs.mapInArrow(work, schema)


def decoded(frame: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """frame with a binary column `decoded`; null ids decode to nothing. An id outside the vocabulary is an error."""
    path = path or public_tokenizers.path(VOCABULARY)
    keep = [c for c in frame.columns if c.lower() != "decoded"]
    frame = frame.select(*[f"`{c}`" for c in keep])
    at = keep.index(ids)

    def work(batches):
        bpe = encoder(path, public_tokenizers.PATTERN)
        for batch in batches:
            out = pa.array([bpe.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*keep, "decoded"])

    return frame.mapInArrow(work, T.StructType([*frame.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
