"""Near-duplicate documents by MinHash.

A document's set is its distinct 5-word shingles, words being [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; with fewer
words the whole sequence is its one shingle; without words it has none and is linked with nothing. Documents are linked
if 100 * intersection >= 75 * union, on full sets of 64-bit shingle hashes.

Documents with the same words form one class, whose smallest doc_id stands for it. A class has 128 minima of universal
hashes in 32 bands of 4: at a similarity of 0.75 a pair misses all bands with probability 6e-6. Candidates are dropped
by size and odd sketch where these prove that they cannot be linked, and checked on their full sets otherwise.

Null texts have no words. A null doc_id cannot be linked: its component_id is null and it is kept. Rows that repeat a
doc_id with different texts are one document, which all of its texts link to others; each row has the set of its own
text. Extra columns do not matter. A percentage below 75 is refused: the bands would miss most of its links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, key_filter, own_name, settled, skew_join, thin
from .components import components
from .neighbours import linked_components, may_link, shared_buckets

WORDS = 5
PERCENT = 75
BANDS, BAND = 32, 4
#: Words of 64 bits of a set's odd sketch.
SKETCH = 32
ROWS = 256
#: Word hashes that a worker remembers.
MEMO = 300_000

_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(0, 1 << 64, BANDS * BAND, dtype="u8") | np.uint64(1)
_B = _rng.integers(0, 1 << 64, BANDS * BAND, dtype="u8")
_PLACE = _rng.integers(0, 1 << 64, WORDS, dtype="u8") | np.uint64(1)
_BAND_MIX = _rng.integers(0, 1 << 64, BAND, dtype="u8") | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the document's shingles."""
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_hashes.__getitem__, words), "u8", len(words))
    k = min(WORDS, len(words))
    total = np.full(len(h) - k + 1, k, "u8")
    for i in range(k):
        total += mixed(h[i : len(h) - k + 1 + i]) * _PLACE[i]
    return np.unique(mixed(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """BANDS * BAND minima of multiply-add-shift hashes of the upper 32 bits."""
    keys, best = hashes >> np.uint64(32), None
    for start in range(0, len(keys), 1024):
        least = ((keys[start : start + 1024, None] * _A + _B) >> np.uint64(32)).min(axis=0)
        best = least if best is None else np.minimum(best, least)
    return best


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = (mixed(least.reshape(BANDS, BAND) + np.uint64(1)) * _BAND_MIX).sum(axis=1, dtype="u8")
    return mixed(rows + np.arange(BANDS, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)).view("i8")


def digest(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def signed(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, same, bands): `same` is the digest of the words; both it and bands are null without words."""

    def work(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n, same, bands = [], [], []
                for text in batch.column(1).to_pylist():
                    words = sequence(text)
                    hashes = shingles(words)
                    n.append(len(hashes))
                    same.append(digest(words))
                    bands.append(band_keys(minima(hashes)) if words else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "same", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "id long, n_shingles long, same binary, bands array<long>")


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH words, whose bit i is the parity of the hashes that end in i."""
    at, n = np.unique(hashes & np.uint64(SKETCH * 64 - 1), return_counts=True)
    bits = np.zeros(SKETCH * 64, bool)
    bits[at[n % 2 == 1].astype("i8")] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, same, small, facts): size, odd sketch and full set of the texts of the classes (id, same), each once."""

    def work(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                words = [sequence(t) for t in batch.column(1).to_pylist()]
                sets = [shingles(w) for w in words]
                columns = [pa.array([digest(w) for w in words], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64())), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "same", "n", "bits", "facts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = thin(rows, F.col("id"), key_filter(classes, F.col("id"))).join(classes.select("id").distinct(), "id").select("id", "text")
    sets = rows.mapInArrow(work, "id long, same binary, n long, bits array<long>, facts array<long>")
    # Another text of the same doc_id may not be a class's first.
    sets = sets.join(classes, ["id", "same"]).dropDuplicates(["id", "same"])
    return sets.select("id", "same", F.struct("n", "bits").alias("small"), "facts")


def linked_at(percent: int = PERCENT):
    def linked(a, b):
        return F.size(F.array_intersect(a, b)) * (100 + percent) >= (F.size(a) + F.size(b)) * percent

    return linked


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of docs (doc_id, text)."""
    if percent < PERCENT:
        raise ValueError(f"percent is {percent}, but the minima are made for {PERCENT} or more")
    rows = cut(signed(docs), "signed")
    full = rows.where("same IS NOT NULL AND id IS NOT NULL")
    classes = cut(full.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many")), "classes")
    firsts = full.join(classes.select("same", F.col("rep").alias("id")), ["same", "id"]).dropDuplicates(["same", "id"])
    live = shared_buckets(firsts.select("id", "bands"))
    ids = cut(live.select("id").distinct(), "liveids")
    sets = cut(full_sets(docs, cut(firsts.select("id", "same").join(ids, "id"), "liveclasses")), "sets")
    found = settled("linked", lambda: linked_components(live, sets.drop("same"), may_link(percent, SKETCH), linked_at(percent)))
    for done in (live, sets):
        drop(done)
    # A doc_id with several texts is one document: it links the classes of its texts.
    several = full.groupBy("id").agg(F.min(F.xxhash64("same")).alias("x"), F.max(F.xxhash64("same")).alias("y")).where("x <> y")
    several = full.join(several.select("id"), "id").select("id", "same").distinct().join(classes, "same").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = cut(several.where("a <> b"), "several")
    if not several.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionAll(several))
    comps = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("same", "many", F.coalesce("component_id", "rep").alias("component_id"))
    out = skew_join(full.select("id", "n_shingles", "same"), comps, ["same"], "many").select("id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("same IS NULL OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; all columns stay."""
    gone = settled("gone", lambda: near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct())
    key = own_name(docs, "gone")
    return docs.join(gone.withColumnRenamed("gone", key), F.col("doc_id").cast("long") == F.col(key), "left_anti")


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Every pair of documents with a shingle in common, exactly: for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
h AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON s.doc_id = c.doc_id
"""
