"""Fuzzy line dedup by MinHash, on built-in expressions only.

A line is what stands between line ends; lines with a word take part, whatever their length. Its set is the shingles of
9 characters at every position, after lower-casing and trimming; a shorter line is its own one shingle. Lines are linked
if their sets' Jaccard similarity is at least 0.8 (12 bands of 3 of 16 minima: a pair at 0.8 is missed with probability
0.0033, at 0.9 with 6e-5; links are verified on the sets). Of every component of lines one line is kept: the first in the
document with the smallest doc_id. All other lines of the component go from their documents; everything else stays.

Equal lines are equal in two 64-bit hashes of the normalised line. The texts are read once for all minima, then for the
lines that share a band with others, then for the result. Hot lines and components are never gathered into one task. A
document's removed line numbers are gathered, which its text bounds.

Null texts have no lines and stay null. Documents with a null doc_id are left as they are and remove nothing elsewhere.
Rows that repeat a doc_id are one document for this purpose, and each of them keeps its own first line. Ties cannot
occur. Extra columns pass through; an input column named like an added one is replaced.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, drop, flagged, key_filter, let, own_name, settled, skew_join, small_enough, thin
from .neighbours import linked_components, may_link, shared_buckets

SHINGLE = 9
PERCENT = 80
#: The halves of a shingle's hash are each compared under masks: the least of half XOR mask is a minimum of its own, with
#: few exceptions of the shingle whose half agrees with the mask in the most leading bits.
MINIMA, HALVES = 16, 2
_mask = random.Random("masks")
#: The masks of one half begin with different bits.
MASKS = [(k // HALVES << 29 | _mask.randrange(1 << 29)) - (1 << 31) for k in range(MINIMA)]
#: Bands of three minima, not all of one half; no two minima are together in two bands.
BANDS = (
    (0, 3, 13), (0, 5, 8), (1, 6, 9), (1, 12, 14), (2, 7, 12), (2, 10, 11),
    (3, 8, 10), (4, 6, 15), (4, 7, 9), (5, 7, 14), (5, 12, 13), (11, 14, 15),
)
#: Lines of so many shingles take part in the minima with those that agree with some mask in as many leading bits: a line
#: of n shingles has none that agrees with a given mask with probability (1 - 2 ** -bits) ** n, less than 0.007.
LEADING = ((160, 5), (320, 6))
#: Words of 64 bits of a set's odd sketch.
WORDS = 16
#: Removed lines, with four more for each of their documents, up to which they are broadcast: some 40 MB.
BROADCAST = 2_000_000
#: Bytes of a character in wide().
WIDE = 4


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(SPACES)))


def wide(line: Column) -> Column:
    """The line as UTF-32, in which a shingle is looked up in constant time."""
    return F.encode(line, "UTF-32")


def starts(w: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.octet_length(w) - (SHINGLE - 1) * WIDE, F.lit(1)), F.lit(WIDE))


def shingle(w: Column, at: Column) -> Column:
    return F.substring(w, at, F.lit(SHINGLE * WIDE))


def shingle_hashes(line: Column) -> Column:
    return let(wide(line), lambda w: F.array_distinct(F.transform(starts(w), lambda i: F.xxhash64(shingle(w, i)))))


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, version, line_no, raw): every line. version tells rows of one doc_id apart."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "raw"))


def leading_map(half: int, n: Column) -> Column:
    """64 bits that say which six leading bits of a half can make a minimum of a line of n shingles."""

    def of(bits: int) -> int:
        starts_ = {((MASKS[k] ^ -(1 << 31)) & 0xFFFFFFFF) >> (32 - bits) for k in range(half, MINIMA, HALVES)}
        word = sum(1 << i for i in range(64) if i >> (6 - bits) in starts_)
        return word - (1 << 64) if word >> 63 else word

    few = F.when(n < LEADING[0][0], F.lit(-1).cast("long"))
    return few.when(n < LEADING[1][0], F.lit(of(LEADING[0][1])).cast("long")).otherwise(F.lit(of(LEADING[1][1])).cast("long"))


def sketched(occ: DataFrame) -> DataFrame:
    """(doc, version, line_no, id, twin, m0 ...): every line with a word, with its minima; id and twin are its hashes."""
    key = ["doc", "version", "line_no", "id", "twin"]
    rows = occ.select("doc", "version", "line_no", normal(F.col("raw")).alias("line")).where("line <> ''")
    rows = rows.select("doc", "version", "line_no", F.xxhash64("line").alias("id"), F.xxhash64(F.lit("twin"), "line").alias("twin"), wide(F.col("line")).alias("w"))
    n = F.shiftright(F.octet_length("w"), 2)
    rows = rows.select("*", leading_map(0, n).alias("low"), leading_map(1, n).alias("high"))
    parts = rows.select(*key, "w", "low", "high", F.explode(starts(F.col("w"))).alias("at")).select(*key, "low", "high", F.xxhash64(shingle(F.col("w"), F.col("at"))).alias("h"))
    parts = parts.where("((shiftrightunsigned(high, cast(shiftrightunsigned(h, 58) as int)) | shiftrightunsigned(low, cast(shiftrightunsigned(h, 26) & 63 as int))) & 1) = 1")
    parts = parts.select(*key, F.expr("shiftright(shiftleft(h, 32), 32)").alias("h0"), F.expr("shiftright(h, 32)").alias("h1"))
    least = [F.min(F.col(f"h{k % HALVES}").bitwiseXOR(F.lit(mask).cast("long"))).cast("int").alias(f"m{k}") for k, mask in enumerate(MASKS)]
    return parts.groupBy(*key).agg(*least)


def small_sets(lines: DataFrame) -> DataFrame:
    """(id, n, bits) of lines (id, line): the number of distinct shingles and their odd sketch."""
    parts = lines.select("id", F.explode(shingle_hashes(F.col("line"))).alias("h"))
    word, bit = "(h >> 6) & 15", "shiftleft(1L, cast(h & 63 as int))"
    bits = [F.expr(f"bit_xor(CASE WHEN {word} = {i} THEN {bit} ELSE 0L END)").alias(f"w{i}") for i in range(WORDS)]
    sums = parts.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *bits)
    return sums.select("id", "n", F.array(*[f"w{i}" for i in range(WORDS)]).alias("bits"))


def linked_at(percent: int):
    """Whether the sets of two lines are linked: lines are carried as text, as their sets' hashes are eight times as long."""

    def linked(x: Column, y: Column) -> Column:
        def near(s: Column) -> Column:
            a, b = s["a"], s["b"]
            return F.size(F.array_intersect(a, b)) * (100 + percent) >= (F.size(a) + F.size(b)) * percent

        return let(F.struct(shingle_hashes(x).alias("a"), shingle_hashes(y).alias("b")), near)

    return linked


def linked_lines(places: DataFrame, lines: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """(id, twin, comp) of the lines in components of several lines."""
    bands = F.array(*[F.xxhash64(*[f"m{k}" for k in band], F.lit(b)) for b, band in enumerate(BANDS)])
    live = shared_buckets(lines.select("id", bands.alias("bands")))
    ids = cut(live.select("id").distinct(), "liveids")
    # One place of each of these lines, whose text is then taken from the documents.
    spots = thin(places.select("doc", "version", "line_no", "id", "twin"), F.col("id"), key_filter(ids, F.col("id")))
    spots = cut(spots.dropDuplicates(["id"]).join(ids, "id"), "spots")
    # Documents without such lines are left out before they are split.
    held = flagged(docs, F.col(doc_id).cast("long"), key_filter(spots, F.col("doc")), maybe := own_name(docs, "maybe")).where(f"`{maybe}`")
    at = lambda: F.xxhash64("doc", "version", "line_no")
    texts = thin(occurrences(held, doc_id, text), at(), key_filter(spots, at())).join(spots, ["doc", "version", "line_no"])
    texts = cut(texts.select("id", "twin", normal(F.col("raw")).alias("line")).dropDuplicates(["id"]), "linetexts")
    sets = texts.select("id", F.col("line").alias("facts")).join(small_sets(texts), "id")
    sets = cut(sets.select("id", F.struct("n", "bits").alias("small"), "facts"), "linesets")
    found = settled("linecomponents", lambda: linked_components(live, sets, may_link(percent, WORDS), linked_at(percent)))
    every = found.select(F.col("node").alias("id"), F.col("component_id").alias("comp"))
    every = every.unionAll(found.select(F.col("component_id").alias("id"), F.col("component_id").alias("comp")).distinct())
    # A line whose hash another line shares by chance is not taken for it: both hashes must agree.
    return every.join(texts.select("id", "twin"), "id")


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, version, gone): the numbers of the lines that go."""
    places = cut(sketched(occurrences(docs, doc_id, text)), "places")
    lines = places.groupBy("id", "twin").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n"), *[F.min(f"m{k}").alias(f"m{k}") for k in range(MINIMA)])
    lines = cut(lines, "lines")
    near = linked_lines(places, lines, docs, doc_id, text, percent)

    # Lines that are repeated or near others, their component, and the smallest of its documents.
    many = lines.select("id", "twin", "first_doc", "n").join(near, ["id", "twin"], "left").where("n > 1 OR comp IS NOT NULL")
    many = cut(many.select("id", "twin", "first_doc", "n", F.coalesce("comp", "id").alias("comp"), F.when(F.col("comp").isNull(), F.col("twin")).otherwise(0).alias("alone")), "repeated")
    keep = many.groupBy("comp", "alone").agg(F.min("first_doc").alias("keep_doc"), F.count(F.lit(1)).alias("many"))
    many = cut(skew_join(many, keep, ["comp", "alone"], "many").select("id", "twin", "n", "comp", "alone", "keep_doc"), "keepers")
    drop(lines)

    narrow = thin(places.select("doc", "version", "line_no", "id", "twin"), F.col("id"), key_filter(many, F.col("id")))
    narrow = skew_join(narrow, many, ["id", "twin"], "n", ready=True)
    narrow = cut(narrow.select("doc", "version", "line_no", "comp", "alone", (F.col("doc") == F.col("keep_doc")).alias("keeps")), "candidates")
    drop(places)
    key = ["doc", "version", "comp", "alone"]
    kept = narrow.where("keeps")
    again = kept.join(kept.groupBy(*key).agg(F.min("line_no").alias("stays")), key).where("line_no > stays")
    gone = narrow.where("NOT keeps").select("doc", "version", "line_no").unionAll(again.select("doc", "version", "line_no"))
    return gone.groupBy("doc", "version").agg(F.collect_set("line_no").alias("gone"))


def without_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the kept lines as text, plus the numbers of all and of removed lines under the names `added`."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    gone = settled("gone", lambda: removals(docs, doc_id, text, percent))
    doc, version, maybe, removed = (own_name(docs, c) for c in ("doc", "version", "maybe", "gone"))
    lines = F.split(F.col(text), "\n", -1)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    told = gone.select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("gone").alias(removed))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    # The split lines are bound once; looking one up is then constant time.
    rebuilt = let(lines, lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))

    def marked(rows: DataFrame, told: DataFrame) -> DataFrame:
        rows = rows.withColumns({version: F.xxhash64(text), doc: F.col(doc_id).cast("long")}).join(told, [doc, version], "left")
        return rows.withColumns({added[0]: n_lines, added[1]: F.coalesce(F.size(removed), F.lit(0)), text: F.when(F.col(removed).isNull(), F.col(text)).otherwise(rebuilt)})

    pick = [F.col(f"`{c}`") for c in (*docs.columns, *added)]
    if small_enough(gone, F.size("gone") + 4, BROADCAST):
        return marked(docs, F.broadcast(told)).select(*pick)
    # Documents that lose nothing need no shuffle: most are told apart by a bit set of fixed size.
    flags = flagged(docs, F.col(doc_id).cast("long"), key_filter(gone, F.col("doc")), maybe)
    rest = flags.where(f"NOT `{maybe}`").withColumns({added[0]: n_lines, added[1]: F.lit(0)})
    return rest.select(*pick).unionByName(marked(flags.where(f"`{maybe}`"), told).select(*pick))


def op9_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    return without_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Every pair of lines at 0.8, exactly, for small tables: two such sets share one of the rarest fifth of either's shingles.
SQL = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, i AS line_no, lower(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
t AS (SELECT * FROM o WHERE line <> ''),
d AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM t)),
s AS MATERIALIZED (SELECT id, list_distinct(list_transform(range(1, greatest(length(line) - 7, 2)), lambda p: substr(line, p, 9))) AS sh FROM d),
u AS (SELECT id, len(sh) AS n, unnest(sh) AS x FROM s),
f AS (SELECT x, count(*) AS c FROM u GROUP BY x),
g AS (SELECT id, x FROM (SELECT id, n, u.x, row_number() OVER (PARTITION BY id ORDER BY c, u.x) AS k FROM u JOIN f ON u.x = f.x) WHERE k <= n - (8 * n + 9) // 10 + 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM g a JOIN g b ON a.x = b.x AND a.id < b.id),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b WHERE 180 * len(list_intersect(x.sh, y.sh)) >= 80 * (len(x.sh) + len(y.sh))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS comp FROM r GROUP BY a),
m AS (SELECT t.doc_id, t.line_no, coalesce(comp, d.id) AS comp FROM t JOIN d ON t.line = d.line LEFT JOIN c ON c.id = d.id),
k AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY doc_id, line_no) = 1 AS first FROM m),
z AS (SELECT doc_id, list(line_no) AS gone FROM k WHERE NOT first GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda v, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS INT) AS n_lines, CAST(coalesce(len(gone), 0) AS INT) AS n_removed
FROM documents LEFT JOIN z ON documents.doc_id = z.doc_id
"""
