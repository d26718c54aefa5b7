"""Shared pieces of the training-data operators: words, cut tables, prefix sums, fixed-size filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters \x20 and \x09-\x0D separate words everywhere.
SPACES = " \t\n\x0b\f\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that they share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="quillmesh-"))
        folder = f"file://{_own_folder[0]}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written by cut() within the innermost settled() that runs.
_scopes: list[list[str]] = []


def cut(df: DataFrame, name: str = "cut", codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    # Hashes and sums hardly repeat: a dictionary of them is work for nothing.
    words = any(kind in t for _, t in df.dtypes for kind in ("string", "binary"))
    df.write.option("compression", codec).option("parquet.enable.dictionary", str(words).lower()).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(name: str, make) -> DataFrame:
    """cut(make()), after which the tables that make() wrote on its way are deleted."""
    _scopes.append([])
    try:
        made = make()
        kept = len(_scopes[-1])
        done = cut(made, name)
    finally:
        paths = _scopes.pop()
    remove(done.sparkSession, paths[:kept])
    if _scopes:
        _scopes[-1] += paths[kept:]
    return done


def remove(spark: SparkSession, paths: list[str]) -> None:
    for file in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nothing will read again."""
    remove(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """All [^\\x20\\x09-\\x0D]+ of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    ends = F.when(t.rlike(f"^{WORD_BREAK}"), 1).otherwise(0) + F.when(t.rlike(f"[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    return F.when(t.rlike(WORD), F.size(F.split(t, WORD_BREAK)) - ends).otherwise(0).cast("long")


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], keep: list[str]) -> DataFrame:
    """df's columns `keep` plus, for each of `sums`, the total over all rows before this one in `order`.

    Rows are range partitioned and cut; then each partition sums its own rows, and only one total per partition
    (their number is the shuffle width, not the data's size) is summed across partitions. `order` must be total
    for a defined result.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*keep, F.struct(*order).alias("_at"), *[v.alias(f"_{k}") for k, v in sums.items()])
    ordered = cut(ordered.repartitionByRange(width, "_at").withColumn("_part", F.spark_partition_id()), "running")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in sums])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.select("*", *[F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)).alias(f"_l_{k}") for k in sums])
    return local.join(F.broadcast(parts), "_part").select(*keep, *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(k) for k in sums])


#: 2**18 words of 64 bits: 4 MB whatever the input, so it can be broadcast at any scale.
FILTER_WORDS = 1 << 18
#: Keys per bit beyond which a filter would let too much through to be worth its cost.
FILTER_FULL = 0.5


def key_filter(keys: DataFrame, key: Column) -> DataFrame | None:
    """A bit set of at most FILTER_WORDS rows over the hashed keys, to thin out rows before a shuffle; keys is a cut table.

    It only ever lets too much through, so an exact join must follow. None where the keys are too many for it: the join
    alone, which is a shuffle of all rows, is then the cheaper way.
    """
    if keys.count() > FILTER_WORDS * 64 * FILTER_FULL:
        return None
    h = F.pmod(F.xxhash64(key, F.lit("filter")), F.lit(FILTER_WORDS * 64))
    bits = keys.select(h.alias("_h")).select(F.shiftright("_h", 6).alias("_word"), F.expr("shiftleft(1L, cast(_h & 63 as int))").alias("_bit"))
    return bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def thin(df: DataFrame, key: Column, bits: DataFrame | None) -> DataFrame:
    """The rows of df whose key may be among those of key_filter()."""
    if bits is None:
        return df
    h = F.pmod(F.xxhash64(key, F.lit("filter")), F.lit(FILTER_WORDS * 64))
    marked = df.withColumn("_h", h).withColumn("_word", F.shiftright("_h", 6))
    hit = F.expr("(shiftrightunsigned(_bits, cast(_h & 63 as int)) & 1) = 1")
    return marked.join(F.broadcast(bits), "_word").where(hit).select(*[F.col(f"`{c}`") for c in df.columns])


def flagged(df: DataFrame, key: Column, bits: DataFrame | None, name: str) -> DataFrame:
    """df with a column that says whether key may be among those of key_filter(); names of df's columns don't matter."""
    if bits is None:
        return df.withColumn(name, F.lit(True))
    marked = df.withColumn(name, F.pmod(F.xxhash64(key, F.lit("filter")), F.lit(FILTER_WORDS * 64)))
    word, held = own_name(marked, "word"), own_name(marked, "held")
    marked = marked.withColumn(word, F.shiftright(name, 6)).join(F.broadcast(bits.select(F.col("_word").alias(word), F.col("_bits").alias(held))), word, "left")
    hit = F.expr(f"(shiftrightunsigned(`{held}`, cast(`{name}` & 63 as int)) & 1) = 1")
    return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop(word, held)


#: A key with more than 1 / SHARES of all rows is hot: there are fewer than SHARES of those, whatever the input.
SHARES = 1000
#: Keys of this many rows are never hot.
COOL = 256


def small_enough(table: DataFrame, items: Column, most: int) -> bool:
    """Whether a cut table may be broadcast: items counts what a row holds, which bounds its bytes."""
    return (table.agg(F.sum(items)).first()[0] or 0) <= most


def skew_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str, ready: bool = False) -> DataFrame:
    """rows joined to facts, which has one row for each key with the number of its rows as n; ready: facts is a cut table.

    Hot keys' facts, fewer than SHARES rows, are broadcast, so that their rows stay where they are; only the rows of
    other keys are shuffled.
    """
    facts = facts if ready else cut(facts, "facts")
    total, largest = facts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    most = max(total // SHARES, COOL)
    if largest <= most:
        return rows.join(facts, on)
    hot = facts.where(F.col(n) > most)
    key = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(key, on, "left_anti").join(facts.where(F.col(n) <= most), on))
