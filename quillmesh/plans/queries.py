"""Registered queries of the author-disambiguation operators, each over its whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import names, text, vectors
from ..operators import alignment, clusters, embedding, generative, judging, metrics, retrieval, sampling
from ..sources.durable import kept
from ..sources.records import bib_records, occurrence, sample_blocks_by_hash
from .sweep import grid_of, sweep

# --- shared inputs


def bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib_records(spark, sf_dir)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, label, base, extension: two simple predictors on the records."""
    base = F.concat_ws("/", "ambiguous_name", F.substring("author_name", 1, 1))
    return bib(spark, sf_dir).select("rid", "paper_id", F.col("ambiguous_name").alias("block"), "label", "author_name", base.alias("base"), F.concat_ws("/", "ambiguous_name", "venue").alias("extension"))


def base_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select("rid", "block", "label", F.col("base").alias("cluster"))


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as clusters of a few members: blocks of 25 vec_ids, five clusters each."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("vec_id") % len(NAMES) + 1).cast("int"))
    return v.select(
        "vec_id", F.floor(F.col("vec_id") / 25).alias("block"), (F.col("vec_id") % 5).alias("cluster"), text.tokens(name).alias("name_tokens"), F.col("label").cast("string").alias("label"), "embedding"
    )


NAMES = ("ana silva", "a silva", "ana b silva", "silva ana", "bo silva")


def records_for_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib(spark, sf_dir).withColumnRenamed("rid", "row_index")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made up from events: valid, label, same_author, p."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = (F.col("event_id") * 37 % 101) / 100
    label = F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("user_id") % 3 == 0)
    return e.select((F.col("event_id") % 11 != 0).alias("valid"), label.alias("label"), (p > 0.5).alias("same_author"), p.alias("p"))


# --- scalar functions


def q_name_tokens(spark, sf_dir):
    r = bib(spark, sf_dir).select("rid", "author_name", text.tokens(F.col("author_name")).alias("tokens"))
    return r.select("rid", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


def q_long_name(spark, sf_dir):
    return bib(spark, sf_dir).select("rid", names.is_long(text.tokens(F.col("author_name"))).alias("long_name"))


def q_coauthor_keys(spark, sf_dir):
    r = bib(spark, sf_dir).select("rid", text.tokens(F.col("author_name")).alias("t"))
    return r.select("rid", F.array_join(names.keys_of_tokens(F.col("t")), "|").alias("keys"))


def q_token_compatible(spark, sf_dir):
    tokens = bib(spark, sf_dir).select(F.explode(text.tokens(F.col("author_name"))).alias("t")).distinct()
    a, b = tokens.select(F.col("t").alias("a")), tokens.select(F.col("t").alias("b"))
    # Compatible tokens share their first letter, so the pairing is an equi-join.
    both = a.join(b, F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return both.where(names.token_compatible(F.col("a"), F.col("b")))


def q_names_similar(spark, sf_dir):
    n = bib(spark, sf_dir).select("ambiguous_name", "author_name").distinct().withColumn("t", text.tokens(F.col("author_name")))
    a, b = (n.select("ambiguous_name", F.col("author_name").alias(s), F.col("t").alias(f"t{s}")) for s in "ab")
    return a.join(b, "ambiguous_name").select("ambiguous_name", "a", "b", names.similar_tokens(F.col("ta"), F.col("tb")).alias("fits"))


#: Collaborators added to every record: forms of some authors' names and names of nobody.
ADDED = ("alice silva", "b. wang", "WANG, Bruno", "carla j muller", "silva", "d garcia", "kim elena", "j rossi", "alice j novak junior")


def q_focal_exclusion(spark, sf_dir):
    r = bib(spark, sf_dir).withColumn("all", F.concat("coauthors", F.array(*map(F.lit, ADDED)), F.array("author_name")))
    r = r.select("rid", names.others("all", "author_name").alias("left"))
    return r.select("rid", F.array_join(F.sort_array("left"), "|").alias("others"), F.size("left").alias("n_others"))


def q_doc_normalize(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded_md5"))


def _doc_terms(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(text.content_words(F.col("text"))).alias("term"))
    return d.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def q_doc_terms(spark, sf_dir):
    return _doc_terms(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_words"), F.sum(F.col("tf") * F.col("tf")).alias("square"), F.max_by("term", F.struct("tf", "term")).alias("top_term"))


def q_term_cosine(spark, sf_dir):
    """Titles of a block's records against its first record's, unstemmed; 0 where they share no term."""
    r = bib(spark, sf_dir).select("rid", "ambiguous_name", text.content_words(F.col("title")).alias("words"))
    r = r.select("rid", "ambiguous_name", text.counts(F.col("words")).alias("terms"))
    seed = r.groupBy("ambiguous_name").agg(F.min(F.struct("rid", F.map_entries("terms").alias("e"))).alias("s")).select("ambiguous_name", F.map_from_entries("s.e").alias("seed"))
    return r.join(seed, "ambiguous_name").select("rid", F.round(text.sparse_cosine(F.col("terms"), F.col("seed")), 6).alias("cosine"))


def q_document_text(spark, sf_dir):
    return bib(spark, sf_dir).select("rid", text.document_text(F.col("title"), F.col("venue")).alias("text"))


def q_fingerprint(spark, sf_dir):
    return embedding.row_digests(bib(spark, sf_dir).withColumnRenamed("rid", "row_index"))


def q_embedding_fingerprint(spark, sf_dir):
    made = embedding.fingerprint(bib(spark, sf_dir).withColumnRenamed("rid", "row_index"), "hashing-64", 256)
    return spark.createDataFrame([(made,)], "fingerprint string")


def q_parse_decision(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", D.parse_decision(F.col("answer")).alias("d")).select("conv_id", "turn", F.col("d").isNotNull().alias("valid"), "d.same_author", F.col("d.same_author_probability").alias("p"), "d.reason")


def answers(spark, sf_dir):
    """Judge answers of many forms, good and bad, made up from turns."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    k = (F.col("conv_id") * 8 + F.col("turn")) % 12
    p = (F.col("conv_id") % 11 / 10).cast("string")
    same = F.when(F.col("conv_id") % 11 > 5, "true").otherwise("false")
    plain = F.concat(F.lit('{"same_author":'), same, F.lit(',"same_author_probability":'), p, F.lit(',"reason":" '), F.col("role"), F.lit(' "}'))
    answer = (
        F.when(k == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("```json "), plain, F.lit("```")))
        .when(k == 2, F.regexp_replace(plain, "true|false", '"true"'))
        .when(k == 3, F.concat(F.lit("["), plain, F.lit("]")))
        .when(k == 4, F.lit('{"same_author":true,"same_author_probability":true,"reason":"x"}'))
        .when(k == 5, F.lit('{"same_author":true,"same_author_probability":1.2,"reason":"x"}'))
        .when(k == 6, F.lit('{"same_author":true,"same_author_probability":0.5,"reason":"x"}'))
        .when(k == 7, F.lit('{"same_author":false,"same_author_probability":0,"reason":"  "}'))
        .when(k == 8, F.lit("no json"))
        .otherwise(plain)
    )
    return c.select("conv_id", "turn", answer.alias("answer"))


# --- metrics


def q_contingency(spark, sf_dir):
    return metrics.contingency(base_pairs(spark, sf_dir))


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def q_pairwise(spark, sf_dir):
    return _rounded(metrics.pairwise(base_pairs(spark, sf_dir)))


def q_bcubed(spark, sf_dir):
    return _rounded(metrics.bcubed(base_pairs(spark, sf_dir)))


def q_purity(spark, sf_dir):
    return _rounded(metrics.purity_by_block(base_pairs(spark, sf_dir)))


def q_evaluate(spark, sf_dir):
    return _rounded(metrics.evaluate(base_pairs(spark, sf_dir)))


def q_confusion(spark, sf_dir):
    return metrics.confusion_by_block(base_pairs(spark, sf_dir))


def q_error_changes(spark, sf_dir):
    return metrics.error_changes(predicted(spark, sf_dir))


def q_statistics(spark, sf_dir):
    return _rounded(metrics.statistics(predicted(spark, sf_dir)))


def q_method_deltas(spark, sf_dir):
    p = predicted(spark, sf_dir)
    scores = None
    for m in ("base", "extension"):
        pairs = p.select("block", "label", F.col(m).alias("cluster"))
        one = metrics.evaluate(pairs).select(F.lit(m).alias("method"), "pairwise_f1", "b3_f1", "predicted_clusters")
        scores = one if scores is None else scores.unionByName(one)
    return _rounded(metrics.method_deltas(scores, "base"))


def q_best_method(spark, sf_dir):
    """Of three predictors, two of them equal, the first with the best B-cubed F1."""
    p, scores = predicted(spark, sf_dir), None
    for position, m in enumerate(("base", "extension", "extension")):
        one = metrics.bcubed(p.select("block", "label", F.col(m).alias("cluster"))).select(F.lit(f"{m}-{position}").alias("method"), F.lit(position).alias("position"), F.round("b3_f1", 6).alias("b3_f1"))
        scores = one if scores is None else scores.unionByName(one)
    return metrics.best_method(scores)


def q_brier(spark, sf_dir):
    return _rounded(metrics.judged_counts(judged(spark, sf_dir), 0.7))


def q_bins(spark, sf_dir):
    return _rounded(metrics.confidence_bins(judged(spark, sf_dir)))


# --- alignment, order, samples


def q_align(spark, sf_dir):
    """Three runs over line items, numbered in different orders, matched by occurrence."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keyed = items.select(F.col("l_partkey").cast("string").alias("paper_id"), F.col("l_returnflag").alias("ambiguous_name"), F.col("l_suppkey").cast("string").alias("label"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_index"), "l_orderkey", "l_shipdate")
    runs = {
        "a": keyed.withColumn("predicted_cluster", F.col("l_orderkey").cast("string")),
        "b": keyed.withColumn("predicted_cluster", F.date_format("l_shipdate", "yyyy-MM")),
        "c": keyed.withColumn("predicted_cluster", (F.col("l_orderkey") % 10).cast("string")),
    }
    return alignment.aligned({k: v.select(*alignment.KEYS, "row_index", "predicted_cluster") for k, v in runs.items()}, "c")


def q_occurrence(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return occurrence(items, ["l_partkey", "l_returnflag"], "at").drop("at")


def q_missing_source(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keyed = items.select(F.col("l_partkey").alias("paper_id"), F.col("l_returnflag").alias("ambiguous_name"), F.col("l_linestatus").alias("label"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_index"))
    return alignment.unmatched(keyed, keyed.where("row_index % 3 <> 0"))


def q_block_sample(spark, sf_dir):
    return sample_blocks_by_hash(bib(spark, sf_dir).select("rid", "ambiguous_name"), 5)


def q_long_first(spark, sf_dir):
    r = bib(spark, sf_dir).select("rid", "ambiguous_name", names.is_long(text.tokens(F.col("author_name"))).alias("long_name"))
    return r.select("rid", F.row_number().over(Window.partitionBy("ambiguous_name").orderBy(F.col("long_name").desc(), "rid")).alias("place"))


def q_cluster_ids(spark, sf_dir):
    p = predicted(spark, sf_dir)
    n = F.dense_rank().over(Window.partitionBy("block").orderBy("base"))
    return p.select("rid", clusters.cluster_id(F.col("block"), n).alias("predicted_cluster"))


def q_group_examples(spark, sf_dir):
    p = predicted(spark, sf_dir).select("rid", "block", "label")
    return sampling.group_examples(sampling.blocks_with_authors(p, 2), 15, "rid").select("rid", "block", "label", "position")


def q_pair_sample(spark, sf_dir):
    return sampling.pair_sample(base_pairs(spark, sf_dir), 5)


def q_shared_coauthors(spark, sf_dir):
    r = bib(spark, sf_dir).select(F.col("ambiguous_name").alias("block"), "rid", names.keys_of_names("coauthors").alias("keys"))
    return sampling.shared_keys(r).withColumnRenamed("block", "ambiguous_name")


def q_cache_lookup(spark, sf_dir):
    """Keyed look-up of stored answers: hits with their value, misses without."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("key"))
    stored = d.where("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").alias("value"))
    return d.join(stored, "key", "left").select("doc_id", F.col("value").isNotNull().alias("hit"), "value")


# --- vectors and retrieval


def _scores(spark, sf_dir):
    return retrieval.centroid_scores(retrieval.centroids(vectors_of(spark, sf_dir)))


def q_centroids(spark, sf_dir):
    c = retrieval.centroids(vectors_of(spark, sf_dir))
    c = c.select("block", "cluster", "size", F.round(vectors.norm(F.col("centroid")), 6).alias("norm"), F.posexplode("centroid").alias("place", "v"))
    return c.select("block", "cluster", "size", "norm", "place", F.round("v", 6).alias("value"))


def q_centroid_cosine(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir))


def q_hybrid(spark, sf_dir):
    m = vectors_of(spark, sf_dir)
    return _rounded(retrieval.hybrid_scores(retrieval.centroids(m), m))


THRESHOLD = 0.05


def q_compatible(spark, sf_dir):
    return retrieval.compatible_pairs(vectors_of(spark, sf_dir))


def q_candidates(spark, sf_dir):
    scores = _rounded(_scores(spark, sf_dir))
    everyone = scores.select("block", "i", "j")
    return retrieval.candidates(retrieval.eligible(scores, everyone, THRESHOLD), 2)


def q_retrieval_diagnostics(spark, sf_dir):
    m = vectors_of(spark, sf_dir).withColumn("label", (F.col("vec_id") % 5 % 2).cast("string"))
    return retrieval.diagnostics(m, _rounded(_scores(spark, sf_dir)), THRESHOLD, 2, 1)


def q_ideal_label(spark, sf_dir):
    m = predicted(spark, sf_dir).select("block", F.col("author_name").alias("cluster"), F.when(F.col("rid") % 97 == 0, " ").otherwise(F.col("label")).alias("label"))
    c = m.select("block", "cluster").distinct()
    pairs = c.withColumnRenamed("cluster", "i").join(c.withColumnRenamed("cluster", "j"), "block").where("i < j")
    return retrieval.ideal_labels(pairs, m)


# --- the folds


def q_first_step(spark, sf_dir):
    return clusters.coauthor_clusters(clusters.prepared(records_for_folds(spark, sf_dir)))


def q_second_step(spark, sf_dir):
    return clusters.lexical(clusters.prepared(records_for_folds(spark, sf_dir)), 0.6, 0.9)


def q_lexical(spark, sf_dir):
    return clusters.lexical(clusters.prepared(records_for_folds(spark, sf_dir)))


def q_semantic_step(spark, sf_dir):
    r = records_for_folds(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    features = clusters.prepared(r).withColumn("vec_id", F.col("row_index") % n).join(v, "vec_id").drop("vec_id")
    return clusters.semantic(features, 0.6, 0.9, 0.5)


def _unresolved(spark, sf_dir):
    """Records without collaborators, so that many clusters are left for a judge."""
    r = kept(records_for_folds(spark, sf_dir).withColumn("coauthors", F.array().cast("array<string>")), "records")
    return embedding.encoded(r), clusters.lexical(clusters.prepared(r), 0.8, 1.1)


#: Every pair of clusters whose names and vectors fit is put to the judge: no cap on neighbours, none on comparisons.
WHOLE = judging.Settings(top_k=0, budget=0)


def _generative(spark, sf_dir):
    r, lexical = _unresolved(spark, sf_dir)
    return generative.generative(r, lexical, WHOLE, prompts=False)


def q_generative_step(spark, sf_dir):
    return _generative(spark, sf_dir).clusters


def q_decision_log(spark, sf_dir):
    return _generative(spark, sf_dir).log.drop("prompts", "seconds")


def q_threshold_sweep(spark, sf_dir):
    r, lexical = _unresolved(spark, sf_dir)
    return sweep(r, lexical, grid_of(judging.Settings(), (0.6, 0.8), (0.45, 0.55), (3, 5)), least_precision=0.0)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lexical clustering of all records, evaluated."""
    records = kept(records_for_folds(spark, sf_dir), "records")
    found = clusters.lexical(clusters.prepared(records))
    pairs = records.join(found.select("row_index", "predicted_cluster"), "row_index").select(F.col("ambiguous_name").alias("block"), "label", F.col("predicted_cluster").alias("cluster"))
    return metrics.evaluate(pairs)


def q_lexical_evaluated(spark, sf_dir):
    return _rounded(entry(spark, sf_dir))


def queries() -> dict:
    return {k.removeprefix("q_"): v for k, v in globals().items() if k.startswith("q_")}
