"""SQL for the registered queries that SQL can express; it enumerates pairs where the queries use closed forms."""

from __future__ import annotations

from ..functions.text import STOP_WORDS
from .queries import ADDED, NAMES, THRESHOLD

BIB = """
lines AS (
  SELECT l_orderkey, list_sort(list(DISTINCT s_name)) AS coauthors, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, p_name) AS title, min(p_type) AS venue
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
named AS (
  SELECT o_orderkey AS rid, CAST(o_orderkey AS VARCHAR) AS paper_id, CAST(o_custkey // 10 AS BIGINT) AS blk, o_custkey, coauthors, title, venue,
    ['alice', 'bruno', 'carla', 'dmitri', 'elena'][o_custkey % 5 + 1] AS g, ['silva', 'wang', 'muller', 'garcia', 'rossi', 'kim', 'novak'][(o_custkey // 10) % 7 + 1] AS f
  FROM orders JOIN lines ON o_orderkey = l_orderkey),
bib AS (
  SELECT rid, paper_id, 'block-' || blk AS ambiguous_name, 'cust-' || o_custkey AS label, coauthors, title, venue,
    CASE rid % 4 WHEN 0 THEN g || ' ' || f WHEN 1 THEN substr(g, 1, 1) || '. ' || f WHEN 2 THEN f || ', ' || g ELSE g || ' j ' || f END AS author_name
  FROM named)"""
PRED = f"""{BIB},
pred AS (SELECT rid, paper_id, ambiguous_name AS block, label, author_name, ambiguous_name || '/' || substr(author_name, 1, 1) AS base, ambiguous_name || '/' || venue AS extension FROM bib),
pairs AS (SELECT rid, block, label, base AS cluster FROM pred)"""
#: SQL macros as text: tokens of an ASCII name, and compatibility of two tokens.
TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
FITS = "({0} = {1} OR (substr({0}, 1, 1) = substr({1}, 1, 1) AND (length({0}) = 1 OR length({1}) = 1)))"
_KEYS = """CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) = 1 THEN ['only:' || {0}[1]] ELSE list_sort(list_distinct(list_concat(
    ['exact:' || array_to_string(list_sort({0}), ':')],
    list_filter(list_transform({0}, lambda t, i: CASE WHEN length(t) > 1 THEN 'part:' || t || ':' || array_to_string(list_sort(list_transform(list_filter({0}, lambda x, j: j <> i), lambda x: substr(x, 1, 1))), '') END), lambda k: k IS NOT NULL)))) END"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = f"list_filter(regexp_extract_all(lower(strip_accents({{0}})), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
# The fold by recursion: state (tokens of the shorter name by falling length, free tokens of the longer, still matching).
_SIMILAR = """
sim AS (
  SELECT a, b, ta, tb, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS short, CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END AS long FROM (SELECT DISTINCT a, b, ta, tb FROM cand)),
ordered AS (
  SELECT a, b, long, list_transform(list_sort(list_transform(short, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda s: s.t) AS todo, len(short) AS n FROM sim),
walk AS (
  SELECT a, b, todo, long AS free, n > 0 AND len(long) > 0 AS ok, 1 AS k, n FROM ordered
  UNION ALL
  SELECT a, b, todo, CASE WHEN hit IS NULL THEN free ELSE list_concat(free[:hit - 1], free[hit + 1:]) END, ok AND hit IS NOT NULL, k + 1, n
  FROM (SELECT *, list_min(list_filter(list_transform(free, lambda o, i: CASE WHEN {fits} THEN i END), lambda i: i IS NOT NULL)) AS hit FROM walk WHERE k <= n)),
verdict AS (SELECT a, b, ok FROM walk WHERE k = n + 1)""".format(fits=FITS.format("todo[k]", "o"))

VEC = f"""
vec AS (
  SELECT vec_id, CAST(vec_id // 25 AS BIGINT) AS block, vec_id % 5 AS cluster, {list(NAMES)}[vec_id % {len(NAMES)} + 1] AS name, CAST(label AS VARCHAR) AS label, embedding FROM embeddings),
summed AS (SELECT block, cluster, pos, sum(CAST(v AS DOUBLE)) AS v, count(*) AS size FROM (SELECT block, cluster, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM vec) GROUP BY ALL),
cent AS (SELECT block, cluster, max(size) AS size, list(v ORDER BY pos) AS c FROM summed GROUP BY ALL),
scores AS (SELECT a.block, a.cluster AS i, b.cluster AS j, round(list_cosine_similarity(a.c, b.c), 6) AS score FROM cent a JOIN cent b ON a.block = b.block AND a.cluster < b.cluster)"""
CHOSEN = f"""
above AS (SELECT * FROM scores WHERE score >= {THRESHOLD}),
sides AS (SELECT block, i, j, score, i AS own, j AS other FROM above UNION ALL SELECT block, i, j, score, j, i FROM above),
ranked AS (SELECT *, row_number() OVER (PARTITION BY block, own ORDER BY score DESC, other) AS n FROM sides),
chosen AS (SELECT block, i, j, score, row_number() OVER (PARTITION BY block ORDER BY score DESC, i, j) AS position FROM (SELECT DISTINCT block, i, j, score FROM ranked WHERE n <= 2))"""
COMPATIBLE = f"""
nm AS (SELECT DISTINCT block, cluster, name FROM vec),
cand AS (SELECT x.block, x.cluster AS i, y.cluster AS j, x.name AS a, y.name AS b, {TOKENS.format("x.name")} AS ta, {TOKENS.format("y.name")} AS tb FROM nm x JOIN nm y ON x.block = y.block AND x.cluster < y.cluster),
{_SIMILAR},
fit AS (SELECT block, i, j FROM cand JOIN verdict ON cand.a = verdict.a AND cand.b = verdict.b GROUP BY ALL HAVING bool_and(ok))"""

TRI = """
  SELECT count(*) FILTER (WHERE s AND c) AS tp, count(*) FILTER (WHERE c) AS predicted, count(*) FILTER (WHERE s) AS actual
  FROM (SELECT a.label = b.label AS s, a.cluster = b.cluster AS c FROM pairs a JOIN pairs b ON a.rid < b.rid AND (a.label = b.label OR a.cluster = b.cluster))"""
SCORED = """
cells AS (SELECT label, cluster, count(*) AS n FROM pairs GROUP BY ALL),
sized AS (SELECT *, sum(n) OVER (PARTITION BY label) AS ln, sum(n) OVER (PARTITION BY cluster) AS cn FROM cells),
pr AS (SELECT sum(n * (n - 1) // 2) AS tp, (SELECT sum(k * (k - 1) // 2) FROM (SELECT sum(n) AS k FROM cells GROUP BY cluster)) AS pp, (SELECT sum(k * (k - 1) // 2) FROM (SELECT sum(n) AS k FROM cells GROUP BY label)) AS tt FROM cells),
pw AS (SELECT CASE WHEN pp = 0 THEN 1.0 ELSE tp / pp END AS p, CASE WHEN tt = 0 THEN 1.0 ELSE tp / tt END AS r FROM pr),
bc AS (SELECT sum(n * n / cn) / sum(n) AS p, sum(n * n / ln) / sum(n) AS r FROM sized),
bcells AS (SELECT block, label, cluster, count(*) AS n FROM pairs GROUP BY ALL),
bsized AS (SELECT *, sum(n) OVER (PARTITION BY block, label) AS ln, sum(n) OVER (PARTITION BY block, cluster) AS cn FROM bcells),
pu AS (SELECT block, acp, aap, sqrt(acp * aap) AS k FROM (SELECT block, sum(n * n / cn) / sum(n) AS acp, sum(n * n / ln) / sum(n) AS aap FROM bsized GROUP BY block))"""
_F1 = "CASE WHEN {0}.p + {0}.r = 0 THEN 0.0 ELSE 2 * {0}.p * {0}.r / ({0}.p + {0}.r) END"
JUDGED = """
j AS (SELECT event_id % 11 <> 0 AS valid, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 3 = 0 END AS label, (event_id * 37 % 101) / 100.0::DOUBLE AS p FROM events),
k AS (SELECT label, p, p > 0.5 AND p >= 0.7 AS acc FROM j WHERE valid AND label IS NOT NULL)"""


RATES = ("pw.p AS pairwise_precision", "pw.r AS pairwise_recall", _F1.format("pw") + " AS pairwise_f1", "bc.p AS b3_precision", "bc.r AS b3_recall", _F1.format("bc") + " AS b3_f1")


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, 6) AS {c.split(' AS ')[1]}" for c in columns)


EVALUATED = f"""SELECT (SELECT count(*) FROM pairs) AS records, (SELECT count(DISTINCT label) FROM pairs) AS true_authors, (SELECT count(DISTINCT cluster) FROM pairs) AS predicted_clusters, {rounded(*RATES)},
  (SELECT round(avg(acp), 6) FROM pu) AS average_cluster_purity, (SELECT round(avg(aap), 6) FROM pu) AS average_author_purity, (SELECT round(avg(k), 6) FROM pu) AS k_metric FROM pw, bc"""

# --- the folds

#: The first fold, one record of every block at a time. State: clusters' first names, the keys they hold, their members' places.
FOLDED = f"""{BIB},
n AS (SELECT DISTINCT ambiguous_name, author_name FROM bib),
cand AS (SELECT x.ambiguous_name, x.author_name AS a, y.author_name AS b, {TOKENS.format("x.author_name")} AS ta, {TOKENS.format("y.author_name")} AS tb FROM n x JOIN n y ON x.ambiguous_name = y.ambiguous_name),
{_SIMILAR},
allowed AS (SELECT cand.ambiguous_name, cand.a, list(DISTINCT cand.b) AS fits FROM cand JOIN verdict ON cand.a = verdict.a AND cand.b = verdict.b WHERE ok GROUP BY ALL),
s AS (SELECT rid, regexp_extract_all(lower(unnest(coauthors)), '[a-z0-9]+') AS ts FROM bib),
keyed AS (SELECT rid, list(DISTINCT key) AS keys FROM (SELECT rid, unnest({_KEYS.format("ts")}) AS key FROM s) GROUP BY rid),
recs AS (
  SELECT bib.rid, bib.ambiguous_name, author_name, title, venue, coalesce(keys, []) AS keys, coalesce(fits, []) AS fits,
    row_number() OVER (PARTITION BY bib.ambiguous_name ORDER BY len(list_filter({TOKENS.format("author_name")}, lambda t: length(t) > 1)) > 1 DESC, bib.rid) AS place
  FROM bib LEFT JOIN keyed ON bib.rid = keyed.rid LEFT JOIN allowed ON allowed.ambiguous_name = bib.ambiguous_name AND allowed.a = author_name),
fold AS (
  SELECT ambiguous_name, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS rid, CAST(0 AS BIGINT) AS cluster_no, CAST([] AS VARCHAR[]) AS firsts, CAST([] AS VARCHAR[][]) AS held, CAST([] AS BIGINT[][]) AS members
  FROM (SELECT DISTINCT ambiguous_name FROM recs)
  UNION ALL
  SELECT ambiguous_name, k + 1, new_rid, coalesce(hit, len(firsts) + 1),
    CASE WHEN hit IS NULL THEN list_append(firsts, author_name) ELSE firsts END,
    CASE WHEN hit IS NULL THEN list_append(held, keys) ELSE list_transform(held, lambda h, i: CASE WHEN i = hit THEN list_concat(h, keys) ELSE h END) END,
    CASE WHEN hit IS NULL THEN list_append(members, [k + 1]) ELSE list_transform(members, lambda h, i: CASE WHEN i = hit THEN list_append(h, k + 1) ELSE h END) END
  FROM (
    SELECT f.ambiguous_name, f.k, f.firsts, f.held, f.members, r.rid AS new_rid, r.author_name, r.keys,
      list_min(list_filter(list_transform(f.firsts, lambda b, i: CASE WHEN list_contains(r.fits, b) AND list_has_any(f.held[i], r.keys) THEN i END), lambda i: i IS NOT NULL)) AS hit
    FROM fold f JOIN recs r ON r.ambiguous_name = f.ambiguous_name AND r.place = f.k + 1))"""
_ACROSS = "list_sum(list_transform({0}, lambda p: list_sum(list_transform({1}, lambda q: {2}[p][q]))))"


def _cosine(matrix: str) -> str:
    dot, left, right = (_ACROSS.format(a, b, matrix) for a, b in (("x.seed", "y.seed"), ("x.seed", "x.seed"), ("y.seed", "y.seed")))
    return f"(CASE WHEN {left} = 0 OR {right} = 0 THEN 0.0 ELSE {dot} / (sqrt(CAST({left} AS DOUBLE)) * sqrt(CAST({right} AS DOUBLE))) END)"


LEXICAL = "m.f[x.seed[1]][y.seed[1]] AND ({t} > {{title}} OR {v} > {{venue}})".format(t=_cosine("m.t"), v=_cosine("m.v"))
SEMANTIC = LEXICAL[:-1] + f" OR {_cosine('m.e')} > 0.5)"
NUMBERED = " SELECT rid AS row_index, ambiguous_name, CAST(cluster_no AS INT) AS cluster_no, printf('%s::%04d', ambiguous_name, cluster_no) AS predicted_cluster FROM done"


def merged(link: str, title: float, venue: float) -> str:
    """The second fold: a step lets one cluster of every block take in later ones, from left to right, until a pass changes nothing.

    Clusters are lists of places; m holds the records' dot products, so that sums over members are those of merged vectors.
    Terms are unstemmed: over the words of these tables stemming changes no word into another's stem.
    """
    linked = link.format(title=title, venue=venue)
    own = "[{'seed': s.clusters[least(s.i, len(s.clusters))], 'rest': CAST([] AS BIGINT[][])}]"
    later = "list_transform(s.clusters[s.i + 1:], lambda c: {'seed': c, 'rest': CAST([] AS BIGINT[][])})"
    return f"""WITH RECURSIVE {FOLDED},
tt AS (SELECT rid, ambiguous_name, term, count(*) AS n FROM (SELECT rid, ambiguous_name, unnest({_WORDS.format("title")}) AS term FROM bib) GROUP BY ALL),
vt AS (SELECT rid, ambiguous_name, term, count(*) AS n FROM (SELECT rid, ambiguous_name, unnest({_WORDS.format("venue")}) AS term FROM bib) GROUP BY ALL),
td AS (SELECT a.rid AS ra, b.rid AS rb, CAST(sum(a.n * b.n) AS BIGINT) AS dot FROM tt a JOIN tt b ON a.ambiguous_name = b.ambiguous_name AND a.term = b.term GROUP BY ALL),
vd AS (SELECT a.rid AS ra, b.rid AS rb, CAST(sum(a.n * b.n) AS BIGINT) AS dot FROM vt a JOIN vt b ON a.ambiguous_name = b.ambiguous_name AND a.term = b.term GROUP BY ALL),
given AS (SELECT recs.*, CAST(embedding AS DOUBLE[]) AS e FROM recs JOIN embeddings ON vec_id = rid % (SELECT count(*) FROM embeddings)),
grid AS (
  SELECT x.ambiguous_name, x.place AS pa, y.place AS pb, coalesce(td.dot, 0) AS t, coalesce(vd.dot, 0) AS v, list_contains(x.fits, y.author_name) AS f, {"list_inner_product(x.e, y.e)" if "m.e" in link else "0.0"} AS e
  FROM given x JOIN given y ON x.ambiguous_name = y.ambiguous_name LEFT JOIN td ON td.ra = x.rid AND td.rb = y.rid LEFT JOIN vd ON vd.ra = x.rid AND vd.rb = y.rid),
m AS (
  SELECT ambiguous_name, list(t ORDER BY pa) AS t, list(v ORDER BY pa) AS v, list(f ORDER BY pa) AS f, list(e ORDER BY pa) AS e
  FROM (SELECT ambiguous_name, pa, list(t ORDER BY pb) AS t, list(v ORDER BY pb) AS v, list(f ORDER BY pb) AS f, list(e ORDER BY pb) AS e FROM grid GROUP BY ALL) GROUP BY ambiguous_name),
step AS (
  SELECT ambiguous_name, CAST(1 AS BIGINT) AS i, arg_max(members, k) AS clusters, false AS grew FROM fold GROUP BY ambiguous_name
  UNION ALL
  SELECT ambiguous_name, CASE WHEN i > len(clusters) THEN 1 ELSE i + 1 END, CASE WHEN i > len(clusters) THEN clusters ELSE list_concat(clusters[1:i - 1], [r.seed], r.rest) END,
    CASE WHEN i > len(clusters) THEN false ELSE grew OR len(r.rest) < len(clusters) - i END
  FROM (
    SELECT s.ambiguous_name, s.i, s.clusters, s.grew,
      list_reduce(list_concat({own}, {later}), lambda x, y: CASE WHEN {linked} THEN {{'seed': list_concat(x.seed, y.seed), 'rest': x.rest}} ELSE {{'seed': x.seed, 'rest': list_append(x.rest, y.seed)}} END) AS r
    FROM step s JOIN m ON m.ambiguous_name = s.ambiguous_name WHERE s.i <= len(s.clusters) OR s.grew)),
last AS (SELECT ambiguous_name, unnest(clusters) AS c, unnest(range(1, len(clusters) + 1)) AS cluster_no FROM step WHERE i > len(clusters) AND NOT grew),
done AS (SELECT recs.rid, recs.ambiguous_name, cluster_no FROM (SELECT ambiguous_name, cluster_no, unnest(c) AS place FROM last) l JOIN recs ON recs.ambiguous_name = l.ambiguous_name AND recs.place = l.place)"""


def oracle_sql() -> dict[str, str]:
    own = TOKENS.format("author_name")
    sql = {
        "name_tokens": f"WITH {BIB} SELECT rid, array_to_string({own}, ' ') AS tokens, CAST(len({own}) AS INT) AS n_tokens FROM bib",
        "long_name": f"WITH {BIB} SELECT rid, len(list_filter({own}, lambda t: length(t) > 1)) > 1 AS long_name FROM bib",
        "coauthor_keys": f"WITH {BIB}, t AS (SELECT rid, {own} AS ts FROM bib) SELECT rid, array_to_string({_KEYS.format('ts')}, '|') AS keys FROM t",
        "token_compatible": f"WITH {BIB}, t AS (SELECT DISTINCT unnest({own}) AS t FROM bib) SELECT a.t AS a, b.t AS b FROM t a, t b WHERE {FITS.format('a.t', 'b.t')}",
        "names_similar": f"WITH RECURSIVE {BIB}, n AS (SELECT DISTINCT ambiguous_name, author_name FROM bib), cand AS (SELECT x.ambiguous_name, x.author_name AS a, y.author_name AS b, {TOKENS.format('x.author_name')} AS ta, {TOKENS.format('y.author_name')} AS tb FROM n x JOIN n y ON x.ambiguous_name = y.ambiguous_name), {_SIMILAR} SELECT cand.ambiguous_name, cand.a, cand.b, ok AS fits FROM cand JOIN verdict ON cand.a = verdict.a AND cand.b = verdict.b",
        "focal_exclusion": f"""
WITH RECURSIVE {BIB},
e AS (SELECT rid, author_name, unnest(list_concat(coauthors, {list(ADDED)}, [author_name])) AS c FROM bib),
cand AS (SELECT DISTINCT c AS a, author_name AS b, {TOKENS.format("c")} AS ta, {TOKENS.format("author_name")} AS tb FROM e),
{_SIMILAR}
SELECT rid, coalesce(string_agg(c, '|' ORDER BY c), '') AS others, CAST(count(c) AS INT) AS n_others
FROM (SELECT e.rid, CASE WHEN NOT ok THEN c END AS c FROM e JOIN verdict ON e.c = verdict.a AND e.author_name = verdict.b) GROUP BY rid""",
        "doc_normalize": "SELECT doc_id, md5(lower(strip_accents(text))) AS folded_md5 FROM documents",
        "doc_terms": f"WITH t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_words, CAST(sum(tf * tf) AS BIGINT) AS square, list(term ORDER BY tf DESC, term DESC)[1] AS top_term FROM c GROUP BY doc_id",
        "term_cosine": f"""
WITH {BIB}, w AS (SELECT ambiguous_name, rid, unnest({_WORDS.format("title")}) AS term FROM bib),
tf AS (SELECT ambiguous_name, rid, term, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT ambiguous_name, min(rid) AS first FROM bib GROUP BY ALL),
z AS (SELECT rid, sum(tf * tf) AS sq FROM tf GROUP BY ALL),
d AS (SELECT a.rid, sum(a.tf * b.tf) AS dot FROM tf a JOIN f ON a.ambiguous_name = f.ambiguous_name JOIN tf b ON b.rid = f.first AND a.term = b.term GROUP BY a.rid)
SELECT bib.rid, round(coalesce(d.dot / sqrt(za.sq * zb.sq), 0.0), 6) AS cosine
FROM bib JOIN f ON bib.ambiguous_name = f.ambiguous_name LEFT JOIN d ON d.rid = bib.rid LEFT JOIN z za ON za.rid = bib.rid LEFT JOIN z zb ON zb.rid = f.first""",
        "first_step": f"WITH RECURSIVE {FOLDED} SELECT rid AS row_index, ambiguous_name, CAST(cluster_no AS INT) AS cluster_no, printf('%s::%04d', ambiguous_name, cluster_no) AS predicted_cluster FROM fold WHERE rid IS NOT NULL",
        "second_step": merged(LEXICAL, 0.6, 0.9) + NUMBERED,
        "lexical": merged(LEXICAL, 0.3, 0.5) + NUMBERED,
        "lexical_evaluated": f"""{merged(LEXICAL, 0.3, 0.5)},
pairs AS (SELECT done.rid, done.ambiguous_name AS block, bib.label, printf('%s::%04d', done.ambiguous_name, cluster_no) AS cluster FROM done JOIN bib ON done.rid = bib.rid), {SCORED} {EVALUATED}""",
        "semantic_step": merged(SEMANTIC, 0.6, 0.9) + NUMBERED,
        "embedding_fingerprint": f"""
WITH {BIB}, d AS (SELECT rid, sha256(paper_id || chr(0) || 'Title: ' || trim(title) || CASE WHEN trim(venue) = '' THEN '' ELSE chr(10) || 'Venue: ' || trim(venue) END || chr(0)) AS digest FROM bib),
s AS (SELECT rid // 4096 AS span, sha256(string_agg(digest, '' ORDER BY rid)) AS digest FROM d GROUP BY ALL),
w AS (SELECT span // 4096 AS wide, sha256(string_agg(digest, '' ORDER BY span)) AS digest FROM s GROUP BY ALL)
SELECT sha256('hashing-64' || chr(0) || '256' || chr(0) || string_agg(digest, chr(0) ORDER BY wide)) AS fingerprint FROM w""",
        "document_text": f"WITH {BIB} SELECT rid, 'Title: ' || trim(title) || CASE WHEN trim(venue) = '' THEN '' ELSE chr(10) || 'Venue: ' || trim(venue) END AS text FROM bib",
        "fingerprint": f"WITH {BIB} SELECT rid AS row_index, sha256(paper_id || chr(0) || 'Title: ' || trim(title) || CASE WHEN trim(venue) = '' THEN '' ELSE chr(10) || 'Venue: ' || trim(venue) END || chr(0)) AS digest FROM bib",
        "parse_decision": """
WITH c AS (SELECT conv_id, turn, role, (conv_id * 8 + turn) % 12 AS k, conv_id % 11 AS n FROM conversations)
SELECT conv_id, turn, k = 0 OR k > 8 AS valid, CASE WHEN k = 0 OR k > 8 THEN n > 5 END AS same_author, CASE WHEN k = 0 OR k > 8 THEN n / 10.0::DOUBLE END AS p, CASE WHEN k = 0 OR k > 8 THEN role END AS reason FROM c""",
        "contingency": f"WITH {PRED}, {SCORED} SELECT label, cluster, n, CAST(ln AS BIGINT) AS label_size, CAST(cn AS BIGINT) AS cluster_size FROM sized",
        "pairwise": f"WITH {PRED}, t AS ({TRI}), pw AS (SELECT CASE WHEN predicted = 0 THEN 1.0 ELSE tp / predicted END AS p, CASE WHEN actual = 0 THEN 1.0 ELSE tp / actual END AS r FROM t) SELECT {rounded('p AS pairwise_precision', 'r AS pairwise_recall', _F1.format('pw') + ' AS pairwise_f1')} FROM pw",
        "bcubed": f"WITH {PRED}, {SCORED} SELECT {rounded('p AS b3_precision', 'r AS b3_recall', _F1.format('bc') + ' AS b3_f1')} FROM bc",
        "purity": f"WITH {PRED}, {SCORED} SELECT block, {rounded('acp AS acp', 'aap AS aap', 'k AS k')} FROM pu",
        "evaluate": f"WITH {PRED}, {SCORED} {EVALUATED}",
        "confusion": f"WITH {PRED}, t AS (SELECT a.label = b.label AS s, a.cluster = b.cluster AS c FROM pairs a JOIN pairs b ON a.block = b.block AND a.rid < b.rid) SELECT count(*) FILTER (WHERE s AND c) AS tp, count(*) FILTER (WHERE NOT s AND c) AS fp, count(*) FILTER (WHERE s AND NOT c) AS fn, count(*) FILTER (WHERE NOT s AND NOT c) AS tn FROM t",
        "error_changes": f"WITH {PRED}, t AS (SELECT a.label = b.label AS s, a.base = b.base AS x, a.extension = b.extension AS y FROM pred a JOIN pred b ON a.block = b.block AND a.rid < b.rid) SELECT count(*) FILTER (WHERE NOT s AND x AND NOT y) AS merges_corrected, count(*) FILTER (WHERE NOT s AND NOT x AND y) AS merges_introduced, count(*) FILTER (WHERE s AND NOT x AND y) AS splits_corrected, count(*) FILTER (WHERE s AND x AND NOT y) AS splits_introduced FROM t",
        "statistics": f"WITH {PRED}, b AS (SELECT block, count(*) AS n, count(DISTINCT label) AS a FROM pred GROUP BY block), l AS (SELECT label, count(*) AS n FROM pred GROUP BY label) SELECT (SELECT count(*) FROM pred) AS records, (SELECT count(DISTINCT paper_id) FROM pred) AS papers, (SELECT count(DISTINCT block) FROM pred) AS blocks, (SELECT count(DISTINCT label) FROM pred) AS authors, min(a) AS authors_per_block_min, max(a) AS authors_per_block_max, round(avg(a), 6) AS authors_per_block_mean, min(n) AS records_per_block_min, max(n) AS records_per_block_max, round(avg(n), 6) AS records_per_block_mean, (SELECT min(n) FROM l) AS records_per_author_min, (SELECT max(n) FROM l) AS records_per_author_max, (SELECT round(avg(n), 6) FROM l) AS records_per_author_mean FROM b",
    }
    one = "WITH {p}, {s} SELECT '{m}' AS method, {f} AS pairwise_f1, {g} AS b3_f1, (SELECT count(DISTINCT cluster) FROM pairs) AS predicted_clusters FROM pw, bc"
    parts = []
    for m in ("base", "extension"):
        p = PRED.replace("base AS cluster", f"{m} AS cluster")
        parts.append(f"SELECT * FROM ({one.format(p=p, s=SCORED, m=m, f=_F1.format('pw'), g=_F1.format('bc'))})")
    sql |= {
        "method_deltas": f"WITH s AS ({' UNION ALL '.join(parts)}), b AS (SELECT * FROM s WHERE method = 'base') SELECT s.method, round(s.pairwise_f1, 6) AS pairwise_f1, round(s.b3_f1, 6) AS b3_f1, s.predicted_clusters, round((s.pairwise_f1 - b.pairwise_f1) * 100, 6) AS pairwise_f1_points, round((s.b3_f1 - b.b3_f1) * 100, 6) AS b3_f1_points, s.predicted_clusters - b.predicted_clusters AS clusters_delta FROM s, b",
        "best_method": "SELECT method AS best FROM (" + " UNION ALL ".join(
            f"SELECT '{m}-{k}' AS method, {k} AS position, b3_f1 FROM (WITH {PRED.replace('base AS cluster', f'{m} AS cluster')}, {SCORED} SELECT round({_F1.format('bc')}, 6) AS b3_f1 FROM bc)" for k, m in enumerate(("base", "extension", "extension"))
        ) + ") ORDER BY b3_f1 DESC, position LIMIT 1",
        "brier": f"WITH {JUDGED} SELECT count(*) AS comparisons, count(*) FILTER (WHERE acc AND label) AS tp, count(*) FILTER (WHERE acc AND NOT label) AS fp, count(*) FILTER (WHERE NOT acc AND label) AS fn, count(*) FILTER (WHERE NOT acc AND NOT label) AS tn, round(avg((p - label::INT) * (p - label::INT)), 6) AS brier_score, round(count(*) FILTER (WHERE acc AND label) / count(*) FILTER (WHERE label), 6) AS recall FROM k",
        "bins": f"WITH {JUDGED}, g AS (SELECT least(9, CAST(floor(p * 10) AS INT)) AS b, count(*) AS n, avg(p) AS m, avg(label::INT) AS o FROM k GROUP BY 1) SELECT round(i / 10.0::DOUBLE, 6) AS lower, round((i + 1) / 10.0::DOUBLE, 6) AS upper, coalesce(n, 0) AS count, round(m, 6) AS mean_probability, round(o, 6) AS observed_same_author_rate FROM (SELECT unnest(range(10)) AS i) LEFT JOIN g ON i = b",
        "align": """
WITH i AS (SELECT CAST(l_partkey AS VARCHAR) AS paper_id, l_returnflag AS ambiguous_name, CAST(l_suppkey AS VARCHAR) AS label, l_orderkey * 8 + l_linenumber AS pos, l_orderkey, l_shipdate FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, ambiguous_name, label ORDER BY pos) - 1 AS occurrence FROM i),
c AS (SELECT *, row_number() OVER (PARTITION BY paper_id, ambiguous_name, label ORDER BY pos) - 1 AS occurrence FROM i)
SELECT c.paper_id, c.ambiguous_name, c.label, CAST(c.occurrence AS INT) AS occurrence, CAST(c.l_orderkey % 10 AS VARCHAR) AS cluster_c, CAST(f.l_orderkey AS VARCHAR) AS cluster_a, strftime(f.l_shipdate, '%Y-%m') AS cluster_b
FROM c JOIN f ON c.paper_id = f.paper_id AND c.ambiguous_name = f.ambiguous_name AND c.label = f.label AND c.occurrence = f.occurrence""",
        "occurrence": "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS INT) AS occurrence FROM lineitem",
        "missing_source": """
WITH k AS (SELECT l_partkey AS paper_id, l_returnflag AS ambiguous_name, l_linestatus AS label, l_orderkey * 8 + l_linenumber AS row_index FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY paper_id, ambiguous_name, label ORDER BY row_index) - 1 AS occurrence FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, ambiguous_name, label ORDER BY row_index) - 1 AS occurrence FROM k WHERE row_index % 3 <> 0)
SELECT paper_id, ambiguous_name, label, CAST(occurrence AS INT) AS occurrence, row_index FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.paper_id = l.paper_id AND r.ambiguous_name = l.ambiguous_name AND r.label = l.label AND r.occurrence = l.occurrence)""",
        "block_sample": f"WITH {BIB}, n AS (SELECT DISTINCT ambiguous_name FROM bib ORDER BY md5('42:' || ambiguous_name), ambiguous_name LIMIT 5) SELECT rid, ambiguous_name FROM bib WHERE ambiguous_name IN (SELECT ambiguous_name FROM n)",
        "long_first": f"WITH {BIB}, t AS (SELECT rid, ambiguous_name, len(list_filter({own}, lambda t: length(t) > 1)) > 1 AS l FROM bib) SELECT rid, CAST(row_number() OVER (PARTITION BY ambiguous_name ORDER BY l DESC, rid) AS INT) AS place FROM t",
        "cluster_ids": f"WITH {PRED} SELECT rid, printf('%s::%04d', block, dense_rank() OVER (PARTITION BY block ORDER BY base)) AS predicted_cluster FROM pred",
        "group_examples": f"WITH {PRED}, m AS (SELECT block FROM pred GROUP BY block HAVING count(DISTINCT label) >= 2), f AS (SELECT rid, block, label, row_number() OVER (PARTITION BY block, label ORDER BY rid) = 1 AS first FROM pred WHERE block IN (SELECT block FROM m)), p AS (SELECT rid, block, label, CAST(row_number() OVER (PARTITION BY block ORDER BY first DESC, rid) AS INT) AS position FROM f) SELECT * FROM p WHERE position <= 15",
        "pair_sample": f"WITH {PRED}, t AS (SELECT CASE WHEN a.label = b.label AND a.cluster = b.cluster THEN 'TP' WHEN a.label = b.label THEN 'FN' WHEN a.cluster = b.cluster THEN 'FP' ELSE 'TN' END AS outcome, a.rid AS left_id, b.rid AS right_id FROM pairs a JOIN pairs b ON a.block = b.block AND a.rid < b.rid), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY outcome ORDER BY md5('42:' || left_id || ':' || right_id), left_id, right_id) AS INT) AS place FROM t) SELECT * FROM r WHERE place <= 5",
        "shared_coauthors": f"WITH {BIB}, s AS (SELECT ambiguous_name, rid, regexp_extract_all(lower(unnest(coauthors)), '[a-z0-9]+') AS ts FROM bib), k AS (SELECT DISTINCT ambiguous_name, rid, unnest({_KEYS.format('ts')}) AS key FROM s) SELECT x.ambiguous_name, x.rid AS a, y.rid AS b, count(*) AS shared FROM k x JOIN k y ON x.ambiguous_name = y.ambiguous_name AND x.key = y.key AND x.rid < y.rid GROUP BY ALL",
        "cache_lookup": "WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents), s AS (SELECT key, min(doc_id) AS value FROM d WHERE doc_id % 3 = 0 GROUP BY key) SELECT doc_id, value IS NOT NULL AS hit, value FROM d LEFT JOIN s ON d.key = s.key",
        "centroids": f"WITH {VEC} SELECT block, cluster, size, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS norm, CAST(unnest(range(len(c))) AS INT) AS place, round(unnest(c), 6) AS value FROM cent",
        "centroid_cosine": f"WITH {VEC} SELECT * FROM scores",
        "hybrid": f"WITH {VEC}, m AS (SELECT a.block, a.cluster AS i, b.cluster AS j, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS best FROM vec a JOIN vec b ON a.block = b.block AND a.cluster < b.cluster GROUP BY ALL) SELECT s.block, s.i, s.j, round(greatest(s.score, m.best), 6) AS score FROM scores s JOIN m ON s.block = m.block AND s.i = m.i AND s.j = m.j",
        "compatible": f"WITH RECURSIVE {VEC}, {COMPATIBLE} SELECT * FROM fit",
        "candidates": f"WITH {VEC}, {CHOSEN} SELECT block, i, j, score, CAST(position AS INT) AS position FROM chosen",
        "retrieval_diagnostics": f"WITH RECURSIVE {VEC}, {COMPATIBLE}, tru AS (SELECT a.block, a.cluster AS i, b.cluster AS j FROM cent a JOIN cent b ON a.block = b.block AND a.cluster < b.cluster AND a.cluster % 2 = b.cluster % 2), {CHOSEN.replace('FROM scores WHERE', 'FROM scores SEMI JOIN fit USING (block, i, j) WHERE')} SELECT (SELECT count(*) FROM tru) AS true_pairs, (SELECT count(*) FROM tru JOIN fit USING (block, i, j)) AS name_compatible_true_pairs, (SELECT count(*) FROM tru JOIN above USING (block, i, j)) AS semantic_true_pairs, (SELECT count(*) FROM tru JOIN chosen USING (block, i, j)) AS top_k_true_pairs, (SELECT count(*) FROM tru JOIN chosen USING (block, i, j) WHERE position <= 1) AS initial_budget_true_pairs, (SELECT count(*) FROM chosen) AS candidate_pairs",
        "ideal_label": f"WITH {PRED}, m AS (SELECT block, author_name AS cluster, CASE WHEN rid % 97 = 0 THEN '' ELSE label END AS label FROM pred), f AS (SELECT block, cluster, CASE WHEN min(label) = max(label) AND min(label) <> '' THEN min(label) END AS author FROM m GROUP BY ALL) SELECT x.block, x.cluster AS i, y.cluster AS j, x.author = y.author AS same_author FROM f x JOIN f y ON x.block = y.block AND x.cluster < y.cluster",
    }
    return sql
