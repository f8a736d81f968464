"""Queries on sample names: hints, votes, similarity, components, clusters and overrides (l)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import resolve as R
from . import carriers as c
from .registry import query

WITH = f"WITH {c.FILES} "
#: Names with enough likeness to test on, and few enough rows a file.
HINTS = f"WITH {c.NAMES}, named AS (SELECT *, regexp_replace(lower(trim(raw)), '[\\s\\-_()./:\\[\\]\\\\]+', '', 'g') AS name FROM hints) "
NAME_SET = HINTS + ", n AS (SELECT DISTINCT name FROM named), "
PAIR_SQL = "e AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name < b.name AND jaro_winkler_similarity(a.name, b.name) >= 0.9)"


def _names(spark, sf):
    return c.names(spark, sf).withColumn("name", N.normalize_name(F.col("raw")))


def _near(spark, sf):
    """Edges by one measure, so that SQL can follow."""
    n = _names(spark, sf).select("name").distinct()
    return n.select(F.col("name").alias("node")), R.name_edges(n, 0.9, winkler_only=True).select("a", "b")


@query("l01_hints", WITH + """, s AS (SELECT path, rel_path, string_split(rel_path, '/') AS p, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM files),
  h AS (SELECT path, 'filename_stem' AS source_tag, stem AS raw, 0.7::DOUBLE AS confidence FROM s
  UNION ALL SELECT path, 'filename_stem_cleaned', k, 0.7 FROM (SELECT path, stem, trim(regexp_replace(regexp_replace(stem, '[ _\\-]+(run|scan|rep|trial)[ _\\-]?[0-9]+\\s*$', '', 'i'), '[ _]+[0-9]{1,3}\\s*$', '')) AS k FROM s) WHERE k <> stem AND k <> ''
  UNION ALL SELECT path, CASE WHEN lower(f) IN ('xrd', 'raw data') THEN 'path_segment_generic' ELSE 'path_segment_d' || CAST(d AS VARCHAR) END, f, CASE WHEN lower(f) IN ('xrd', 'raw data') THEN 0.2 WHEN d = 0 THEN 0.8 ELSE 0.5 END FROM (SELECT path, p[-2] AS f, 0 AS d FROM s UNION ALL SELECT path, p[-3], 1 FROM s))
  SELECT * FROM h""")
def _(spark, sf):
    return R.extract_hints(c.files(spark, sf)).select(F.col("file_path").alias("path"), "source_tag", "raw", "confidence")


query("g08_name_votes", HINTS + "SELECT file_path, name, round(sum(confidence), 6) AS votes FROM named GROUP BY file_path, name")(lambda s, d: R.name_votes(c.names(s, d)).withColumn("votes", F.round("votes", 6)))
query("g10_name_aliases", HINTS + "SELECT name, list_sort(list(DISTINCT raw)) AS aliases FROM named GROUP BY name")(lambda s, d: R.name_aliases(c.names(s, d)))
query("j06_similar_names", NAME_SET + PAIR_SQL + " SELECT a, b FROM e")(lambda s, d: _near(s, d)[1])
query("j06_similar_words", f"WITH {c.WORDS} SELECT a.name AS a, b.name AS b FROM words a JOIN words b ON a.name < b.name AND jaro_winkler_similarity(a.name, b.name) >= 0.88")(
    lambda s, d: R.name_edges(c.words(s, d), 0.88, winkler_only=True).select("a", "b")
)
#: Longest common subsequence of x and y: rows of lengths as characters, from one character of x to the next.
LCS = "(ascii(right(list_reduce(string_split({x}, ''), lambda row, ch: list_reduce(list_transform(range(1, length({y}) + 1), lambda j: CAST(j AS VARCHAR)), lambda acc, j: acc || chr(greatest(ascii(right(acc, 1)), ascii(substr(row, CAST(j AS INTEGER) + 1, 1)), ascii(substr(row, CAST(j AS INTEGER), 1)) + CAST(substr({y}, CAST(j AS INTEGER), 1) = ch AS INTEGER))), '0'), repeat('0', length({y}) + 1)), 1)) - 48)"
SIMILAR = "greatest(jaro_winkler_similarity(a, b), 2.0 * " + LCS.format(x="a", y="b") + " / (length(a) + length(b)))"
query("l02_word_edges", f"WITH {c.WORDS}, p AS (SELECT a.name AS a, b.name AS b FROM words a JOIN words b ON a.name < b.name AND (jaro_winkler_similarity(a.name, b.name) >= 0.85 OR abs(length(a.name) - length(b.name)) <= 0.15 * (length(a.name) + length(b.name)))), s AS (SELECT a, b, {SIMILAR} AS similarity FROM p) SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.85")(
    lambda s, d: R.name_edges(c.words(s, d)).withColumn("similarity", F.round("similarity", 6))
)
WORD_FILES = "wf AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, lower(regexp_extract(text, '([A-Za-z]{2,})', 1)) AS name FROM documents WHERE regexp_extract(text, '([A-Za-z]{2,})', 1) <> '')"


@query("l04_word_clusters", f"WITH RECURSIVE {c.WORDS}, {WORD_FILES}, p AS (SELECT a.name AS a, b.name AS b FROM words a JOIN words b ON a.name < b.name AND (jaro_winkler_similarity(a.name, b.name) >= 0.85 OR abs(length(a.name) - length(b.name)) <= 0.15 * (length(a.name) + length(b.name)))), e AS MATERIALIZED (SELECT a, b FROM p WHERE {SIMILAR} >= 0.85), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT name AS a, name AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a), comp AS (SELECT a AS name, min(b) AS component FROM reach GROUP BY a) SELECT arg_min(name, lpad(CAST(length(name) AS VARCHAR), 6, '0') || name) AS canonical, count(DISTINCT file_path) AS files, count(DISTINCT name) AS forms FROM wf JOIN comp USING (name) GROUP BY component")
def _(spark, sf):
    """Files named by their first word, clustered end to end."""
    d = c.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lower(F.regexp_extract("text", "([A-Za-z]{2,})", 1)).alias("raw")).where("raw <> ''")
    found = R.clusters(d.withColumns({"confidence": F.lit(1.0), "seq": F.lit(0)}))
    return found.select("canonical", F.size("file_paths").cast("long").alias("files"), F.size("normalized_forms").cast("long").alias("forms"))


query("l02_name_edges")(lambda s, d: R.name_edges(_names(s, d).select("name")).withColumn("similarity", F.round("similarity", 6)))
REACH = "both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT name AS a, name AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"
RECURSIVE = NAME_SET.replace("WITH ", "WITH RECURSIVE ", 1) + PAIR_SQL + ", " + REACH
query("l03_components", RECURSIVE + " SELECT node, component FROM comp")(lambda s, d: R.components(*_near(s, d)))
VOTED = RECURSIVE + ", v AS (SELECT file_path, component, round(sum(confidence), 6) AS votes FROM named JOIN comp ON node = name GROUP BY file_path, component)"
query("g09_component_votes", VOTED + " SELECT * FROM v")(lambda s, d: R.name_votes(c.names(s, d)).join(R.components(*_near(s, d)).withColumnRenamed("node", "name"), "name").groupBy("file_path", "component").agg(F.round(F.sum("votes"), 6).alias("votes")))
query("w03_file_component", VOTED + ", b AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY votes DESC, component) AS r FROM v) SELECT file_path, component FROM b WHERE r = 1")(lambda s, d: R.assign_files(R.name_votes(c.names(s, d)), R.components(*_near(s, d))))
#: Files whose votes tie: two words of a document as hints of one weight, seen in the order of ids run backwards, which no alphabet follows.
TIED = """tied AS (SELECT 'f' || CAST(doc_id % 97 AS VARCHAR) AS file_path, lower(regexp_extract(text, '([A-Za-z]{2,})', 1)) AS raw, 0.5::DOUBLE AS confidence, -doc_id AS seq FROM documents WHERE regexp_extract(text, '([A-Za-z]{2,})', 1) <> '')"""


@query("w03_first_seen", f"WITH {TIED}, v AS (SELECT file_path, raw, sum(confidence) AS votes FROM tied GROUP BY ALL), o AS (SELECT raw, min(seq) AS ordinal FROM tied GROUP BY raw), b AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY votes DESC, ordinal) AS r FROM v JOIN o USING (raw)) SELECT file_path, raw AS component FROM b WHERE r = 1")
def _(spark, sf):
    """Each name a component of its own; most files have ties, which the name seen first wins."""
    raw = F.lower(F.regexp_extract("text", "([A-Za-z]{2,})", 1))
    h = c.read(spark, sf, "documents").select(F.concat(F.lit("f"), (F.col("doc_id") % 97).cast("string")).alias("file_path"), raw.alias("raw"), F.lit(0.5).alias("confidence"), (-F.col("doc_id")).alias("seq")).where("raw <> ''")
    votes = R.name_votes(h)
    comps = votes.select(F.col("name").alias("node"), F.col("name").alias("component")).distinct()
    return R.assign_files(votes, comps, R.first_seen(h, comps))


query("l04_clusters")(lambda s, d: R.clusters(c.names(s, d)))
query("g07_cluster_totals")(lambda s, d: R.clusters(c.names(s, d)).agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.size("file_paths")).alias("files")))
query("l10_project_clusters")(lambda s, d: R.clusters(R.extract_hints(c.files(s, d)), order=("file_path", "seq")))

# ---------------------------------------------------------------- overrides on given clusters: brands are clusters, parts their files

CLUSTERS = "c AS (SELECT p_brand AS canonical, list_sort(list(DISTINCT p_brand)) AS aliases, list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))) AS file_paths FROM part GROUP BY p_brand)"


def _clusters(spark, sf):
    return c.read(spark, sf, "part").groupBy(F.col("p_brand").alias("canonical")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"), F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))).alias("file_paths"))


def _decisions(spark, sf):
    p = c.read(spark, sf, "part")
    splits = p.where("p_partkey % 40 = 0").select(F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("new "), (F.col("p_partkey") % 3).cast("string")).alias("target")).distinct()
    brands = p.select("p_brand").distinct()
    merges = brands.where("p_brand like '%1' or p_brand like '%2'").select(F.right("p_brand", F.lit(1)).cast("int").alias("group_id"), F.ascii(F.substring("p_brand", -2, 1)).alias("pos"), F.col("p_brand").alias("name"))
    renames = brands.where("p_brand like '%3'").select(F.col("p_brand").alias("auto"), F.concat(F.lit("renamed "), F.right("p_brand", F.lit(2))).alias("new"))
    return renames, merges, splits


FLAT = "SELECT canonical, list_sort(list_distinct(flatten(list(aliases)))) AS aliases, list_sort(list_distinct(flatten(list(file_paths)))) AS file_paths FROM {} GROUP BY canonical"
SPLIT = "s AS (SELECT DISTINCT p_brand AS source, CAST(p_partkey AS VARCHAR) AS path, 'new ' || CAST(p_partkey % 3 AS VARCHAR) AS target FROM part WHERE p_partkey % 40 = 0), sf AS (SELECT canonical, aliases, unnest(file_paths) AS path FROM c), sm AS (SELECT coalesce(target, canonical) AS canonical, CASE WHEN target IS NULL THEN aliases ELSE [target] END AS aliases, [sf.path] AS file_paths FROM sf LEFT JOIN s ON s.source = canonical AND s.path = sf.path), c1 AS (" + FLAT.format("sm") + ")"
MERGE = "g AS (SELECT DISTINCT right(p_brand, 1) AS group_id, p_brand AS name FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2'), gt AS (SELECT group_id, arg_min(name, substr(name, length(name) - 1, 1)) AS target FROM g JOIN {0} ON canonical = name GROUP BY group_id HAVING count(*) >= 2), mm AS (SELECT coalesce(target, canonical) AS canonical, aliases, file_paths FROM {0} LEFT JOIN g ON name = canonical LEFT JOIN gt USING (group_id)), c2 AS (" + FLAT.format("mm") + ")"
RENAME = "rr AS (SELECT CASE WHEN canonical LIKE '%3' THEN 'renamed ' || right(canonical, 2) ELSE canonical END AS canonical, CASE WHEN canonical LIKE '%3' THEN list_append(aliases, 'renamed ' || right(canonical, 2)) ELSE aliases END AS aliases, file_paths FROM {}), c3 AS (" + FLAT.format("rr") + ")"
query("l05_splits", f"WITH {CLUSTERS}, {SPLIT} SELECT * FROM c1")(lambda s, d: R.apply_splits(_clusters(s, d), _decisions(s, d)[2]))
query("l06_merges", f"WITH {CLUSTERS}, {MERGE.format('c')} SELECT * FROM c2")(lambda s, d: R.apply_merges(_clusters(s, d), _decisions(s, d)[1]))
query("l07_renames", f"WITH {CLUSTERS}, {RENAME.format('c')} SELECT * FROM c3")(lambda s, d: R.apply_renames(_clusters(s, d), _decisions(s, d)[0]))
query("l08_decisions", f"WITH {CLUSTERS}, {SPLIT}, {MERGE.format('c1')}, {RENAME.format('c2').replace('canonical LIKE ', 'canonical LIKE ')} SELECT * FROM c3")(lambda s, d: R.apply_decisions(_clusters(s, d), *_decisions(s, d)))
query("l09_rename_edits", "SELECT DISTINCT p_brand AS auto, 'renamed ' || right(p_brand, 2) AS new FROM part WHERE p_brand LIKE '%3' AND p_brand NOT LIKE '%23' UNION ALL SELECT DISTINCT p_brand, 'edited' FROM part WHERE p_brand LIKE '%4'")(
    lambda s, d: R.with_rename(_decisions(s, d)[0], c.read(s, d, "part").where("p_brand like '%4' or p_brand like '%23'").select(F.col("p_brand").alias("auto"), F.when(F.col("p_brand").like("%4"), "edited").otherwise(" ").alias("new")).distinct())
)
query("l07_united_clusters", "SELECT 'brand ' || right(p_brand, 1) AS canonical, 'warning' AS severity, 'a rename unites ' || string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS message FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")(
    lambda s, d: R.decision_warnings(_clusters(s, d), c.read(s, d, "part").select(F.col("p_brand").alias("auto"), F.concat(F.lit("brand "), F.right("p_brand", F.lit(1))).alias("new")).distinct(), _decisions(s, d)[1].limit(0), _decisions(s, d)[2].limit(0)).select("canonical", "severity", "message")
)
query("l09_merge_edits", "WITH g AS (SELECT DISTINCT CAST(right(p_brand, 1) AS INTEGER) AS group_id, p_brand AS name FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2') SELECT group_id, name FROM g WHERE group_id NOT IN (SELECT group_id FROM g WHERE name LIKE '%12') UNION ALL SELECT 3, n FROM (SELECT DISTINCT p_brand AS n FROM part WHERE p_brand LIKE '%12' OR p_brand LIKE '%13')")(
    lambda s, d: R.with_merge(_decisions(s, d)[1], c.read(s, d, "part").where("p_brand like '%12' or p_brand like '%13'").select(F.col("p_size").alias("pos"), F.concat(F.lit(" "), "p_brand").alias("name"))).select("group_id", "name")
)
query("l09_split_edits", "WITH s AS (SELECT DISTINCT p_brand AS source, CAST(p_partkey AS VARCHAR) AS path, 'new ' || CAST(p_partkey % 3 AS VARCHAR) AS target FROM part WHERE p_partkey % 40 = 0), e AS (SELECT p_brand AS source, CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS target FROM part WHERE p_brand LIKE '%4' AND p_partkey % 7 = 0) SELECT * FROM s WHERE source NOT IN (SELECT source FROM e) UNION ALL SELECT * FROM e WHERE target <> ''")(
    lambda s, d: R.with_split(_decisions(s, d)[2], c.read(s, d, "part").where("p_brand like '%4' and p_partkey % 7 = 0").select(F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "p_type")).alias("target")))
)
query("l11_auto_names", "SELECT DISTINCT CASE WHEN p_brand LIKE '%3' THEN 'renamed ' || right(p_brand, 2) ELSE p_brand END AS canonical, p_brand AS auto FROM part")(
    lambda s, d: R.auto_name(R.apply_renames(_clusters(s, d), _decisions(s, d)[0]).select("canonical"), _decisions(s, d)[0])
)
