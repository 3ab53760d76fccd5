"""Driver queries of the graph operators and their SQL (DuckDB), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokes.functions import text as X
from spokes.functions.jsonx import ladder
from spokes.operators import graph as G
from spokes.operators import infer as I
from spokes.operators import resolve as R
from spokes.operators import triples as T
from spokes.operators.components import connected_components
from spokes.plans import pipeline as P
from spokes.schema import NAME_STOPS, TRAILING_STOPS
from spokes.sources.extractors import RuleExtractor
from spokes.sources.seeds import sample_triples, seed_sql, seed_triples
from spokes.storage import save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Families of seed triples: those with names of several words, and places alone.
NAMED, PLACES = (1, 2, 4, 5, 6), (1, 2)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _t(*families: int) -> str:
    return f"t AS (SELECT *, row_number() OVER (ORDER BY doc, chunk, pos) AS seq FROM ({seed_sql(*families)}))"


WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
NORM = "array_to_string(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN (" + _quoted(NAME_STOPS) + ")), ' ')"
STEMS = "list_distinct(list_transform(list_filter(string_split({}, ' '), lambda w: length(w) > 4), lambda w: w[1:4]))"


def _limit(p: str) -> str:
    w = WORDS.format(p)
    return f"CASE WHEN len({w}) <= 3 THEN {p} WHEN lower(({w})[3]) IN ({_quoted(TRAILING_STOPS)}) THEN array_to_string(({w})[1:2], ' ') ELSE array_to_string(({w})[1:3], ' ') END"


ENDS = "ends AS (SELECT subject AS entity, seq, 0 AS side FROM t UNION ALL SELECT object, seq, 1 FROM t)"
EDGES = "e AS (SELECT DISTINCT subject AS src, object AS dst FROM t)"
SIMPLE = "u AS (SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM t)"
NODES = "nodes AS (SELECT subject AS node FROM t UNION SELECT object FROM t)"
#: Least label over edges taken both ways, as a recursive union that ends when nothing is new.
COMPONENTS = """both_ways AS (SELECT subject AS a, object AS b FROM t UNION SELECT object, subject FROM t),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
MAPPING = f"""freq AS (SELECT lower(entity) AS variant, count(*) AS n FROM ends GROUP BY 1),
grp AS (SELECT {NORM.format("variant")} AS norm, variant, n FROM freq),
rep AS (SELECT norm, variant AS standard FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, length(variant), variant) AS r FROM grp WHERE norm <> '') WHERE r = 1),
s AS (SELECT DISTINCT standard AS e, list_distinct({WORDS.format("standard")}) AS w, {STEMS.format("standard")} AS st FROM rep),
p AS (SELECT *, row_number() OVER (ORDER BY length(e), e) AS pos FROM s),
pair AS (
  SELECT x.e AS x, y.e AS y, x.pos AS px, y.pos AS py, len(list_intersect(x.w, y.w)) AS k, len(x.w) AS nx, len(y.w) AS ny,
    len(list_intersect(x.st, y.st)) AS sk, greatest(len(x.st), len(y.st)) AS sn
  FROM p x JOIN p y ON x.pos < y.pos),
takes AS (
  SELECT y AS e, x AS target, 0 AS later, px AS pos FROM pair WHERE k = nx OR (k <> ny AND sk > 0 AND 2 * sk > sn)
  UNION ALL SELECT x, y, 1, py FROM pair WHERE k <> nx AND k = ny),
taken AS (SELECT e AS standard, target FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY later DESC, pos DESC) AS r FROM takes) WHERE r = 1),
m AS (
  SELECT variant, coalesce(target, rep.standard) AS standard
  FROM grp JOIN rep USING (norm) LEFT JOIN taken ON grp.variant = taken.standard)"""


@query("q_seed_triples", f"SELECT subject, predicate, object, chunk, inferred FROM ({seed_sql()})")
def seeds(spark, sf):
    return seed_triples(spark, sf).drop("seq")


@query("q_chunk_documents", f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
n AS (SELECT *, len(w) AS n, CAST(ceil(len(w) / 80.0) AS BIGINT) - 1 AS k FROM w),
c AS (SELECT doc_id, i + 1 AS chunk, CASE WHEN i < k THEN w[i * 80 + 1:i * 80 + 100] ELSE w[least(k * 80, n - 20) + 1:n] END AS w
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM n WHERE n > 100))
SELECT doc_id, CAST(chunk AS INT) AS chunk, array_to_string(w, ' ') AS text, CAST(len(w) AS INT) AS n_words FROM c
UNION ALL SELECT doc_id, 1, text, CAST(n AS INT) FROM n WHERE n <= 100""")
def chunk_documents(spark, sf):
    return X.chunks(spark.read.parquet(f"{sf}/documents.parquet"))


@query("q_normalize_entities", f"WITH {_t()}, {ENDS} SELECT DISTINCT entity, {NORM.format('entity')} AS norm FROM ends")
def normalize_entities(spark, sf):
    return T.unique_entities(seed_triples(spark, sf)).select("entity", X.normalize(F.col("entity")).alias("norm"))


@query("q_limit_predicate", f"WITH {_t()} SELECT DISTINCT predicate, {_limit('predicate')} AS short FROM t")
def limit_predicate(spark, sf):
    return seed_triples(spark, sf).select("predicate").distinct().select("predicate", X.limit_predicate(F.col("predicate")).alias("short"))


@query("q_stems", f"WITH {_t()}, {ENDS} SELECT DISTINCT entity, array_to_string(list_sort({STEMS.format('entity')}), ',') AS stems FROM ends")
def stems(spark, sf):
    return T.unique_entities(seed_triples(spark, sf)).select("entity", F.array_join(F.array_sort(X.stems(F.col("entity"))), ",").alias("stems"))


@query("q_json_props", "SELECT event_id, 'object' AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    read = spark.read.parquet(f"{sf}/events.parquet").select("event_id", ladder(F.col("props")).alias("j"))
    return read.select("event_id", "j.kind", F.get_json_object("j.value", "$.k").cast("long").alias("k"))


@query("q_json_reject_invalid", f"WITH {_t(1, 2, 3)} SELECT subject, predicate, object FROM t WHERE pos % 3 <> 0")
def json_reject(spark, sf):
    from spokes.functions.jsonx import array_items

    rows = seed_triples(spark, sf, 1, 2, 3)
    full = F.to_json(F.struct("subject", "predicate", "object"))
    item = F.when(rows["seq.pos"] % 3 == 0, F.to_json(F.struct("subject", "predicate"))).otherwise(full)
    answers = rows.select(F.concat(F.lit("Here: ["), item, F.lit(",] done")).alias("response")).select(ladder(F.col("response"))["value"].alias("value"))
    return T.valid_items(array_items(answers)).select("subject", "predicate", "object")


@query("q_unique_entities", f"WITH {_t()}, {ENDS} SELECT DISTINCT entity FROM ends")
def unique_entities(spark, sf):
    return T.unique_entities(seed_triples(spark, sf))


@query("q_unique_entities_ci", f"WITH {_t()}, {ENDS} SELECT DISTINCT lower(entity) AS entity FROM ends")
def unique_entities_ci(spark, sf):
    return T.unique_entities(seed_triples(spark, sf), lower=True)


@query("q_entity_frequency", f"WITH {_t()}, {ENDS} SELECT entity, count(*) AS n FROM ends GROUP BY entity")
def entity_frequency(spark, sf):
    return T.entity_frequency(seed_triples(spark, sf))


@query("q_predicate_hist", f"WITH {_t()} SELECT predicate, count(*) AS n FROM t GROUP BY predicate")
def predicate_hist(spark, sf):
    return T.predicate_histogram(seed_triples(spark, sf))


@query("q_top5_predicates", f"WITH {_t()} SELECT predicate, count(*) AS n FROM t GROUP BY predicate ORDER BY n DESC, min(seq) LIMIT 5")
def top5_predicates(spark, sf):
    return T.top_predicates(seed_triples(spark, sf))


@query("q_top100_entities", f"WITH {_t()}, {ENDS} SELECT entity, count(*) AS n FROM ends GROUP BY entity ORDER BY n DESC, min((seq, side)) LIMIT 100")
def top100_entities(spark, sf):
    return T.top_entities(seed_triples(spark, sf))


@query("q_variant_groups", f"WITH {_t()}, {ENDS}, freq AS (SELECT lower(entity) AS variant, count(*) AS n FROM ends GROUP BY 1) SELECT * FROM (SELECT {NORM.format('variant')} AS norm, variant, n FROM freq) WHERE norm <> ''")
def variant_groups(spark, sf):
    return R.variant_groups(seed_triples(spark, sf))


@query("q_group_representative", f"WITH {_t()}, {ENDS}, {MAPPING} SELECT norm, standard FROM rep")
def group_representative(spark, sf):
    return R.representatives(R.variant_groups(seed_triples(spark, sf)))


@query("q_subsumption_map", f"WITH {_t(*NAMED)}, {ENDS}, {MAPPING} SELECT standard, target FROM taken")
def subsumption_map(spark, sf):
    return R.subsumption(R.representatives(R.variant_groups(seed_triples(spark, sf, *NAMED))).select("standard"))


STANDARDIZED = f"""WITH {_t(*NAMED)}, {ENDS}, {MAPPING},
std AS (
  SELECT coalesce(a.standard, subject) AS subject, {_limit("predicate")} AS predicate, coalesce(b.standard, object) AS object, chunk, seq
  FROM t LEFT JOIN m a ON lower(subject) = a.variant LEFT JOIN m b ON lower(object) = b.variant)"""


@query("q_standardized_triples", f"{STANDARDIZED} SELECT subject, predicate, object, chunk, false AS inferred FROM std WHERE subject <> object")
def standardized_triples(spark, sf):
    return R.standardize(seed_triples(spark, sf, *NAMED)).drop("seq")


@query("q_last_predicate", f"WITH {_t()} SELECT subject, object, arg_max(predicate, seq) AS predicate FROM t GROUP BY subject, object")
def last_predicate(spark, sf):
    return T.last_predicate(seed_triples(spark, sf))


@query("q_adjacency_degree", f"WITH {_t()}, {SIMPLE} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node")
def adjacency_degree(spark, sf):
    return G.degree(seed_triples(spark, sf))


@query("q_out_neighbors", f"WITH {_t()}, {EDGES} SELECT src, count(*) AS n FROM e GROUP BY src")
def out_neighbors(spark, sf):
    return T.edges(seed_triples(spark, sf)).groupBy("src").agg(F.count("*").alias("n"))


def _components(spark, sf, *families):
    return connected_components(T.edges(seed_triples(spark, sf, *families)))


@query("q_components", f"WITH RECURSIVE {_t()}, {COMPONENTS} SELECT node, component FROM comp")
def components(spark, sf):
    return _components(spark, sf)


@query("q_component_sizes", f"WITH RECURSIVE {_t()}, {COMPONENTS} SELECT component, count(*) AS size FROM comp GROUP BY component")
def component_sizes(spark, sf):
    return I.component_sizes(_components(spark, sf))


TOP = "top AS (SELECT component, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, component) AS INT) AS rank FROM comp GROUP BY component ORDER BY rank LIMIT 5)"


@query("q_top5_components", f"WITH RECURSIVE {_t()}, {COMPONENTS}, {TOP} SELECT component, size, rank FROM top")
def top5_components(spark, sf):
    return I.top_components(_components(spark, sf))


@query("q_component_pairs", f"WITH RECURSIVE {_t()}, {COMPONENTS}, {TOP} SELECT a.component AS c1, b.component AS c2, a.rank AS r1, b.rank AS r2 FROM top a JOIN top b ON a.rank < b.rank")
def component_pairs(spark, sf):
    return I.component_pairs(I.top_components(_components(spark, sf)))


@query("q_representatives", f"WITH RECURSIVE {_t()}, {COMPONENTS}, {TOP} SELECT component, node, CAST(k AS INT) AS k FROM (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY node) AS k FROM comp JOIN top USING (component)) WHERE k <= 5")
def component_names(spark, sf):
    c = _components(spark, sf)
    return I.component_members(c, I.top_components(c)).select("component", "node", "k")


ALIKE = "len(list_intersect(string_split(lower({a}), ' '), string_split(lower({b}), ' '))) > 0"


@query("q_within_pairs", f"""WITH RECURSIVE {_t(1, 2)}, {COMPONENTS}, {TOP}, {EDGES},
free AS (
  SELECT x.component, x.node AS a, y.node AS b FROM comp x JOIN comp y ON x.component = y.component AND x.node <> y.node
  WHERE x.component IN (SELECT component FROM top WHERE rank <= 3 AND size >= 5) AND ({ALIKE.format(a="x.node", b="y.node")} OR contains(lower(x.node), lower(y.node)) OR contains(lower(y.node), lower(x.node)))
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.node AND e.dst = y.node))
SELECT component, a, b, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY a, b) AS k FROM free) WHERE k <= 10""")
def within_pairs(spark, sf):
    t = seed_triples(spark, sf, 1, 2)
    c = I.saved_components(t)
    return I.within_pairs(c, I.top_components(c, 3, 5), t)


@query("q_context_triples", f"""WITH {_t()}, hit AS (SELECT r.n_name AS request, subject, predicate, object, seq FROM t JOIN (SELECT DISTINCT n_name FROM nation) r ON subject = n_name OR object = n_name)
SELECT request, subject, predicate, object, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY seq) AS k FROM hit) WHERE k <= 20""")
def context_triples(spark, sf):
    names = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("request"), F.col("n_name").alias("entity"))
    return I.context(seed_triples(spark, sf), names).drop("seq")


TRANSITIVE = f"""last AS (SELECT subject, object, arg_max(predicate, seq) AS predicate FROM t GROUP BY subject, object), {EDGES},
path AS (
  SELECT x.subject, y.object, CASE WHEN x.predicate = y.predicate THEN 'indirectly ' || x.predicate ELSE x.predicate || ' via ' || x.object END AS predicate
  FROM last x JOIN last y ON x.object = y.subject WHERE x.subject <> y.object AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.subject AND e.dst = y.object))"""


@query("q_transitive", f"WITH {_t()}, {TRANSITIVE} SELECT subject, {_limit('predicate')} AS predicate, object FROM path")
def transitive(spark, sf):
    return I.transitive(seed_triples(spark, sf)).select("subject", "predicate", "object")


LEXICAL = f"""{NODES}, low AS (SELECT node, lower(node) AS l, list_distinct(string_split(lower(node), ' ')) AS w FROM nodes),
lk AS (SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM t),
lp AS (
  SELECT a, b, la, lb, list_intersect(wa, wb) AS both_w
  FROM (SELECT a.node AS a, b.node AS b, a.l AS la, b.l AS lb, a.w AS wa, b.w AS wb FROM low a JOIN low b ON a.node < b.node) ANTI JOIN lk USING (a, b)),
lw AS (SELECT *, (SELECT arg_min(x, (-length(x), x)) FROM (SELECT unnest(both_w) AS x)) AS word FROM lp WHERE len(both_w) > 0),
lex AS (
  SELECT CASE WHEN starts_with(la, word) AND NOT starts_with(lb, word) THEN b ELSE a END AS subject,
    CASE WHEN starts_with(la, word) <> starts_with(lb, word) THEN 'relates to' ELSE 'related to' END AS predicate,
    CASE WHEN starts_with(la, word) AND NOT starts_with(lb, word) THEN a ELSE b END AS object FROM lw WHERE length(word) >= 4
  UNION ALL SELECT CASE WHEN contains(la, lb) AND NOT contains(lb, la) THEN a ELSE b END, 'is type of', CASE WHEN contains(la, lb) AND NOT contains(lb, la) THEN b ELSE a END
  FROM lp WHERE len(both_w) = 0 AND (contains(la, lb) OR contains(lb, la)))"""


@query("q_lexical", f"WITH {_t(*NAMED)}, {LEXICAL} SELECT subject, predicate, object FROM lex")
def lexical(spark, sf):
    t = seed_triples(spark, sf, *NAMED)
    return I.lexical(T.unique_entities(t), t).select("subject", "predicate", "object")


@query("q_dedupe", f"""WITH {_t()}, f AS (SELECT *, seq % 4 = 0 AS flag FROM t)
SELECT subject, predicate, object, coalesce(arg_max(chunk, seq) FILTER (NOT flag), arg_min(chunk, seq) FILTER (flag)) AS chunk, bool_and(flag) AS inferred FROM f GROUP BY subject, predicate, object""")
def dedupe(spark, sf):
    from pyspark.sql import Window

    t = seed_triples(spark, sf)
    numbered = t.withColumn("k", F.row_number().over(Window.orderBy("seq")))
    return T.dedupe(numbered.withColumn("inferred", F.col("k") % 4 == 0).drop("k")).drop("seq")


@query("q_self_loop_filter", f"WITH {_t()} SELECT subject, predicate, object FROM t WHERE subject <> object")
def self_loop_filter(spark, sf):
    return T.without_self_loops(seed_triples(spark, sf)).select("subject", "predicate", "object")


ENRICHED = f"""WITH {_t(*NAMED)}, {TRANSITIVE}, {LEXICAL},
every AS (
  SELECT subject, predicate, object, chunk, false AS inferred, 0 AS phase, seq FROM t
  UNION ALL SELECT subject, {_limit("predicate")}, object, NULL, true, 3, 0 FROM path
  UNION ALL SELECT subject, predicate, object, NULL, true, 4, 0 FROM lex),
one AS (SELECT subject, predicate, object, arg_max(chunk, seq) FILTER (NOT inferred) AS chunk, bool_and(inferred) AS inferred FROM every GROUP BY subject, predicate, object),
final AS (SELECT subject, {_limit("predicate")} AS predicate, object, chunk, inferred FROM one WHERE subject <> object)"""


@query("q_enriched_triples", f"{ENRICHED} SELECT * FROM final")
def enriched_triples(spark, sf):
    return I.infer(seed_triples(spark, sf, *NAMED)).drop("seq")


@query("q_inferred_count", f"{ENRICHED} SELECT count(*) AS n FROM final WHERE inferred")
def inferred_count(spark, sf):
    return T.inferred_count(I.infer(seed_triples(spark, sf, *NAMED)))


@query("q_undirected_edges", f"WITH {_t()}, {SIMPLE} SELECT a, b FROM u")
def undirected_edges(spark, sf):
    return T.undirected_edges(seed_triples(spark, sf))


@query("q_display_edges", f"WITH {_t()} SELECT subject AS src, object AS dst, arg_max(predicate, seq) AS label, false AS inferred FROM t GROUP BY subject, object")
def display_edges(spark, sf):
    return T.display_edges(seed_triples(spark, sf))


@query("q_graph_stats", f"""{ENRICHED}, fu AS (SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM final),
deg AS (SELECT node, count(*) % 8 AS community FROM (SELECT a AS node FROM fu UNION ALL SELECT b FROM fu) GROUP BY node),
pairs AS (SELECT DISTINCT subject, object FROM final WHERE inferred)
SELECT (SELECT count(*) FROM (SELECT subject FROM final UNION SELECT object FROM final)) AS nodes, (SELECT count(*) FROM final) AS edges,
  (SELECT count(*) FROM final) - (SELECT count(*) FROM pairs) AS original_edges, (SELECT count(*) FROM pairs) AS inferred_edges,
  (SELECT count(DISTINCT community) FROM deg) AS communities""")
def graph_stats(spark, sf):
    t = save(I.infer(seed_triples(spark, sf, *NAMED)), "inferred")
    return G.stats(t, G.degree_communities(t))


@query("q_degree_communities", f"WITH {_t()}, {SIMPLE} SELECT node, CAST(count(*) % 8 AS INT) AS community FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node")
def degree_communities(spark, sf):
    return G.degree_communities(seed_triples(spark, sf))


#: In a forest each path is the only one: nodes strictly between two others lie on it.
@query("q_betweenness", f"""WITH RECURSIVE {_t(*PLACES)}, {SIMPLE}, {NODES}, adj AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
walk AS (SELECT node AS s, node AS v, [node] AS path FROM nodes UNION ALL SELECT s, b, list_append(path, b) FROM walk JOIN adj ON v = a WHERE NOT list_contains(path, b)),
mid AS (SELECT unnest(path[2:len(path) - 1]) AS node FROM walk WHERE len(path) > 2),
n AS (SELECT count(*) AS n FROM nodes)
SELECT node, CAST(round(1e9 * count(mid.node) / ((n - 1) * (n - 2))) AS BIGINT) AS betweenness_e9 FROM nodes LEFT JOIN mid USING (node), n GROUP BY node, n""")
def betweenness(spark, sf):
    return G.betweenness(seed_triples(spark, sf, *PLACES)).select("node", F.round(F.col("betweenness") * 1e9).cast("long").alias("betweenness_e9"))


@query("q_node_size", f"WITH {_t()}, {SIMPLE}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node) SELECT node, CAST(round(1e6 * (10 + 10 * (degree / (SELECT max(degree) FROM d)))) AS BIGINT) AS size_e6 FROM d")
def node_size(spark, sf):
    d = G.degree(seed_triples(spark, sf)).withColumns({"betweenness": F.lit(0.0), "eigenvector": F.lit(0.0)})
    return G.node_sizes(d).select("node", F.round(F.col("size") * 1e6).cast("long").alias("size_e6"))


@query("q_node_colors", f"WITH {_t()}, {SIMPLE} SELECT node, ([{_quoted(G.PALETTE)}])[CAST(count(*) % 8 AS INT) + 1] AS color FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node")
def node_colors(spark, sf):
    return G.degree_communities(seed_triples(spark, sf)).select("node", G.color(F.col("community")).alias("color"))


@query("q_eigenvector")
def eigenvector(spark, sf):
    return G.eigenvector(seed_triples(spark, sf, *NAMED))


@query("q_louvain")
def louvain(spark, sf):
    t = seed_triples(spark, sf, *NAMED)
    return G.louvain(t, I.saved_components(t))


@query("q_node_view")
def node_view(spark, sf):
    t = sample_triples(spark)
    return G.node_view(t, I.saved_components(t))


@query("q_between_requests")
def between_requests(spark, sf):
    t = seed_triples(spark, sf, *NAMED)
    return P.between_requests(t, I.saved_components(t))


@query("q_within_requests")
def within_requests(spark, sf):
    t = seed_triples(spark, sf, *NAMED)
    return P.within_requests(t, I.saved_components(t))


#: Each event becomes a sentence that the rules can read.
@query("q_extract_rules", "SELECT DISTINCT 'user ' || user_id AS subject, 'uses' AS predicate, event_type AS object FROM events")
def extract_rules(spark, sf):
    says = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" uses "), "event_type", F.lit("."))
    docs = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("doc_id"), says.alias("text"))
    return P.extract(X.chunks(docs), RuleExtractor())[0].select("subject", "predicate", "object").distinct()
