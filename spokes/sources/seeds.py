"""Triples derived from star-schema tables, and a literal sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.schema import TRIPLE

#: The same text runs on Spark and on other SQL engines. Columns: subject, predicate, object, chunk, inferred, doc, pos.
FAMILIES = {
    1: "SELECT n_name AS subject, 'located in' AS predicate, r_name AS object, 1 AS chunk, CAST(n_nationkey AS BIGINT) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey",
    2: "SELECT s_name AS subject, 'based in' AS predicate, n_name AS object, 1 AS chunk, CAST(s_suppkey AS BIGINT) AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    3: "SELECT c_name AS subject, 'is a resident of' AS predicate, n_name AS object, 1 AS chunk, CAST(c_custkey AS BIGINT) AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey",
    4: "SELECT CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('The ', p_name) ELSE p_name END AS subject, 'made by' AS predicate, p_brand AS object, CAST(p_partkey % 5 AS INT) AS chunk, CAST(p_partkey AS BIGINT) AS pos FROM part",
    5: "SELECT p_name AS subject, CASE p_partkey % 3 WHEN 0 THEN 'is type' ELSE 'is a kind of the' END AS predicate, p_type AS object, CAST(p_partkey % 5 AS INT) AS chunk, CAST(p_partkey AS BIGINT) AS pos FROM part",
    6: "SELECT source AS subject, 'publishes in' AS predicate, lang AS object, 1 AS chunk, min(doc_id) AS pos FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang",
    7: "SELECT concat('user ', CAST(user_id AS STRING)) AS subject, event_type AS predicate, event_type AS object, CAST(event_id % 30 AS INT) AS chunk, CAST(event_id AS BIGINT) AS pos FROM events",
}


def seed_sql(*families: int) -> str:
    parts = [f"SELECT subject, predicate, object, chunk, false AS inferred, {k} AS doc, pos FROM ({FAMILIES[k]}) f{k}" for k in families or FAMILIES]
    return " UNION ALL ".join(parts)


TABLES = {1: ("nation", "region"), 2: ("supplier", "nation"), 3: ("customer", "nation"), 4: ("part",), 5: ("part",), 6: ("documents",), 7: ("events",)}


def seed_triples(spark: SparkSession, sf_dir: str, *families: int) -> DataFrame:
    for t in {t for k in families or FAMILIES for t in TABLES[k]}:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    rows = spark.sql(seed_sql(*families))
    seq = "named_struct('phase', 0, 'doc', CAST(doc AS BIGINT), 'chunk', chunk, 'pos', pos) AS seq"
    return rows.selectExpr("subject", "predicate", "object", "chunk", "inferred", seq)


SAMPLE = [
    ("Water Wheel", "powers", "Grain Mill"),
    ("Grain Mill", "stands by", "River Aire"),
    ("River Aire", "flows through", "Leeds"),
    ("Leeds", "is a city in", "England"),
    ("Mary Ellis", "owns", "Grain Mill"),
    ("Mary Ellis", "lives in", "Leeds"),
    ("John Carr", "repaired", "Water Wheel"),
    ("John Carr", "was born in", "York"),
    ("York", "is a city in", "England"),
    ("Paper Mill", "buys power from", "Water Wheel"),
    ("Paper Mill", "sells to", "Printers Guild"),
    ("Printers Guild", "meets in", "York"),
    ("Ann Hobson", "leads", "Printers Guild"),
    ("Ann Hobson", "was taught by", "Mary Ellis"),
    ("Leeds Canal", "joins", "River Aire"),
    ("Leeds Canal", "carries", "Coal"),
    ("Coal", "heats", "Paper Mill"),
    ("Coal", "comes from", "Middleton"),
    ("Middleton", "lies near", "Leeds"),
    ("Rail Company", "ships", "Coal"),
    ("Rail Company", "was founded in", "York"),
]


def sample_triples(spark: SparkSession) -> DataFrame:
    """A small literal relation for demonstrations."""
    return spark.createDataFrame([(s, p, o, 1, False, (0, 0, 1, i)) for i, (s, p, o) in enumerate(SAMPLE)], TRIPLE)
