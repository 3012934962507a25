"""Registered queries over the driver's tables, each with the SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import dml, hnsw, knn
from ..session import Session
from ..sources.external import parquet
from ..sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "embeddings": ["vec_id"],
}

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The tables with NULLs: orders without status F and customer key 7, customers without debts.
ORDERS_NULLS = "(SELECT o_orderkey, NULLIF(o_custkey, 7) AS o_custkey, NULLIF(o_orderstatus, 'F') AS o_orderstatus, o_totalprice FROM orders)"
CUSTOMER_NULLS = "(SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)"


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the driver's tables, and those with NULLs, registered."""
    out = Session(spark)
    for name, key in KEYS.items():
        out.register_parquet(name, f"{sf_dir}/{name}.parquet", key)
    o, c = out.table("orders"), out.table("customer")
    o = o.select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("o_custkey"), F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), "o_totalprice")
    out.register("orders_nulls", o, ["o_orderkey"])
    out.register("customer_nulls", c.select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal")), ["c_custkey"])
    return out


def _add(name: str, run: Query, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle is not None:
        ORACLE_SQL[name] = oracle


def _sql(name: str, statement: str, oracle: str | None = None) -> None:
    """A statement of the dialect; its SQL elsewhere is the same if no other is given."""
    where = statement.replace("FROM orders_nulls", f"FROM {ORDERS_NULLS}").replace("FROM customer_nulls", f"FROM {CUSTOMER_NULLS}")
    _add(name, lambda spark, sf_dir: session(spark, sf_dir).sql(statement), oracle or where)


FLAGSHIP = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC LIMIT 10"
_sql("topk_where", FLAGSHIP, FLAGSHIP.replace("DESC", "DESC NULLS FIRST, o_orderkey"))
_sql("scan_star", "SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
_sql("project_named", "SELECT c_name, c_custkey FROM customer")
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    _sql(f"filter_{_name}_int", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {_op} 75")
_sql("filter_eq_text", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
_sql("filter_range_text", "SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000100'")
_sql("filter_float", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.05", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount FROM lineitem WHERE l_discount >= CAST(0.05 AS DOUBLE)")
_sql("filter_int_col_float_lit", "SELECT o_orderkey FROM orders WHERE o_custkey < 75.5", "SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS DOUBLE) < CAST(75.5 AS DOUBLE)")
_sql("filter_float_col_int_lit", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000", "SELECT o_orderkey FROM orders WHERE o_totalprice > CAST(250000 AS DOUBLE)")
_sql("filter_is_null", "SELECT o_orderkey FROM orders_nulls WHERE o_orderstatus IS NULL")
_sql("filter_is_not_null", "SELECT o_orderkey, o_orderstatus FROM orders_nulls WHERE o_orderstatus IS NOT NULL")
_sql("filter_ne_skips_null", "SELECT o_orderkey, o_orderstatus FROM orders_nulls WHERE o_orderstatus != 'O'")
_sql("filter_eq_null", "SELECT o_orderkey FROM orders WHERE o_custkey = NULL")
_sql(
    "filter_and_or",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 OR (l_linestatus = 'F' OR l_tax < 0.01) AND l_discount <= 0.01",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 OR (l_linestatus = 'F' OR l_tax < CAST(0.01 AS DOUBLE)) AND l_discount <= CAST(0.01 AS DOUBLE)",
)


def _ordered(name: str, columns: str, table: str, by: str, key: str, down: bool, limit: int) -> None:
    statement = f"SELECT {columns} FROM {table} ORDER BY {by} {'DESC' if down else 'ASC'} LIMIT {limit}"
    oracle = statement.replace(f"FROM {table}", f"FROM {ORDERS_NULLS if table == 'orders_nulls' else CUSTOMER_NULLS if table == 'customer_nulls' else table}")
    _sql(name, statement, oracle.replace(f" LIMIT {limit}", f" NULLS {'FIRST' if down else 'LAST'}, {key} LIMIT {limit}"))


_ordered("order_asc_nulls_last", "o_orderkey, o_orderstatus", "orders_nulls", "o_orderstatus", "o_orderkey", False, 10_000)
_ordered("order_desc_nulls_first", "o_orderkey, o_orderstatus", "orders_nulls", "o_orderstatus", "o_orderkey", True, 10_000)
_ordered("order_int_desc_nulls_first", "o_orderkey, o_custkey", "orders_nulls", "o_custkey", "o_orderkey", True, 25)
_ordered("order_float_desc_nulls_first", "c_custkey, c_acctbal", "customer_nulls", "c_acctbal", "c_custkey", True, 500)

def _sorted(name: str, columns: str, table: str, by: str, key: str, down: bool) -> None:
    """The whole table in order, equal values by key."""
    statement = f"SELECT {columns} FROM {table} ORDER BY {by} {'DESC' if down else 'ASC'}"
    oracle = statement.replace(f"FROM {table}", f"FROM {ORDERS_NULLS if table == 'orders_nulls' else CUSTOMER_NULLS}")
    _sql(name, statement, f"{oracle} NULLS {'FIRST' if down else 'LAST'}, {key}")


_sorted("order_all_asc_nulls_last", "o_orderkey, o_orderstatus", "orders_nulls", "o_orderstatus", "o_orderkey", False)
_sorted("order_all_desc_nulls_first", "o_orderkey, o_orderstatus", "orders_nulls", "o_orderstatus", "o_orderkey", True)
_sorted("order_all_float_desc_nulls_first", "c_custkey, c_acctbal", "customer_nulls", "c_acctbal", "c_custkey", True)
_ordered("limit_zero", "o_orderkey, o_custkey", "orders", "o_custkey", "o_orderkey", False, 0)
_ordered("topk_int", "o_orderkey, o_custkey", "orders", "o_custkey", "o_orderkey", False, 20)
_ordered("topk_float", "c_custkey, c_acctbal", "customer_nulls", "c_acctbal", "c_custkey", False, 20)
_ordered("topk_text", "c_name, c_custkey", "customer", "c_name", "c_custkey", True, 20)
_sql("pk_lookup", "SELECT * FROM customer WHERE c_custkey = 42", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42")
_sql("key_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200 ORDER BY o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
_sql("key_range_open", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1400")


# changes to a versioned copy of customer

COPY = "(SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer)"


def managed(spark: SparkSession, sf_dir: str) -> Session:
    """A session whose table c is a versioned copy of customer, with a primary key."""
    out = Session(spark, new_folder(spark, "tables"))
    out.sql("CREATE TABLE c (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_nationkey INTEGER, c_acctbal FLOAT, c_mktsegment TEXT)")
    out.append("c", parquet(spark, f"{sf_dir}/customer.parquet"))
    return out


def _changed(name: str, statements: list[str], oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = managed(spark, sf_dir)
        for statement in statements:
            out = s.sql(statement)
        return out if statement.startswith("SELECT") else s.sql("SELECT * FROM c")

    _add(name, run, oracle)


_changed("dml_insert", ["INSERT INTO c VALUES (-1, 'new', 3, 1.5, NULL)"], f"SELECT * FROM {COPY} UNION ALL SELECT -1, 'new', 3, CAST(1.5 AS DOUBLE), NULL")
_changed(
    "dml_update",
    ["UPDATE c SET c_acctbal = 34.99, c_name = 'a name longer than any other there' WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000"],
    f"SELECT c_custkey, CASE WHEN p THEN 'a name longer than any other there' ELSE c_name END AS c_name, c_nationkey, CASE WHEN p THEN CAST(34.99 AS DOUBLE) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM (SELECT *, c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AS p FROM {COPY})",
)
_changed("dml_update_all", ["UPDATE c SET c_mktsegment = 'ALL'"], f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'ALL' AS c_mktsegment FROM {COPY}")
_changed("dml_update_null", ["UPDATE c SET c_acctbal = NULL WHERE c_custkey <= 10", "UPDATE c SET c_name = 'rich' WHERE c_acctbal >= 5000"], f"SELECT c_custkey, CASE WHEN c_custkey > 10 AND c_acctbal >= 5000 THEN 'rich' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey > 10 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM {COPY}")
_changed("dml_update_key", ["UPDATE c SET c_custkey = -5 WHERE c_custkey = 5"], f"SELECT CASE WHEN c_custkey = 5 THEN -5 ELSE c_custkey END AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {COPY}")
_changed("dml_delete", ["DELETE FROM c WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'"], f"SELECT * FROM {COPY} WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY')")
_changed("dml_delete_all_then_insert", ["DELETE FROM c", "INSERT INTO c VALUES (1, 'one', 2, 1.0, 'X')"], "SELECT CAST(1 AS BIGINT) AS c_custkey, 'one' AS c_name, CAST(2 AS BIGINT) AS c_nationkey, CAST(1 AS DOUBLE) AS c_acctbal, 'X' AS c_mktsegment")
_changed("dml_rollback", ["BEGIN", "DELETE FROM c WHERE c_custkey > 3", "UPDATE c SET c_name = 'x'", "ROLLBACK"], f"SELECT * FROM {COPY}")
_changed("dml_commit", ["BEGIN", "DELETE FROM c WHERE c_custkey > 20", "UPDATE c SET c_name = 'x' WHERE c_custkey = 3", "COMMIT"], f"SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 'x' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM {COPY} WHERE c_custkey <= 20")


def _two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction over two tables, committed at once."""
    s = managed(spark, sf_dir)
    for statement in (
        "CREATE TABLE log (id INTEGER PRIMARY KEY, note TEXT)", "BEGIN", "INSERT INTO log VALUES (3, 'deleted')", "DELETE FROM c WHERE c_custkey = 3",
        "INSERT INTO log VALUES (4, 'renamed')", "UPDATE c SET c_name = 'x' WHERE c_custkey = 4", "COMMIT",
    ):
        s.sql(statement)
    return s.sql("SELECT * FROM c").join(s.sql("SELECT * FROM log").withColumnRenamed("id", "c_custkey"), "c_custkey", "full").select("c_custkey", "c_name", "note")


_add("dml_commit_two_tables", _two_tables, "SELECT c_custkey, CASE c_custkey WHEN 3 THEN NULL WHEN 4 THEN 'x' ELSE c_name END AS c_name, CASE c_custkey WHEN 3 THEN 'deleted' WHEN 4 THEN 'renamed' END AS note FROM customer")
_changed("managed_pk_lookup", ["SELECT * FROM c WHERE c_custkey = 42"], f"SELECT * FROM {COPY} WHERE c_custkey = 42")
_add(
    "pk_violations",
    lambda spark, sf_dir: dml.key_violations(parquet(spark, f"{sf_dir}/lineitem.parquet"), "l_orderkey"),
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL",
)


# vectors

V = "CAST(embedding AS DOUBLE[])"
PAIRS = f"(SELECT a.vec_id, a.e, b.e AS q FROM (SELECT vec_id, {V} AS e FROM embeddings) a, (SELECT {V} AS e FROM embeddings WHERE vec_id = 7) b)"
DIST = {"euclidean": "list_distance(e, q)", "cosine": "list_cosine_distance(e, q)", "dot": "-list_inner_product(e, q)"}


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def seventh(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that the registered queries start from."""
    return list(embeddings(spark, sf_dir).where("vec_id = 7").first()["embedding"])


def _distance(name: str, f, oracle: str) -> None:
    _add(
        name,
        lambda spark, sf_dir: embeddings(spark, sf_dir).select("vec_id", (F.round(f("embedding", seventh(spark, sf_dir)), 6) + 0.0).alias("dist")),
        f"SELECT vec_id, round({oracle}, 6) + 0 AS dist FROM {PAIRS}",  # no -0.0
    )


_distance("vec_l2", vectors.euclidean, DIST["euclidean"])
_distance("vec_l2_squared", vectors.squared_euclidean, "list_distance(e, q) * list_distance(e, q)")
_distance("vec_cosine", vectors.cosine, DIST["cosine"])
_distance("vec_neg_dot", vectors.negated_dot, DIST["dot"])
_add(
    "vec_cosine_zero",
    lambda spark, sf_dir: embeddings(spark, sf_dir).select("vec_id", vectors.cosine("embedding", [0.0] * 64).alias("dist")),
    "SELECT vec_id, CAST(1 AS DOUBLE) AS dist FROM embeddings",
)
_add("vec_dims", lambda spark, sf_dir: embeddings(spark, sf_dir).select("vec_id", vectors.dimensions("embedding").cast("long").alias("dims")), "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings")
for _metric, _short in (("euclidean", "l2"), ("cosine", "cosine"), ("dot", "dot")):
    _add(
        f"knn_{_short}",
        lambda spark, sf_dir, m=_metric: knn.knn(embeddings(spark, sf_dir), seventh(spark, sf_dir), 10, m).select("id"),
        f"SELECT vec_id AS id FROM {PAIRS} ORDER BY {DIST[_metric]}, vec_id LIMIT 10",
    )

BATCH_SQL = f"""
SELECT query_id, id, CAST(rank AS BIGINT) AS rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(d.e, q.e), d.vec_id) AS rank
  FROM (SELECT vec_id, {V} AS e FROM embeddings) d, (SELECT vec_id, {V} AS e FROM embeddings WHERE vec_id % 100 = 0) q
) WHERE rank <= 10
"""


def hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every row whose id is divisible by 100."""
    return embeddings(spark, sf_dir).where("vec_id % 100 = 0")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = knn.knn_batch(embeddings(spark, sf_dir), hundredths(spark, sf_dir), 10, "euclidean")
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


_add("knn_batch", _batch, BATCH_SQL)


def graph(spark: SparkSession, sf_dir: str, metric: str = "euclidean", rows: int = 4096) -> hnsw.Index:
    """An index with about so many rows a shard, and four shards at least."""
    data = embeddings(spark, sf_dir)
    return hnsw.build(data, max(4, -(-data.count() // rows)), hnsw.Config(), metric, seed=42)


def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as the table finds what an exact search finds."""
    index = graph(spark, sf_dir)
    out = index.search(hundredths(spark, sf_dir), 10, ef=embeddings(spark, sf_dir).count())
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = hundredths(spark, sf_dir)
    found = graph(spark, sf_dir).search(queries, 10)
    truth = knn.knn_batch(embeddings(spark, sf_dir), queries, 10, "euclidean")
    return knn.recall(found, truth).select((F.col("recall") >= 0.9).alias("ok"))


_add("ann_full_ef", _ann, BATCH_SQL)
_add("ann_recall_gate", _gate, "SELECT true AS ok")
_add("hnsw_len", lambda spark, sf_dir: graph(spark, sf_dir).stats().select("num_nodes", (F.col("avg_neighbors_layer0") > 0).alias("linked")), "SELECT count(*) AS num_nodes, true AS linked FROM embeddings")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of one graph with a narrow, the usual and a wide beam."""
    queries, index = hundredths(spark, sf_dir), graph(spark, sf_dir)
    path = new_folder(spark, "truth")  # computed once for three recalls
    knn.knn_batch(embeddings(spark, sf_dir), queries, 10, "euclidean").write.parquet(path)
    truth = spark.read.parquet(path)
    at = [knn.recall(index.search(queries, 10, ef), truth).first()["recall"] for ef in (10, 50, 100)]
    return spark.createDataFrame([(at[1] >= 0.9, at[2] >= at[0])], "usual boolean, wider_is_no_worse boolean")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics; of those that chance sets, whether they are as they must be."""
    index = graph(spark, sf_dir)
    entry = index.nodes.where("entry").select(F.col("id").alias("entry_point"), "level")
    stats = index.stats().join(entry, "entry_point")
    return stats.select("num_nodes", (F.col("level") == F.col("max_layer")).alias("entry_on_top"), F.col("avg_neighbors_layer0").between(1, index.config.m_max).alias("degree_in_bounds"), (F.col("entry_points") <= index.shards).alias("an_entry_a_shard"))


_add("ann_ef_sweep", _sweep, "SELECT true AS usual, true AS wider_is_no_worse")
_add("hnsw_stats", _stats, "SELECT count(*) AS num_nodes, true AS entry_on_top, true AS degree_in_bounds, true AS an_entry_a_shard FROM embeddings")
_add("hnsw_get", lambda spark, sf_dir: graph(spark, sf_dir).get(7).select("id"), "SELECT vec_id AS id FROM embeddings WHERE vec_id = 7")
_add("hnsw_degree_bound", lambda spark, sf_dir: graph(spark, sf_dir).crowded().select(F.col("src").alias("id")), "SELECT vec_id AS id FROM embeddings WHERE false")
_add("hnsw_bidirectional", lambda spark, sf_dir: graph(spark, sf_dir).one_way().select(F.col("src").alias("id")), "SELECT vec_id AS id FROM embeddings WHERE false")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ", ".join(f"{x:.9f}" for x in seventh(spark, sf_dir))
    return session(spark, sf_dir).sql(f"SELECT vec_id FROM embeddings ORDER BY embedding <-> [{numbers}] LIMIT 10")


_add("sql_nearest", _nearest, f"SELECT vec_id FROM {PAIRS} ORDER BY {DIST['euclidean']}, vec_id LIMIT 10")
