"""The star-schema tables as a code graph.

Suppliers are files, parts are symbols, orders are commits and line items the files that a commit
changes; a part that follows another in an order is a symbol that the other refers to. ``Model``
builds each canonical table lazily; ``SQL`` says the same in portable SQL, for the oracle.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.session import Scratch, size_of, sized

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
MIN_SET, MAX_SET = 2, 100


def case(value: Column, results: list[str]) -> Column:
    """results[value]; the last for any greater value."""
    out = F.lit(results[-1])
    for k in range(len(results) - 2, -1, -1):
        out = F.when(value == k, results[k]).otherwise(out)
    return out


class Model:
    """Canonical tables over one folder of parquet tables, in a session sized for them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = sized(spark, size_of(spark, sf_dir)), sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(
            F.col("s_suppkey").alias("id"), F.concat_ws("/", "r_name", "n_name", F.when(F.col("s_suppkey") % 7 == 0, "lib"), F.concat("s_name", F.when(F.col("s_suppkey") % 5 == 0, "_test.py").otherwise(""))).alias("path"),
            F.col("r_name").alias("language"),
            F.when(F.col("s_suppkey") % 5 == 0, "test").when(F.col("s_suppkey") % 7 == 0, "docs").otherwise("source").alias("file_role"),
            F.floor(F.abs("s_acctbal") / 10).cast("long").alias("line_count"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        p = self.raw("part")
        pairs = self.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
        modal = pairs.groupBy("l_partkey").agg(F.max(F.struct("n", (-F.col("l_suppkey")).alias("k"))).alias("x")).select("l_partkey", (-F.col("x.k")).alias("file_id"))
        key, size = F.col("p_partkey"), F.col("p_size")
        return p.join(modal, p.p_partkey == modal.l_partkey).select(
            key.alias("id"), "file_id", F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
            case(size % 5, ["function", "class", "method", "constant", "interface"]).alias("kind"), F.col("p_type").alias("signature"),
            size.cast("long").alias("line_start"), (size + key % 40).alias("line_end"), F.when(key % 3 == 0, 0).otherwise(1).alias("is_exported"),
            F.when(key % 4 > 0, key - 1).alias("parent_id"),
        )

    def _follows(self, column: str) -> DataFrame:
        """Within an order, each item's column and its successor's, where they differ."""
        after = F.lead(column).over(W.partitionBy("l_orderkey").orderBy(*ORDER))
        return self.raw("lineitem").select(F.col(column).alias("src"), after.alias("dst"), "l_linenumber").filter("dst IS NOT NULL AND src <> dst")

    @cached_property
    def edges(self) -> DataFrame:
        kind = case(F.col("l_linenumber") % 4, ["call", "import", "inherits", "reference"])
        raw = self._follows("l_partkey").groupBy(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), kind.alias("kind")).agg(F.min("l_linenumber").cast("long").alias("line"))
        ids = self.symbols.select("id")
        return raw.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "kind", "line")

    @cached_property
    def file_edges(self) -> DataFrame:
        from arborlake.operators.relational import file_edges

        return file_edges(self.edges, self.symbols)

    @cached_property
    def commits(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("author_"), F.col("o_custkey")).alias("author"), F.unix_timestamp("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("message"))

    @cached_property
    def changes(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file_id"), F.col("l_quantity").cast("long").alias("lines_added"), F.col("l_linenumber").cast("long").alias("lines_removed"))

    @cached_property
    def cochange(self) -> DataFrame:
        from arborlake.operators.temporal import cochange

        return cochange(self.changes)

    @cached_property
    def file_stats(self) -> DataFrame:
        from arborlake.operators.temporal import file_stats

        cx = self.raw("supplier").select(F.col("s_suppkey").alias("file_id"), F.round(F.abs("s_acctbal") / 1000, 2).alias("complexity"))
        return file_stats(self.commits, self.changes).join(cx, "file_id")

    @cached_property
    def symbol_metrics(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_size") % 30).cast("double").alias("cognitive_complexity"), (F.col("p_size") % 6).cast("long").alias("nesting_depth"), (F.col("p_partkey") % 5).alias("param_count"), (F.col("p_partkey") % 40 + 1).alias("line_count"))

    @cached_property
    def graph_metrics(self) -> DataFrame:
        """Degrees are real; PageRank and betweenness stand-ins that cost nothing (the real ones are queries of their own)."""
        e = self.edges
        both = e.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        d = both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        s = self.symbols.select("id").join(self.raw("part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "id").join(d, "id", "left")
        i, o = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
        return s.select(F.col("id").alias("symbol_id"), (F.col("p_retailprice") / 100000).alias("pagerank"), i.alias("in_degree"), o.alias("out_degree"), (i * o / 8).alias("betweenness"))

    @cached_property
    def clusters(self) -> DataFrame:
        return self.raw("part").join(self.symbols.select(F.col("id").alias("p_partkey")), "p_partkey", "left_semi").select(F.col("p_partkey").alias("symbol_id"), F.expr("substring(p_brand, 7)").cast("long").alias("cluster_id"), F.col("p_brand").alias("cluster_label"))

    @cached_property
    def graph(self) -> DataFrame:
        """src, dst, weight: all successions of suppliers. Graph queries read it many times, so it is made once."""
        return Scratch(self.spark, "graph").save(self._follows("l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("weight")), "edges")

    @cached_property
    def vertices(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"))

    @cached_property
    def forest(self) -> DataFrame:
        """src, dst: symbols and their parents, those that exist."""
        s = self.symbols.select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
        return s.join(self.symbols.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")

    @cached_property
    def history(self) -> DataFrame:
        """series, idx (day), value, n, mean."""
        e = self.raw("events")
        g = e.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("value"), F.count("*").alias("n"), F.avg("value").alias("mean"))
        return g.select("series", (F.row_number().over(W.partitionBy("series").orderBy("day")) - 1).cast("long").alias("idx"), "day", "value", "n", "mean")

    @cached_property
    def prices(self) -> DataFrame:
        """series (supplier), idx, value: the prices of its line items in order. They are spread by series under that name, as the plan
        would else not know that they are and spread them again."""
        at = F.row_number().over(W.partitionBy("series").orderBy("l_orderkey", *[c for c in ORDER if c != "l_suppkey"])) - 1
        return self.raw("lineitem").withColumnRenamed("l_suppkey", "series").select("series", at.cast("long").alias("idx"), F.col("l_extendedprice").alias("value"))

    @cached_property
    def names(self) -> DataFrame:
        """id, name, kind, is_exported, language: the symbols under names in the styles of code; every seventh in another style."""
        a, b = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2))
        upper = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100))
        camel, snake, pascal = F.concat(a, upper(b)), F.concat_ws("_", a, b), F.concat(upper(a), upper(b))
        usual = F.when(F.col("kind") == "constant", F.upper(snake)).when(F.col("kind").isin("class", "interface"), pascal).when(F.col("language") == "ASIA", snake).otherwise(camel)
        k = F.col("id") % 7
        name = F.when(k == 3, snake).when(k == 4, pascal).when(k == 5, F.concat_ws("-", a, b)).when(k == 6, F.concat(F.lit("_"), snake)).otherwise(usual)
        return self.symbols.join(self.files.select(F.col("id").alias("file_id"), "language"), "file_id").select("id", name.alias("name"), "kind", "is_exported", "language")

    @cached_property
    def references(self) -> DataFrame:
        """ref, source_name, target_name, kind, line, import_path, source_file: each line item refers to its part, by one name or another."""
        n, q = F.col("l_linenumber") % 4, F.col("l_orderkey") % 5
        r = self.raw("lineitem").groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ref"), "l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_quantity").cast("long").alias("line"))
        r = r.join(self.raw("part").select(F.col("p_partkey").alias("p"), "p_name", "p_brand"), "p").join(self.files.select(F.col("id").alias("s"), F.col("path").alias("source_file")), "s")
        target = F.when(q == 0, F.concat_ws(".", "p_brand", "p_name")).when(q == 1, F.upper("p_name")).otherwise(F.col("p_name"))
        path = F.when(n == 1, F.concat(F.lit("NATION_"), (F.col("l_orderkey") % 25).cast("string")))
        return r.select("ref", F.when(q == 2, F.col("p_name")).otherwise("").alias("source_name"), target.alias("target_name"), case(n, ["call", "import", "inherits", "reference"]).alias("kind"), "line", path.alias("import_path"), "source_file")


SQL = {
    "files": "SELECT s_suppkey AS id, r_name || '/' || n_name || '/' || CASE WHEN s_suppkey % 7 = 0 THEN 'lib/' ELSE '' END || s_name || CASE WHEN s_suppkey % 5 = 0 THEN '_test.py' ELSE '' END AS path, r_name AS language, CASE WHEN s_suppkey % 5 = 0 THEN 'test' WHEN s_suppkey % 7 = 0 THEN 'docs' ELSE 'source' END AS file_role, CAST(floor(abs(s_acctbal) / 10) AS BIGINT) AS line_count FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "modal": "SELECT l_partkey, arg_max(l_suppkey, n * 1000000000 - l_suppkey) AS file_id FROM (SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey",
    "symbols": "SELECT p_partkey AS id, file_id, p_name AS name, p_brand || '.' || p_name AS qualified_name, CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' WHEN 3 THEN 'constant' ELSE 'interface' END AS kind, p_type AS signature, CAST(p_size AS BIGINT) AS line_start, CAST(p_size + p_partkey % 40 AS BIGINT) AS line_end, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS is_exported, CASE WHEN p_partkey % 4 > 0 THEN p_partkey - 1 END AS parent_id FROM part JOIN modal ON p_partkey = l_partkey",
    "part_follows": "SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst, l_linenumber FROM lineitem) WHERE dst IS NOT NULL AND src <> dst",
    "edges": "SELECT src AS source_id, dst AS target_id, CASE l_linenumber % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'import' WHEN 2 THEN 'inherits' ELSE 'reference' END AS kind, CAST(MIN(l_linenumber) AS BIGINT) AS line FROM part_follows WHERE src IN (SELECT id FROM symbols) AND dst IN (SELECT id FROM symbols) GROUP BY ALL",
    "file_edges": "SELECT a.file_id AS source_file_id, b.file_id AS target_file_id, 'imports' AS kind, COUNT(*) AS symbol_count FROM edges e JOIN symbols a ON e.source_id = a.id JOIN symbols b ON e.target_id = b.id WHERE a.file_id <> b.file_id GROUP BY ALL",
    "git_commits": "SELECT o_orderkey AS id, 'author_' || o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS timestamp, o_orderpriority AS message FROM orders",
    "git_file_changes": "SELECT l_orderkey AS commit_id, l_suppkey AS file_id, CAST(l_quantity AS BIGINT) AS lines_added, CAST(l_linenumber AS BIGINT) AS lines_removed FROM lineitem",
    "commit_files": "SELECT commit_id, file_id FROM (SELECT DISTINCT commit_id, file_id FROM git_file_changes) QUALIFY COUNT(*) OVER (PARTITION BY commit_id) BETWEEN 2 AND 100",
    "git_cochange": "SELECT a.file_id AS file_id_a, b.file_id AS file_id_b, COUNT(*) AS cochange_count FROM commit_files a JOIN commit_files b ON a.commit_id = b.commit_id AND a.file_id < b.file_id GROUP BY ALL",
    "stats": "SELECT file_id, COUNT(DISTINCT commit_id) AS commit_count, CAST(SUM(lines_added + lines_removed) AS BIGINT) AS total_churn, COUNT(DISTINCT author) AS distinct_authors FROM git_file_changes JOIN git_commits c ON commit_id = c.id GROUP BY file_id",
    "file_stats": "SELECT stats.*, round(abs(s_acctbal) / 1000, 2) AS complexity FROM stats JOIN supplier ON file_id = s_suppkey",
    "symbol_metrics": "SELECT p_partkey AS symbol_id, CAST(p_size % 30 AS DOUBLE) AS cognitive_complexity, CAST(p_size % 6 AS BIGINT) AS nesting_depth, p_partkey % 5 AS param_count, p_partkey % 40 + 1 AS line_count FROM part",
    "degrees": "SELECT id, CAST(SUM(i) AS BIGINT) AS in_degree, CAST(SUM(o) AS BIGINT) AS out_degree FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT source_id, 0, 1 FROM edges) GROUP BY id",
    "graph_metrics": "SELECT s.id AS symbol_id, p_retailprice / 100000 AS pagerank, COALESCE(in_degree, 0) AS in_degree, COALESCE(out_degree, 0) AS out_degree, COALESCE(in_degree, 0) * COALESCE(out_degree, 0) / 8.0::DOUBLE AS betweenness FROM symbols s JOIN part ON s.id = p_partkey LEFT JOIN degrees d ON s.id = d.id",
    "clusters": "SELECT p_partkey AS symbol_id, CAST(substr(p_brand, 7) AS BIGINT) AS cluster_id, p_brand AS cluster_label FROM part WHERE p_partkey IN (SELECT id FROM symbols)",
    "graph": "SELECT src, dst, COUNT(*) AS weight FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL",
    "vertices": "SELECT s_suppkey AS id FROM supplier",
    "reach": "SELECT src AS a, dst AS b FROM graph UNION SELECT r.a, g.dst FROM reach r JOIN graph g ON r.b = g.src",
    "scc": "SELECT v.id, COALESCE(MIN(LEAST(v.id, x.b)), v.id) AS scc_id FROM vertices v LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a) x ON v.id = x.a GROUP BY v.id",
    "dag": "SELECT DISTINCT a.scc_id AS src, b.scc_id AS dst FROM graph g JOIN scc a ON g.src = a.id JOIN scc b ON g.dst = b.id WHERE a.scc_id <> b.scc_id",
    "walks": "SELECT DISTINCT scc_id AS node, 0 AS layer FROM scc UNION SELECT d.dst, w.layer + 1 FROM walks w JOIN dag d ON w.node = d.src",
    "layers": "SELECT s.id, CAST(MAX(w.layer) AS BIGINT) AS layer FROM scc s JOIN walks w ON s.scc_id = w.node GROUP BY s.id",
    "history": "SELECT series, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS idx, day, value, n, mean FROM (SELECT event_type AS series, CAST(ts AS DATE) AS day, round(SUM(value), 4) AS value, COUNT(*) AS n, AVG(value) AS mean FROM events GROUP BY ALL)",
    "forest": "SELECT id AS src, parent_id AS dst FROM symbols WHERE parent_id IN (SELECT id FROM symbols)",
    "prices": "SELECT l_suppkey AS series, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx, l_extendedprice AS value FROM lineitem",
    "names": "SELECT id, CASE id % 7 WHEN 3 THEN a || '_' || b WHEN 4 THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] WHEN 5 THEN a || '-' || b WHEN 6 THEN '_' || a || '_' || b ELSE CASE WHEN kind = 'constant' THEN upper(a || '_' || b) WHEN kind IN ('class', 'interface') THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] WHEN language = 'ASIA' THEN a || '_' || b ELSE a || upper(b[1]) || b[2:] END END AS name, kind, is_exported, language FROM (SELECT s.id, s.kind, s.is_exported, f.language, split_part(s.name, ' ', 1) AS a, split_part(s.name, ' ', 2) AS b FROM symbols s JOIN files f ON s.file_id = f.id)",
    "code_refs": "SELECT ref, CASE WHEN q = 2 THEN p_name ELSE '' END AS source_name, CASE q WHEN 0 THEN p_brand || '.' || p_name WHEN 1 THEN upper(p_name) ELSE p_name END AS target_name, CASE n WHEN 0 THEN 'call' WHEN 1 THEN 'import' WHEN 2 THEN 'inherits' ELSE 'reference' END AS kind, line, CASE WHEN n = 1 THEN 'NATION_' || CAST(o % 25 AS VARCHAR) ELSE '' END AS import_path, s AS ref_file FROM (SELECT l_orderkey * 100 + l_linenumber AS ref, l_orderkey AS o, l_linenumber % 4 AS n, l_orderkey % 5 AS q, MIN(l_suppkey) AS s, MIN(l_partkey) AS p, CAST(MIN(l_quantity) AS BIGINT) AS line FROM lineitem GROUP BY l_orderkey, l_linenumber) JOIN part ON p = p_partkey JOIN files f ON s = f.id",
}


def oracle(sql: str) -> str:
    """sql with the model tables that it names, directly or not, before it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(SQL[name])

    visit(sql)
    heads = [f"{n} AS ({SQL[n]})" for n in SQL if n in needed]
    if not heads:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH "):
        heads.append(body[5:].removeprefix("RECURSIVE "))
        return "WITH RECURSIVE " + ",\n".join(heads)
    return "WITH RECURSIVE " + ",\n".join(heads) + "\n" + body
