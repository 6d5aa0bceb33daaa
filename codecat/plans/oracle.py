"""DuckDB SQL for the driver queries: the catalogue bindings as CTEs.

Each driver query's oracle is ``WITH <bindings> <query>``; the CTEs below
restate ``codecat.plans.bindings`` in plain SQL, independently of Spark.
"""

from __future__ import annotations

NPK = """npk AS (
  SELECT n.n_nationkey AS nationkey,
         'example.com/' || replace(lower(r.r_name), ' ', '_') || '/' || lower(n.n_name) AS package,
         lower(n.n_name) AS name,
         '/src/' || replace(lower(r.r_name), ' ', '_') || '/' || lower(n.n_name) AS dir
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

FN = """fn AS (
  SELECT p.package,
         CASE WHEN c.c_acctbal < 0 THEN 'customer' ELSE 'Customer' END || CAST(c.c_custkey AS VARCHAR) AS name,
         CAST(NULL AS VARCHAR) AS receiver,
         'func ' || CASE WHEN c.c_acctbal < 0 THEN 'customer' ELSE 'Customer' END || CAST(c.c_custkey AS VARCHAR)
           || '(segment string) float64' AS signature,
         CASE WHEN c.c_acctbal < 0 THEN 'customer' ELSE 'Customer' END || CAST(c.c_custkey AS VARCHAR)
           || ' serves the ' || lower(c.c_mktsegment) || ' segment.' AS doc,
         '{' || chr(10) || chr(9) || 'return balance("' || c.c_mktsegment || '")' || chr(10) || '}' AS body,
         p.dir || '/' || lower(c.c_mktsegment) || '.go' AS file,
         c.c_custkey AS line
  FROM customer c JOIN npk p ON c.c_nationkey = p.nationkey)"""

ST = """st AS (
  SELECT s.s_suppkey AS suppkey, p.package,
         CASE WHEN s.s_acctbal < 0 THEN 'supplier' ELSE 'Supplier' END || CAST(s.s_suppkey AS VARCHAR) AS name,
         'struct' AS kind,
         CASE WHEN s.s_acctbal < 0 THEN 'supplier' ELSE 'Supplier' END || CAST(s.s_suppkey AS VARCHAR)
           || ' supplies parts.' AS doc,
         p.dir || '/suppliers.go' AS file,
         s.s_suppkey AS line
  FROM supplier s JOIN npk p ON s.s_nationkey = p.nationkey)"""

IT = """it AS (
  SELECT o.o_orderkey AS orderkey, p.package, 'Order' || CAST(o.o_orderkey AS VARCHAR) AS name,
         'interface' AS kind,
         'Order' || CAST(o.o_orderkey AS VARCHAR) || ' lists the parts of one order.' AS doc,
         p.dir || '/orders_' || lower(o.o_orderstatus) || '.go' AS file,
         o.o_orderkey AS line
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN npk p ON c.c_nationkey = p.nationkey)"""

TY = """ty AS (
  SELECT package, name, kind, doc, file, line FROM st
  UNION ALL SELECT package, name, kind, doc, file, line FROM it)"""

SM = """sm AS (
  SELECT st.package, st.name AS type_name, 'Part' || CAST(m.l_partkey AS VARCHAR) AS name,
         CASE WHEN m.ptr THEN '*' ELSE '' END || st.package || '.' || st.name AS receiver,
         m.ptr AS ptr_receiver,
         'func (' || CASE WHEN m.ptr THEN '*' ELSE '' END || st.package || '.' || st.name || ') Part'
           || CAST(m.l_partkey AS VARCHAR) || '() int' AS signature,
         '() int' AS sig_key, false AS is_promoted, st.file, m.l_partkey AS line
  FROM (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS ptr
        FROM lineitem GROUP BY l_suppkey, l_partkey) m
  JOIN st ON m.l_suppkey = st.suppkey)"""

IM = """im AS (
  SELECT it.package, it.name AS type_name, 'Part' || CAST(m.l_partkey AS VARCHAR) AS name,
         it.package || '.' || it.name AS receiver, false AS ptr_receiver,
         'func (' || it.package || '.' || it.name || ') Part' || CAST(m.l_partkey AS VARCHAR) || '() int' AS signature,
         '() int' AS sig_key, false AS is_promoted, it.file, m.l_partkey AS line
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) m
  JOIN it ON m.l_orderkey = it.orderkey)"""

ME = """me AS (SELECT * FROM sm UNION ALL SELECT * FROM im)"""

VS = """vs AS (
  SELECT 'example.com/parts/' || lower(p_type) AS package,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')
           || CAST(p_partkey AS VARCHAR) AS name,
         CASE WHEN p_size > 25 THEN 'untyped float' ELSE 'float64' END AS type,
         p_size > 25 AS is_const, p_name AS doc,
         '/src/parts/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '.go' AS file,
         p_partkey AS line
  FROM part)"""

PK = """pk0 AS (
  SELECT package, name, dir FROM npk
  UNION ALL
  SELECT DISTINCT 'example.com/parts/' || lower(p_type), lower(p_type), '/src/parts/' || lower(p_type) FROM part),
pfiles AS (
  SELECT package, count(DISTINCT file) AS file_count FROM (
    SELECT package, file FROM fn UNION ALL SELECT package, file FROM ty UNION ALL SELECT package, file FROM vs)
  GROUP BY package),
pk AS (SELECT pk0.*, coalesce(pfiles.file_count, 0) AS file_count FROM pk0 LEFT JOIN pfiles USING (package))"""

REFS = """refs AS (
  SELECT name, package, 'func' AS kind, receiver, signature, file, line FROM fn
  UNION ALL SELECT name, package, 'type', NULL, NULL, file, line FROM ty
  UNION ALL SELECT name, package, 'method', receiver, signature, file, line FROM me WHERE NOT is_promoted
  UNION ALL SELECT name, package, CASE WHEN is_const THEN 'const' ELSE 'var' END, NULL, NULL, file, line FROM vs)"""

CATALOG = [NPK, FN, ST, IT, TY, SM, IM, ME, VS, PK, REFS]


def with_catalog(body: str, *extra: str) -> str:
    """``WITH`` the catalogue CTEs (plus ``extra`` ones) followed by ``body``."""
    return "WITH " + ",\n".join(CATALOG + [e.strip() for e in extra]) + "\n" + body
