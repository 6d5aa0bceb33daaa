"""Catalogue-shaped frames derived from the driver's test tables.

The test tables hold no Go code, so the driver queries bind catalogue
concepts onto them (the same operators then run on extracted code):

    package    nation (import path example.com/<region>/<nation>), and one
               package per part type for the constants/variables
    function   customer        -- unexported when the balance is negative
    struct     supplier        -- unexported when the balance is negative
    interface  order, in the package of its customer's nation
    method     distinct (supplier, part) of lineitem; pointer receiver when
               any of those lines has return flag R
    iface req  distinct (order, part) of lineitem: the methods an order needs
    var/const  part, named CamelCase(p_name) || key; constant when p_size > 25
    embed      supplier k -> k div 3 (value) and k div 4 (pointer), k > 0
    file       /src/<source>/<lang>/<doc_id>.txt for documents

Every frame is a projection/aggregation of whole tables: nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecat.schemas import Catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nation_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nationkey, package, name, dir) — 25 rows whatever the scale."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    region = F.regexp_replace(F.lower("r_name"), " ", "_")
    nation = F.lower("n_name")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").alias("nationkey"),
                    F.concat(F.lit("example.com/"), region, F.lit("/"), nation).alias("package"),
                    nation.alias("name"),
                    F.concat(F.lit("/src/"), region, F.lit("/"), nation).alias("dir")))


def part_packages(part: DataFrame) -> DataFrame:
    t = F.lower("p_type")
    return (part.select(F.concat(F.lit("example.com/parts/"), t).alias("package"),
                        t.alias("name"),
                        F.concat(F.lit("/src/parts/"), t).alias("dir"))
            .distinct())


def _cased(lower_when, stem: str, key) -> F.Column:
    return F.concat(F.when(lower_when, F.lit(stem.lower())).otherwise(F.lit(stem)), F.col(key).cast("string"))


def funcs(spark, sf_dir, npk: DataFrame) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = _cased(F.col("c_acctbal") < 0, "Customer", "c_custkey")
    seg = F.lower("c_mktsegment")
    return (c.join(npk, c.c_nationkey == npk.nationkey)
            .select("package", name.alias("name"),
                    F.lit(None).cast("string").alias("receiver"),
                    F.concat(F.lit("func "), name, F.lit("(segment string) float64")).alias("signature"),
                    F.concat(name, F.lit(" serves the "), seg, F.lit(" segment.")).alias("doc"),
                    F.concat(F.lit("{\n\treturn balance(\""), F.col("c_mktsegment"), F.lit("\")\n}")).alias("body"),
                    F.concat(F.col("dir"), F.lit("/"), seg, F.lit(".go")).alias("file"),
                    F.col("c_custkey").alias("line")))


def struct_types(spark, sf_dir, npk: DataFrame) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = _cased(F.col("s_acctbal") < 0, "Supplier", "s_suppkey")
    return (s.join(npk, s.s_nationkey == npk.nationkey)
            .select(F.col("s_suppkey").alias("suppkey"), "package", name.alias("name"),
                    F.lit("struct").alias("kind"),
                    F.concat(name, F.lit(" supplies parts.")).alias("doc"),
                    F.concat(F.col("dir"), F.lit("/suppliers.go")).alias("file"),
                    F.col("s_suppkey").alias("line")))


def interface_types(spark, sf_dir, npk: DataFrame) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    name = F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(npk, F.col("c_nationkey") == npk.nationkey)
            .select(F.col("o_orderkey").alias("orderkey"), "package", name.alias("name"),
                    F.lit("interface").alias("kind"),
                    F.concat(name, F.lit(" lists the parts of one order.")).alias("doc"),
                    F.concat(F.col("dir"), F.lit("/orders_"), F.lower("o_orderstatus"), F.lit(".go")).alias("file"),
                    F.col("o_orderkey").alias("line")))


def _together(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` before it is grouped by that key and others, and joined on it: one shuffle serves both.

    Nearly every row is a group of its own, so grouping before the shuffle would hold a task's whole input in memory,
    and spill it, to save nothing.  The number of partitions is given, else they are merged by their compressed size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def struct_methods(spark, sf_dir, structs: DataFrame) -> DataFrame:
    li = _together(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag"), "l_suppkey")
    m = (li.groupBy("l_suppkey", "l_partkey")
         .agg(F.max(F.col("l_returnflag") == "R").alias("ptr_receiver")))
    name = F.concat(F.lit("Part"), F.col("l_partkey").cast("string"))
    recv = F.concat(F.when(F.col("ptr_receiver"), F.lit("*")).otherwise(F.lit("")),
                    F.col("package"), F.lit("."), F.col("type_name"))
    return (m.join(structs.select("suppkey", "package", F.col("name").alias("type_name"), "file"),
                   m.l_suppkey == F.col("suppkey"))
            .select("package", "type_name", name.alias("name"), recv.alias("receiver"), "ptr_receiver",
                    F.concat(F.lit("func ("), recv, F.lit(") "), name, F.lit("() int")).alias("signature"),
                    F.lit("() int").alias("sig_key"), F.lit(False).alias("is_promoted"),
                    F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("body"),
                    "file", F.col("l_partkey").alias("line")))


def interface_methods(spark, sf_dir, ifaces: DataFrame) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    m = _together(li.select("l_orderkey", "l_partkey"), "l_orderkey").distinct()
    name = F.concat(F.lit("Part"), F.col("l_partkey").cast("string"))
    recv = F.concat(F.col("package"), F.lit("."), F.col("type_name"))
    return (m.join(ifaces.select("orderkey", "package", F.col("name").alias("type_name"), "file"),
                   m.l_orderkey == F.col("orderkey"))
            .select("package", "type_name", name.alias("name"), recv.alias("receiver"),
                    F.lit(False).alias("ptr_receiver"),
                    F.concat(F.lit("func ("), recv, F.lit(") "), name, F.lit("() int")).alias("signature"),
                    F.lit("() int").alias("sig_key"), F.lit(False).alias("is_promoted"),
                    F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("body"),
                    "file", F.col("l_partkey").alias("line")))


def camel(c) -> F.Column:
    """``large ring`` -> ``LargeRing``."""
    return F.regexp_replace(F.initcap(c), " ", "")


def part_vars(part: DataFrame) -> DataFrame:
    t = F.lower("p_type")
    is_const = F.col("p_size") > 25
    return part.select(
        F.concat(F.lit("example.com/parts/"), t).alias("package"),
        F.concat(camel(F.col("p_name")), F.col("p_partkey").cast("string")).alias("name"),
        F.when(is_const, F.lit("untyped float")).otherwise(F.lit("float64")).alias("type"),
        is_const.alias("is_const"),
        F.col("p_name").alias("doc"),
        F.concat(F.lit("/src/parts/"), t, F.lit("/"),
                 F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit(".go")).alias("file"),
        F.col("p_partkey").alias("line"))


def package_table(pk: DataFrame, *members: DataFrame) -> DataFrame:
    """Packages with the sorted distinct list of their files."""
    files = None
    for m in members:
        pf = m.select("package", "file")
        files = pf if files is None else files.unionByName(pf)
    per_pkg = (files.groupBy("package")
               .agg(F.array_sort(F.collect_set("file")).alias("files")))
    return (pk.join(per_pkg, "package", "left")
            .select("package", "name", "dir",
                    F.coalesce("files", F.array().cast("array<string>")).alias("files")))


def tpch_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    npk = nation_packages(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    structs = struct_types(spark, sf_dir, npk)
    ifaces = interface_types(spark, sf_dir, npk)
    fn = funcs(spark, sf_dir, npk)
    vs = part_vars(part)
    types = structs.drop("suppkey").unionByName(ifaces.drop("orderkey"))
    methods = struct_methods(spark, sf_dir, structs).unionByName(interface_methods(spark, sf_dir, ifaces))
    pk = npk.drop("nationkey").unionByName(part_packages(part))
    packages = package_table(pk, fn, types, vs)
    return Catalog(packages=packages, funcs=fn, types=types, methods=methods, vars=vs)


_INDEX: dict = {}


def materialize(cat: Catalog, *names: str, key: tuple | None = None) -> Catalog:
    """Checkpoint the named catalogue tables: the index is built once, then queried.

    With ``key`` (session, source) a table materialised earlier in the same
    session is reused, as the reference builds its index once at start-up
    and answers every look-up from it.
    """
    from codecat.session import cut_lineage
    out = {}
    for n in names:
        k = None if key is None else key + (n,)
        if k is not None and k in _INDEX:
            out[n] = _INDEX[k]
            continue
        out[n] = cut_lineage(getattr(cat, n))
        if k is not None:
            _INDEX[k] = out[n]
    return cat.with_(**out)


def supplier_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embed edges between supplier keys: k embeds k div 3 by value and k div 4
    through a pointer (one value embed when both are the same supplier); k > 0."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return (s.where(F.col("s_suppkey") > 0)
            .select(F.col("s_suppkey").alias("src_k"), F.expr("s_suppkey div 3").alias("d3"),
                    F.expr("s_suppkey div 4").alias("d4"))
            .select("src_k", F.explode(F.array(
                F.struct(F.col("d3").alias("dst_k"), F.lit(False).alias("is_pointer")),
                F.struct(F.col("d4").alias("dst_k"), (F.col("d4") != F.col("d3")).alias("is_pointer")))).alias("e"))
            .select("src_k", "e.dst_k", "e.is_pointer").distinct())


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files: (file, package, doc_id, content)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("/src/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("package"),
        "doc_id", F.col("text").alias("content"))


def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows from conversations, one per conversation.

    run = conv_id div 2 and arm = baseline / index alternately, so each run
    pairs two sessions as the benchmark interleaves them.  Token counts are
    text bytes: user -> input, assistant -> output, system -> cache read,
    the opening turn -> cache creation.  A user turn over the 2,048-byte
    argument cap counts as a permission denial.  Cost is priced per token.
    """
    c = table(spark, sf_dir, "conversations")
    b = F.octet_length("text").cast("long")
    role = F.col("role")
    runs = (c.groupBy("conv_id")
            .agg(F.coalesce(F.sum(F.when(role == "user", b)), F.lit(0)).cast("long").alias("input"),
                 F.coalesce(F.sum(F.when(role == "assistant", b)), F.lit(0)).cast("long").alias("output"),
                 F.coalesce(F.sum(F.when(role == "system", b)), F.lit(0)).cast("long").alias("cache_read"),
                 F.min_by(b, F.col("turn")).alias("cache_creation"),
                 F.sort_array(F.collect_list(F.when((role == "user") & (b > 2048), F.col("turn").cast("string"))))
                 .alias("denied_turns")))
    cost = (F.col("input") * 3.0 + F.col("output") * 15.0 + F.col("cache_read") * 0.3
            + F.col("cache_creation") * 3.75) / 1000000.0
    return runs.select(
        "conv_id",
        F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit("baseline")).otherwise(F.lit("index")).alias("arm"),
        F.expr("conv_id div 2").alias("run"),
        "input", "output", "cache_read", "cache_creation", cost.alias("cost"), "denied_turns")
