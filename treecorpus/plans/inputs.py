"""Operator inputs derived from the driver tables, in Spark and (as CTE text) in SQL.

The tables become a resource tree (one JSON body per row), mixer records, prediction rows and
transitions. Bodies are built row by row; a parent points at children through min/max
aggregates, so no body grows with the number of children.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treecorpus.functions.hashing import md5_fraction
from treecorpus.session import already_staged, staged_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(*parts) -> Column:
    """Concatenate literals (str) and columns as strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def obj(*pairs: tuple[str, Column | str]) -> Column:
    """A JSON object with keys in the given order; null members are left out by to_json."""
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in pairs])


def ref(url: Column | str) -> Column:
    return obj(("@odata.id", url))


def md5_long(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


# --- resource tree -----------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RESETS = ["On", "ForceOff", "GracefulRestart"]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _nations(spark, sf):
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn(
        "n_url", text_of("/v1/regions/", F.col("r_regionkey"), "/nations/", F.col("n_nationkey"))
    )


def customers(spark, sf) -> DataFrame:
    nat = _nations(spark, sf).select("n_nationkey", "n_url")
    return table(spark, sf, "customer").join(nat, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "c_url", text_of(F.col("n_url"), "/customers/", F.col("c_custkey"))
    )


def orders(spark, sf) -> DataFrame:
    cus = customers(spark, sf).select("c_custkey", "c_url")
    return table(spark, sf, "orders").join(cus, F.col("o_custkey") == F.col("c_custkey")).withColumn(
        "o_url", text_of(F.col("c_url"), "/orders/", F.col("o_orderkey"))
    )


def line_captures(spark, sf) -> DataFrame:
    """Line items with their capture order ``l_seq``; a line number of an order may come several times."""
    parts = (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
             F.col("l_quantity").cast("int"), cents("l_extendedprice"))
    return table(spark, sf, "lineitem").withColumn(
        "l_seq", md5_long(F.concat_ws("-", *[c.cast("string") for c in parts])))


def lines(spark, sf) -> DataFrame:
    rows = orders(spark, sf).select("o_orderkey", "o_url", "c_custkey")
    return line_captures(spark, sf).join(rows, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "l_url", text_of(F.col("o_url"), "/lines/", F.col("l_linenumber")))


def _record(df: DataFrame, url, host, seq, kind, type_name, vendor, *members) -> DataFrame:
    head = [("@odata.id", url)]
    if type_name:
        head.append(("@odata.type", type_name))
    as_col = lambda v: F.lit(v) if isinstance(v, (str, int)) else v
    return df.select(
        as_col(url).alias("url"),
        as_col(host).cast("string").alias("host"),
        as_col(seq).cast("bigint").alias("seq"),
        F.lit(kind).alias("source"),
        as_col(vendor).alias("vendor"),
        F.lit(5).alias("trust"),
        F.to_json(obj(*head, *members)).alias("body"),
    )


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """The resource tree, staged as a table: the corpus every tree operator starts from."""
    return spark.read.parquet(tree_path(spark, sf))


def tree_path(spark: SparkSession, sf: str) -> str:
    """The folder of the staged resource tree."""
    return staged_path(spark, "tree", sf, lambda path: build_tree(spark, sf).write.option("compression", "zstd").parquet(path))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the tree for one reader: from the staged table if there is one, else as they are made.

    What is reduced and staged itself (the last capture per URL) needs no second copy of all bodies.
    """
    path = already_staged(spark, "tree", sf)
    return spark.read.parquet(path) if path else build_tree(spark, sf)


def build_tree(spark: SparkSession, sf: str) -> DataFrame:
    """``url, host, seq, source, vendor, trust, body`` for every row of the relational tables."""
    col = F.col
    region = table(spark, sf, "region")
    one = region.filter("r_regionkey = 0").select()
    root = _record(one, "/v1", "fabric", 0, "root", "#ServiceRoot.v1.ServiceRoot", "",
                   ("Name", "root"), ("Regions", ref("/v1/regions")))
    region_urls = region.agg(
        F.array_sort(F.collect_list(text_of("/v1/regions/", col("r_regionkey")))).alias("urls")
    )
    regions = _record(region_urls, "/v1/regions", "fabric", 0, "regions", "#Collection.Collection", "",
                      ("Name", "regions"), ("Members", F.transform("urls", ref)))
    region_url = text_of("/v1/regions/", col("r_regionkey"))
    region_rows = _record(
        region.join(
            _nations(spark, sf).groupBy(col("n_regionkey").alias("k")).agg(F.min("n_url").alias("first")),
            col("r_regionkey") == col("k"), "left",
        ),
        region_url, "fabric", col("r_regionkey"), "region", "#Region.v1.Region", "",
        ("Name", col("r_name")),
        ("FirstNation", F.when(col("first").isNotNull(), ref(col("first")))),
    )
    nation_rows = _record(_nations(spark, sf), col("n_url"), "fabric", col("n_nationkey"), "nation",
                          "#Nation.v1.Nation", "", ("Name", col("n_name")))
    # The least child URL under one prefix is the least child key as text: no join needed.
    first_order = table(spark, sf, "orders").groupBy(col("o_custkey").alias("c_custkey")).agg(
        F.min(col("o_orderkey").cast("string")).alias("first"))
    cus = customers(spark, sf).join(first_order, "c_custkey", "left")
    customer_rows = _record(
        cus, col("c_url"), text_of("c", col("c_custkey")), col("c_custkey"), "customer",
        "#ComputerSystem.v1.ComputerSystem", F.lower("c_mktsegment"),
        ("Name", col("c_name")),
        ("PowerState", F.when(col("c_acctbal") >= 0, "On").otherwise("Off")),
        ("Status", obj(("Health", F.when(col("c_acctbal") < 0, "Critical")
                        .when(col("c_acctbal") < 3000, "Warning").otherwise("OK")))),
        ("Boot", obj(("BootSourceOverrideTarget", col("c_mktsegment")),
                     ("BootSourceOverrideTarget@Redfish.AllowableValues", _strings(SEGMENTS)))),
        ("Actions", F.when(col("c_acctbal") >= 0, obj(
            ("#ComputerSystem.Reset", obj(
                ("target", text_of(col("c_url"), "/Actions/ComputerSystem.Reset")),
                ("ResetType@Redfish.AllowableValues", _strings(RESETS)))),
            ("#ComputerSystem.Ping", obj(
                ("target", text_of(col("c_url"), "/Actions/ComputerSystem.Ping"))))))),
        ("FirstOrder", F.when(col("first").isNotNull(), ref(text_of(col("c_url"), "/orders/", col("first"))))),
    )
    first_line = table(spark, sf, "lineitem").groupBy(col("l_orderkey").alias("o_orderkey")).agg(
        F.min(col("l_linenumber").cast("string")).alias("first"))
    order_rows = _record(
        orders(spark, sf).join(first_line, "o_orderkey", "left"),
        col("o_url"), text_of("c", col("c_custkey")), col("o_orderkey"), "order", "#Task.v1.Task", "",
        ("Name", text_of("order ", col("o_orderkey"))),
        ("TaskState", col("o_orderstatus")),
        ("Priority", col("o_orderpriority")),
        ("Total", cents("o_totalprice")),
        ("Created", F.date_format("o_orderdate", "yyyy-MM-dd")),
        ("FirstLine", F.when(col("first").isNotNull(), ref(text_of(col("o_url"), "/lines/", col("first"))))),
    )
    line_rows = _record(
        lines(spark, sf), col("l_url"), text_of("c", col("c_custkey")), col("l_seq"), "line",
        "#Drive.v1.Drive", "",
        ("Name", text_of("line ", col("l_linenumber"))),
        ("Status", obj(("Health", F.when(col("l_returnflag") == "A", "Warning")
                        .when(col("l_returnflag") == "R", "Critical").otherwise("OK")))),
        ("Quantity", col("l_quantity").cast("int")),
        ("Oem", obj(("Part", ref(text_of("/v1/parts/", col("l_partkey")))),
                    ("Supplier", ref(text_of("/v1/suppliers/", col("l_suppkey"), "/"))))),
        ("Shipped", col("l_linestatus") == "F"),
    )
    part = table(spark, sf, "part")
    part_host = text_of("p", F.floor(col("p_partkey") / 50))
    part_rows = _record(
        part, text_of("/v1/parts/", col("p_partkey")), part_host, col("p_partkey"), "part",
        "#Bios.v1.Bios", "",
        ("Name", col("p_name")),
        ("Attributes", obj(("Brand", col("p_brand")), ("Size", col("p_size")))),
        ("SerialNumber", text_of("SN", col("p_partkey"))),
    )
    registry_rows = _record(
        part, text_of("/v1/registries/", col("p_partkey")), part_host, col("p_partkey"), "registry",
        "#AttributeRegistry.v1.AttributeRegistry", "",
        ("Name", "registry"),
        ("RegistryEntries", obj(("Attributes", F.array(
            obj(("AttributeName", "Size"), ("Type", "Integer"), ("ReadOnly", F.lit(False)),
                ("CurrentValue", col("p_size").cast("string")),
                ("Value", F.lit(None).cast("array<struct<ValueName:string>>"))),
            obj(("AttributeName", text_of("Brand", col("p_size"))), ("Type", "Enumeration"),
                ("ReadOnly", col("p_size") % 2 == 0), ("CurrentValue", col("p_brand")),
                ("Value", F.array(obj(("ValueName", col("p_brand"))), obj(("ValueName", "Other"))))),
        )))),
    )
    supplier = table(spark, sf, "supplier")
    supplier_host = text_of("s", F.floor(col("s_suppkey") / 50))
    supplier_url = text_of("/v1/suppliers/", col("s_suppkey"))
    supplier_rows = _record(
        supplier, supplier_url, supplier_host, col("s_suppkey"), "supplier",
        "#ManagerNetworkProtocol.v1.ManagerNetworkProtocol", "",
        ("Name", col("s_name")),
        ("NTP", obj(("ProtocolEnabled", col("s_acctbal") >= 0),
                    ("NTPServers", F.array(text_of("ntp-a", col("s_suppkey")),
                                           text_of("ntp-b", col("s_nationkey")))))),
    )
    info_rows = _record(
        supplier, text_of(supplier_url, "/ResetInfo"), supplier_host, col("s_suppkey"), "info",
        "#ActionInfo.v1.ActionInfo", "",
        ("Name", "ResetInfo"),
        ("Parameters", F.array(
            obj(("Name", "ResetType"), ("DataType", "String"), ("Required", F.lit(True)),
                ("AllowableValues", F.array(F.lit("On"), F.lit("Off")))),
            obj(("Name", text_of("Delay", col("s_nationkey"))), ("DataType", "Integer"),
                ("Required", F.lit(False)), ("AllowableValues", F.lit(None).cast("array<string>"))))),
    )
    option_rows = _record(
        supplier, text_of(supplier_url, "/BootOptions/", col("s_suppkey")), supplier_host,
        col("s_suppkey"), "option", None, "",
        ("Name", "option"),
        ("BootOptionReference", F.when(col("s_suppkey") % 2 == 0, text_of("Boot", col("s_nationkey")))),
        ("Id", text_of("Id", col("s_nationkey"))),
    )
    parts = [root, regions, region_rows, nation_rows, customer_rows, order_rows, line_rows,
             part_rows, registry_rows, supplier_rows, info_rows, option_rows]
    return reduce(DataFrame.unionByName, parts)


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """The tree as a partial crawl: about a tenth of the URLs were never fetched."""
    return captures(spark, sf).filter(md5_fraction(F.concat(F.lit("drop:"), F.col("url"))) >= 0.1)


def h_sql(text: str) -> str:
    """SQL for :func:`md5_fraction`."""
    return f"(('0x'||substr(md5({text}),1,8))::ubigint/4294967296.0)"


TREE_SQL = """
nat as (select n.*, r_name, r_regionkey, '/v1/regions/'||r_regionkey rurl,
        '/v1/regions/'||r_regionkey||'/nations/'||n_nationkey url
        from nation n join region on n_regionkey = r_regionkey),
cus as (select c.*, nat.url||'/customers/'||c_custkey url, [nat.url, rurl, '/v1/regions', '/v1'] anc
        from customer c join nat on c_nationkey = n_nationkey),
ord as (select o.*, c_custkey, cus.url||'/orders/'||o_orderkey url, cus.url curl,
        list_prepend(cus.url, cus.anc) anc
        from orders o join cus on o_custkey = c_custkey),
lin as (select l.*, c_custkey, ord.url||'/lines/'||l_linenumber url, ord.url ourl,
        list_prepend(ord.url, ord.anc) anc,
        ('0x'||substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_quantity::int, round(l_extendedprice*100)::bigint)),1,15))::bigint seq
        from lineitem l join ord on l_orderkey = o_orderkey),
rec as (
  select '/v1' url, 'fabric' host, 0::bigint seq, 'root' kind, '#ServiceRoot.v1.ServiceRoot' rtype,
         []::varchar[] anc, '' vendor
  union all select '/v1/regions', 'fabric', 0, 'regions', '#Collection.Collection', ['/v1'], ''
  union all select '/v1/regions/'||r_regionkey, 'fabric', r_regionkey, 'region', '#Region.v1.Region',
         ['/v1/regions', '/v1'], '' from region
  union all select url, 'fabric', n_nationkey, 'nation', '#Nation.v1.Nation',
         [rurl, '/v1/regions', '/v1'], '' from nat
  union all select url, 'c'||c_custkey, c_custkey, 'customer', '#ComputerSystem.v1.ComputerSystem',
         anc, lower(c_mktsegment) from cus
  union all select url, 'c'||c_custkey, o_orderkey, 'order', '#Task.v1.Task', anc, '' from ord
  union all select url, 'c'||c_custkey, seq, 'line', '#Drive.v1.Drive', anc, '' from lin
  union all select '/v1/parts/'||p_partkey, 'p'||(p_partkey//50), p_partkey, 'part', '#Bios.v1.Bios',
         ['/v1'], '' from part
  union all select '/v1/registries/'||p_partkey, 'p'||(p_partkey//50), p_partkey, 'registry',
         '#AttributeRegistry.v1.AttributeRegistry', ['/v1'], '' from part
  union all select '/v1/suppliers/'||s_suppkey, 's'||(s_suppkey//50), s_suppkey, 'supplier',
         '#ManagerNetworkProtocol.v1.ManagerNetworkProtocol', ['/v1'], '' from supplier
  union all select '/v1/suppliers/'||s_suppkey||'/ResetInfo', 's'||(s_suppkey//50), s_suppkey, 'info',
         '#ActionInfo.v1.ActionInfo', ['/v1/suppliers/'||s_suppkey, '/v1'], '' from supplier
  union all select '/v1/suppliers/'||s_suppkey||'/BootOptions/'||s_suppkey, 's'||(s_suppkey//50),
         s_suppkey, 'option', '', ['/v1/suppliers/'||s_suppkey, '/v1'], '' from supplier)
"""

CRAWL_SQL = TREE_SQL + f""",
walk as (select * from rec where {h_sql("'drop:'||url")} >= 0.1),
unode as (select distinct url, host, kind, rtype,
          list_filter(anc, lambda x: {h_sql("'drop:'||x")} >= 0.1) anc from walk),
node as (select *, case when len(anc) > 0 then anc[1] end parent from unode)
"""

# --- mixer records -----------------------------------------------------------------------------


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as provenance-tagged captures; three copies share a URL."""
    col = F.col
    url = text_of("/d/", F.floor(col("doc_id") / 3))
    lang_type = text_of("#", F.upper("lang"), ".v1.Document")
    body = F.to_json(obj(
        ("@odata.id", url), ("@odata.type", lang_type), ("Text", col("text")),
        ("Lang", col("lang")), ("Size", col("n_chars")),
    ))
    methods = (
        F.when(col("doc_id") % 4 == 0, F.array(F.lit("get"), F.lit("patch")))
        .when(col("doc_id") % 4 == 1, F.array(F.lit("GET")))
        .when(col("doc_id") % 4 == 2, F.array(F.lit("POST"), F.lit("GET")))
    )
    return table(spark, sf, "documents").select(
        url.alias("url"),
        col("doc_id").cast("bigint").alias("seq"),
        col("source"),
        (1 + col("doc_id") % 5).cast("int").alias("trust"),
        F.when(col("doc_id") % 7 == 0, "patch").when(col("doc_id") % 7 == 1, "HEAD")
        .otherwise("GET").alias("method"),
        methods.alias("allowed_methods"),
        F.when(col("doc_id") % 11 != 0, col("lang")).alias("vendor"),
        lang_type.alias("schema_version"),
        body.alias("body"),
    )


RECORDS_SQL = """
r as (select '/d/'||(doc_id//3) url, doc_id seq, source, 1 + doc_id % 5 trust, lang, text, n_chars,
      case doc_id % 7 when 0 then 'patch' when 1 then 'HEAD' else 'GET' end as "method",
      case doc_id % 4 when 0 then ['get','patch'] when 1 then ['GET'] when 2 then ['POST','GET'] end methods,
      case when doc_id % 11 <> 0 then lang end vendor, '#'||upper(lang)||'.v1.Document' stype
      from documents)
"""
