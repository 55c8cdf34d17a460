"""The feeds, derived from the driver's star-schema tables.

Every view is a narrow projection of whole tables; joins are added only for
attributes a query asks for.  None of them needs a global order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave import constants as C
from tallyweave.operators import enrich, feeds, match
from tallyweave.plans import consolidation, store
from tallyweave.session import has_shared_dir, shared_dir

#: attribute of a dispute -> table it is looked up in
DISPUTE_ATTRIBUTES = ("dispute_reason", "payment_method", "shopper_email")


#: declared, so that reading a table takes no extra job to look into its files
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def raw_disputes(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    """All record types, one row per line item.

    Some have no reference or no amount, one reference holds an eleventh of all rows,
    and some labels are empty or the text ``nan``.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        "l_returnflag", "l_linestatus", "l_shipdate")  # amounts are narrower than prices where the lines are shuffled
    unknown = set(attributes) - set(DISPUTE_ATTRIBUTES)
    if unknown:
        raise ValueError(f"unknown attributes {sorted(unknown)}")
    if "dispute_reason" in attributes:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("dispute_reason"))
        lines = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    if {"payment_method", "shopper_email"} & set(attributes):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customer = table(spark, sf_dir, "customer").select(
            "c_custkey",
            F.when(F.col("c_custkey") % 29 == 0, "").when(F.col("c_custkey") % 31 == 0, "nan")
            .otherwise(F.lower("c_mktsegment")).alias("payment_method"),
            F.col("c_name").alias("shopper_email"),
        )
        owners = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        lines = lines.join(owners, lines["l_orderkey"] == owners["o_orderkey"])
    key = F.col("l_orderkey")
    order_key = key.cast("string")
    amount = F.col("amount")
    reference = F.when(key % 11 == 0, F.lit("11")).otherwise(order_key)
    return lines.select(
        F.concat_ws("-", order_key, F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    amount.cast("string")).alias("dispute_id"),
        F.when(key % 53 != 0, F.lpad(reference, 16, "0")).alias("psp_reference"),
        F.when(F.col("l_returnflag") == "R", "Chargeback")
        .when(F.col("l_returnflag") == "A", "NotificationOfChargeback")
        .otherwise("Settled").alias("record_type"),
        F.when((key + F.col("l_linenumber")) % 61 != 0, amount).alias("dispute_amount"),
        F.col("l_shipdate").alias("record_date"),
        F.when(key % 67 == 0, "nan").when(key % 71 == 0, "").otherwise(F.col("l_linestatus")).alias("shopper_interaction"),
        F.when(F.col("l_linenumber") == 7, "{bad")
        .when(F.col("l_linenumber") == 6, "{}")
        .otherwise(F.concat(F.lit('{"orderId":"'), order_key, F.lit('"}'))).alias("metadata"),
        *attributes,
    )


def disputes(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    return feeds.prepare_disputes(raw_disputes(spark, sf_dir, *attributes))


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all kinds, some without a reference, some repeated."""
    key = F.col("o_orderkey")
    repeated = (key % 10 == 0) & (F.col("o_orderstatus") == "F")
    orders = table(spark, sf_dir, "orders").withColumn("copy", _copies(repeated))
    ref = F.lpad(key.cast("string"), 16, "0")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return orders.select(
        (key * 2 + F.col("copy")).alias("ordinal"),
        F.when(F.col("copy") == 1, F.concat(F.lit("CHARGEBACK NSU "), ref))
        .when(F.col("o_orderstatus") == "F",
              F.concat(F.lit("Chargeback NSU: "), ref, F.lit("-"), F.col("o_custkey").cast("string")))
        .when(F.col("o_orderstatus") == "P", "CHARGEBACK SEM REFERENCIA")
        .otherwise(F.concat(F.lit("PAGAMENTO NSU: "), ref)).alias("denominacao_sap"),
        F.col("o_orderdate").alias("data_lancamento_sap"),
        F.when((F.col("copy") == 0) & (key % 17 == 0), "n/d").otherwise(price).alias("valor_sap"),
    )


def _copies(repeated: Column) -> Column:
    """0 for every row, and 1 for a second row where the test holds."""
    return F.explode(F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.prepare_ledger(raw_ledger(spark, sf_dir))


def raw_antifraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows under the headers of the report; urgent orders may have two.

    Orders of the lower priorities are reported under an id that no dispute has.
    """
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    revised = (priority == "1-URGENT") & (key % 4 == 0)
    orders = table(spark, sf_dir, "orders").withColumn("copy", _copies(revised))
    known = F.when(priority.isin("1-URGENT", "2-HIGH"), "").otherwise("N")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    wide = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(
        nation, customer["c_nationkey"] == nation["n_nationkey"]
    )
    first = F.col("copy") == 0
    city = F.concat(F.lit("CITY_"), (F.col("c_custkey") % 50).cast("string"))
    return wide.select(
        (key * 2 + F.col("copy")).alias("ordinal"),
        F.concat_ws("-", F.concat(known, key.cast("string")), F.when(first, F.col("o_custkey").cast("string"))
                    .otherwise("X")).alias("PEDIDO"),
        F.when(first, priority).otherwise("9-REVISED").alias("STATUS DO CHARGEBACK"),
        F.when(first & (key % 7 != 0), city).alias("CIDADE"),
        F.col("n_name").alias("UF"),
        F.col("c_mktsegment").alias("ITEM PRINCIPAL"),
        F.col("c_acctbal").alias("SCORE"),
    )


def antifraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = feeds.prepare_antifraud(raw_antifraud(spark, sf_dir), "PEDIDO",
                                       [F.desc("ordinal")], keep=("ordinal",))
    return prepared.drop("ordinal")


# One row per order document.  The text runs in both engines but for the way an
# array becomes rows; the JSON is built from it on the Spark side, the expected
# attributes on the SQL side.  Some orders have a second document (copy 1) that
# must lose against the usual one, and some have an id that no dispute names.
_DOCUMENT_ROWS = """
SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 4 = 3 THEN concat('N', CAST(o_orderkey AS STRING))
    WHEN copy = 1 OR o_orderkey % 4 = 1 THEN CAST(o_orderkey AS STRING)
    WHEN o_orderkey % 4 = 0 THEN concat(CAST(o_orderkey AS STRING), '-01')
    ELSE concat(CAST(o_orderkey AS STRING), '-02') END AS order_id,
  concat('host', CAST(o_orderkey % 5 AS STRING)) AS hostname,
  o_orderkey % 6 AS seller_case,
  concat('STORE ', n_name, ' - 12345678 - ', CAST(o_custkey % 7 AS STRING)) AS seller_name,
  n_name AS state,
  CASE WHEN copy = 1 THEN 'SHADOW'
    WHEN o_orderkey % 13 <> 0 THEN concat('CITY_', CAST(o_custkey % 50 AS STRING)) END AS city,
  lpad(CAST(o_custkey AS STRING), 8, '0') AS postal_code,
  CASE WHEN o_orderkey % 3 = 0 THEN 'pickup-point' ELSE 'residential' END AS address_type,
  CASE o_orderkey % 7 WHEN 0 THEN 'Retirada em loja' WHEN 1 THEN 'Entrega expressa'
    WHEN 2 THEN 'Motoboy' WHEN 3 THEN 'SEDEX' WHEN 4 THEN NULL WHEN 5 THEN ''
    ELSE 'Agendada' END AS sla,
  concat(CAST(o_orderkey % 9 AS STRING), 'bd') AS estimate,
  o_orderkey % 17 AS logistics_case,
  o_orderkey % 5 AS installments,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS pay_cents,
  o_orderkey % 19 AS payment_case,
  CASE o_orderkey % 4 WHEN 0 THEN concat('PROMO', CAST(o_orderkey % 40 AS STRING))
    WHEN 1 THEN '' END AS coupon,
  CASE WHEN o_orderkey % 3 = 1 THEN concat('CODE', CAST(o_orderkey % 30 AS STRING)) END AS coupon_code,
  o_orderkey % 3 * -500 AS discount_cents,
  o_orderkey % 23 AS totals_case,
  o_orderkey % 8 AS package_case,
  concat('NFE', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS invoice_key,
  CAST(o_orderkey + 1000 AS STRING) AS invoice_number,
  o_orderkey % 9 % 4 AS n_items,
  concat(o_orderpriority, ' kit') AS item1,
  CASE WHEN o_orderkey % 5 <> 0 THEN concat('refill ', c_mktsegment) END AS item2,
  concat('gift ', n_name) AS item3,
  c_mktsegment AS cat_a, o_orderpriority AS cat_b,
  CASE WHEN o_orderkey % 11 <> 0 THEN r_name END AS cat_c,
  concat('ORIGIN ', n_name) AS cat_d
FROM (SELECT *, {rows} AS copy FROM orders) o
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

_SECOND = "CASE WHEN o_orderkey % 8 = 0 THEN {two} ELSE {one} END"
DOCUMENT_ROWS_SQL = _DOCUMENT_ROWS.format(
    rows="unnest(" + _SECOND.format(two="[0, 1]", one="[0]") + ")")
_DOCUMENT_ROWS_SPARK = _DOCUMENT_ROWS.format(
    rows="explode(" + _SECOND.format(two="array(0, 1)", one="array(0)") + ")")

_DOCUMENT_JSON = """
to_json(named_struct(
  'hostname', hostname,
  'sellers', CASE seller_case WHEN 0 THEN array() WHEN 1 THEN array(named_struct('name', ''))
             ELSE array(named_struct('name', seller_name)) END,
  'shippingData', named_struct(
    'address', named_struct('state', state, 'city', city, 'postalCode', postal_code,
                            'addressType', address_type),
    'logisticsInfo', CASE WHEN logistics_case = 0 THEN array()
       ELSE array(named_struct('selectedSla', sla, 'shippingEstimate', estimate)) END),
  'packageAttachment', CASE WHEN package_case <> 7 THEN named_struct('packages',
     array(named_struct('invoiceKey', invoice_key, 'invoiceNumber', invoice_number))) END,
  'paymentData', named_struct('transactions', CASE WHEN payment_case = 0 THEN array()
     ELSE array(named_struct('payments',
       array(named_struct('installments', installments, 'value', pay_cents)))) END),
  'marketingData', named_struct('coupon', coupon, 'couponCode', coupon_code),
  'totals', CASE WHEN totals_case = 0 THEN array(named_struct('id', 'Items', 'value', pay_cents))
     ELSE array(named_struct('id', 'Items', 'value', pay_cents),
                named_struct('id', 'Discounts', 'value', discount_cents)) END,
  'items', slice(array(
     named_struct('name', item1, 'productCategories', map('10', cat_a, '20', cat_b)),
     named_struct('name', item2, 'productCategories', map('10', cat_a, '30', cat_c)),
     named_struct('name', item3, 'productCategories', map('20', cat_b, '40', cat_d))),
     1, CAST(n_items AS INT))
)) AS detail
"""


def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order documents as JSON text, built row by row."""
    tables(spark, sf_dir, "orders", "customer", "nation", "region")
    return spark.sql(_DOCUMENT_ROWS_SPARK).selectExpr("order_id", _DOCUMENT_JSON)


_ORDER_LIST_JSON = """
to_json(named_struct(
  'orderId', concat(CAST(o_orderkey AS STRING), '-01'),
  'sequence', CAST(o_orderkey + 500000 AS STRING),
  'clientName', c_name,
  'hostname', concat('host', CAST(o_orderkey % 5 AS STRING)),
  'origin', 'Marketplace',
  'salesChannel', CAST(o_orderkey % 3 AS STRING),
  'status', o_orderstatus,
  'statusDescription', concat('status ', o_orderstatus),
  'isAllDelivered', o_orderstatus = 'F',
  'isAnyDelivered', o_orderstatus <> 'O',
  'workflowInErrorState', o_orderkey % 50 = 0,
  'totalValue', CASE WHEN o_orderkey % 29 <> 0
      THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END,
  'totalItems', o_orderkey % 6,
  'paymentNames', c_mktsegment,
  'creationDate', date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
  'lastChange', date_format(o_orderdate, "yyyy-MM-dd'T'03:04:05'+02:00'"),
  'authorizedDate', CASE WHEN o_orderkey % 10 = 0 THEN 'pending' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END
)) AS order_json
"""


def order_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed orders as JSON text."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.selectExpr(_ORDER_LIST_JSON)


def order_attributes(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    """The wanted attributes (all by default) of the documents that disputes may ask for."""
    documents = enrich.wanted_documents(order_details(spark, sf_dir), disputes(spark, sf_dir))
    flat = enrich.order_attributes(enrich.flatten_detail(documents))
    return flat.select("order_id", *(attributes or C.ENRICHMENT_COLUMNS))


def reconciled(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    keys = disputes(spark, sf_dir)  # without the joins the attributes need
    rows = disputes(spark, sf_dir, *attributes) if attributes else keys
    return match.reconcile(rows, ledger(spark, sf_dir), antifraud(spark, sf_dir), keys=keys)


def with_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_ledger(disputes(spark, sf_dir), ledger(spark, sf_dir))


def with_antifraud(spark: SparkSession, sf_dir: str,
                   profile: match.DisputeProfile | None = None) -> DataFrame:
    return match.match_antifraud(disputes(spark, sf_dir), antifraud(spark, sf_dir),
                                 profile=profile.order if profile else None)


def with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.flag_noc_conversion(disputes(spark, sf_dir))


def with_orders(spark: SparkSession, sf_dir: str, *attributes: str,
                rows: DataFrame | None = None,
                profile: match.DisputeProfile | None = None) -> DataFrame:
    """Disputes with the wanted attributes (all by default) of their orders."""
    return enrich.attach_documents(
        disputes(spark, sf_dir) if rows is None else rows,
        order_attributes(spark, sf_dir, *attributes), ("dispute_id",),
        profile=profile.base_order if profile else None,
    ).drop("matched_id")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputes with both sources of a location."""
    profile = match.profile_disputes(disputes(spark, sf_dir), "order", "base_order")
    rows = with_antifraud(spark, sf_dir, profile)
    return with_orders(spark, sf_dir, "vtex_uf", "vtex_cidade", rows=rows, profile=profile)


def consolidated(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    """Everything joined: the frame all reports can be served from."""
    keys = disputes(spark, sf_dir)
    rows = disputes(spark, sf_dir, *attributes) if attributes else keys
    return consolidation.consolidate(rows, ledger(spark, sf_dir), antifraud(spark, sf_dir),
                                order_attributes(spark, sf_dir), keys=keys)


REPORT_ATTRIBUTES = ("dispute_reason", "payment_method", "shopper_email")
#: what the stored frame holds: every column that a report reads; the extracts have all of them
SERVED = (
    "dispute_id", "psp_reference", "record_type", "dispute_amount", "record_date", "shopper_interaction",
    *REPORT_ATTRIBUTES, "vtex_order_id", "valor_sap", "psp_reference_sap", "virou_chargeback",
    "cs_status_do_chargeback", "cs_cidade", "cs_uf", "cs_item_principal", match.FOUND,
    "vtex_store", "vtex_cidade", "vtex_uf", "vtex_delivery_type", "vtex_categories", "fonte",
)
#: bytes of feeds below which the months of the store are gathered by a shuffle
SMALL_FEEDS = 64 << 20
FEEDS = ("lineitem", "orders", "customer", "nation", "region", "part")
_STORES: dict[tuple, DataFrame] = {}


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated frame as reports are served from it: stored once a session, by month.

    Columns that no report reads are left out, so the joins behind the store need not carry them.
    The first report of a session joins the feeds and stores the frame, the others read
    it; it is stored anew when a file of a feed has changed.  A session without a
    shared folder joins them for every report.
    """
    if not has_shared_dir(spark):
        return consolidated(spark, sf_dir, *REPORT_ATTRIBUTES)
    files = (spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in FEEDS])
             .agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.sum("length")).first())
    key = (spark.sparkContext.applicationId, sf_dir, *files)
    if key not in _STORES:
        path = f"{shared_dir(spark)}/tallyweave/store-{uuid.uuid4().hex}"
        schema = store.write_store(consolidated(spark, sf_dir, *REPORT_ATTRIBUTES).select(*SERVED), path,
                                   gather=files[-1] < SMALL_FEEDS)
        _STORES[key] = store.open_store(spark, path, schema)  # its folders are listed once
    return _STORES[key]
