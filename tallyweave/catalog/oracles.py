"""SQL counterparts of the registered queries.

Each query is a body on top of the named views it needs.  Money is summed as
DECIMAL and rounded with integer arithmetic on cents, which is exact.

Fixed values: the names of results and sections, the labels and the keywords in the
SQL are those of the reports, as they have to appear.
"""

from __future__ import annotations

from tallyweave.catalog.fixtures import DOCUMENT_ROWS_SQL

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "disputes_all": ((), """
SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-',
         CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR), '-',
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS dispute_id,
       CASE WHEN l_orderkey % 53 <> 0 THEN lpad(CASE WHEN l_orderkey % 11 = 0 THEN '11'
            ELSE CAST(l_orderkey AS VARCHAR) END, 16, '0') END AS psp_reference,
       CASE l_returnflag WHEN 'R' THEN 'Chargeback' WHEN 'A' THEN 'NotificationOfChargeback'
            ELSE 'Settled' END AS record_type,
       CASE WHEN (l_orderkey + l_linenumber) % 61 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS dispute_amount,
       l_shipdate AS record_date, p_type AS dispute_reason,
       CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 31 = 0 THEN 'nan' ELSE lower(c_mktsegment) END AS payment_method,
       CASE WHEN l_orderkey % 67 = 0 THEN 'nan' WHEN l_orderkey % 71 = 0 THEN '' ELSE l_linestatus END AS shopper_interaction,
       c_name AS shopper_email,
       CASE WHEN l_linenumber = 7 THEN '{bad' WHEN l_linenumber = 6 THEN '{}'
            ELSE concat('{"orderId":"', CAST(l_orderkey AS VARCHAR), '"}') END AS metadata
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""),
    "disputes": (("disputes_all",), """
SELECT *, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.orderId') END
            AS vtex_order_id
FROM disputes_all WHERE record_type IN ('Chargeback', 'NotificationOfChargeback')"""),
    "ledger_all": ((), """
SELECT o_orderkey * 2 AS ordinal,
       CASE o_orderstatus
         WHEN 'F' THEN concat('Chargeback NSU: ', lpad(CAST(o_orderkey AS VARCHAR), 16, '0'), '-', CAST(o_custkey AS VARCHAR))
         WHEN 'P' THEN 'CHARGEBACK SEM REFERENCIA'
         ELSE concat('PAGAMENTO NSU: ', lpad(CAST(o_orderkey AS VARCHAR), 16, '0')) END AS denominacao_sap,
       o_orderdate AS data_lancamento_sap,
       CASE WHEN o_orderkey % 17 = 0 THEN 'n/d'
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS valor_sap
FROM orders
UNION ALL
SELECT o_orderkey * 2 + 1, concat('CHARGEBACK NSU ', lpad(CAST(o_orderkey AS VARCHAR), 16, '0')),
       o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus = 'F'"""),
    "ledger": (("ledger_all",), r"""
SELECT *, nullif(regexp_extract(denominacao_sap, 'NSU[^\w]*([A-Za-z0-9]{16})', 1), '') AS psp_reference_sap,
       nullif(regexp_extract(denominacao_sap, '[A-Za-z0-9]{16}[^\w]*([A-Za-z0-9]+)$', 1), '') AS nsu,
       'CHARGEBACK' AS tipo
FROM ledger_all WHERE contains(upper(denominacao_sap), 'CHARGEBACK')"""),
    "ledger_first": (("ledger",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY psp_reference_sap ORDER BY ordinal) AS rn FROM ledger
) WHERE rn = 1"""),
    "antifraud_all": ((), """
SELECT o_orderkey * 2 AS ordinal,
       concat(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '' ELSE 'N' END,
              CAST(o_orderkey AS VARCHAR), '-', CAST(o_custkey AS VARCHAR)) AS pedido,
       o_orderpriority AS status_do_chargeback, n_name AS uf,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('CITY_', CAST(c_custkey % 50 AS VARCHAR)) END AS cidade,
       c_mktsegment AS item_principal, c_acctbal AS score
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT o_orderkey * 2 + 1, concat(CAST(o_orderkey AS VARCHAR), '-X'), '9-REVISED', n_name, NULL,
       c_mktsegment, c_acctbal
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0"""),
    "antifraud": (("antifraud_all",), """
SELECT vtex_order_id, pedido AS cs_pedido, status_do_chargeback AS cs_status_do_chargeback,
       uf AS cs_uf, cidade AS cs_cidade, item_principal AS cs_item_principal, score AS cs_score
FROM (SELECT *, row_number() OVER (PARTITION BY vtex_order_id ORDER BY ordinal DESC) AS rn
      FROM (SELECT *, trim(split_part(pedido, '-', 1)) AS vtex_order_id FROM antifraud_all))
WHERE rn = 1"""),
    "flagged": (("disputes",), """
SELECT d.*, CASE WHEN record_type = 'Chargeback' THEN 'É Chargeback'
       WHEN record_type = 'NotificationOfChargeback' THEN
         CASE WHEN psp_reference IN (SELECT psp_reference FROM disputes WHERE record_type = 'Chargeback')
              THEN 'Sim' ELSE 'Não' END
       ELSE 'N/A' END AS virou_chargeback
FROM disputes d"""),
    "reconciled": (("flagged", "ledger_first", "antifraud"), """
SELECT f.*, l.psp_reference_sap, l.denominacao_sap, l.data_lancamento_sap, l.valor_sap, l.nsu,
       a.cs_pedido, a.cs_status_do_chargeback, a.cs_uf, a.cs_cidade, a.cs_item_principal, a.cs_score,
       concat('Adyen', CASE WHEN l.psp_reference_sap IS NOT NULL THEN ' + SAP' ELSE '' END,
              CASE WHEN a.cs_pedido IS NOT NULL THEN ' + ClearSale' ELSE '' END) AS fonte
FROM flagged f LEFT JOIN ledger_first l ON f.psp_reference = l.psp_reference_sap
LEFT JOIN antifraud a ON trim(f.vtex_order_id) = a.vtex_order_id"""),
    "document_rows": ((), DOCUMENT_ROWS_SQL),
    "flat": (("document_rows",), """
SELECT order_id, state AS uf, city AS cidade, postal_code AS cep, address_type,
  CASE WHEN logistics_case <> 0 THEN sla END AS sla_type,
  CASE WHEN logistics_case <> 0 THEN estimate END AS delivery_deadline,
  CASE WHEN package_case <> 7 THEN invoice_key END AS invoice_key,
  CASE WHEN package_case <> 7 THEN invoice_number END AS invoice_number,
  CASE WHEN seller_case IN (0, 1) THEN hostname
       ELSE trim(split_part(seller_name, ' - ', 1)) END AS vtex_store,
  CASE WHEN payment_case <> 0 THEN installments END AS vtex_installments,
  CASE WHEN payment_case <> 0 AND installments > 0
       THEN ((2 * pay_cents + installments) // (2 * installments)) / 100.0::DOUBLE END AS vtex_installment_value,
  coalesce(nullif(coupon, ''), nullif(coupon_code, '')) AS vtex_coupon,
  CASE WHEN totals_case <> 0 AND discount_cents <> 0
       THEN abs(discount_cents) / 100.0::DOUBLE END AS vtex_discount_value,
  nullif(concat_ws(' | ', CASE WHEN n_items >= 1 THEN item1 END, CASE WHEN n_items >= 2 THEN item2 END,
                   CASE WHEN n_items >= 3 THEN item3 END), '') AS vtex_products,
  nullif(array_to_string(list_sort(list_distinct([
    CASE WHEN n_items >= 1 THEN cat_a END, CASE WHEN n_items >= 1 THEN cat_b END,
    CASE WHEN n_items >= 2 THEN cat_c END, CASE WHEN n_items >= 3 THEN cat_d END])), ' | '), '')
    AS vtex_categories
FROM document_rows"""),
    "attributes": (("flat",), """
SELECT order_id, vtex_store, vtex_installments, vtex_installment_value, vtex_coupon, vtex_discount_value,
  invoice_number AS vtex_invoice_number, invoice_key AS vtex_invoice_key, cidade AS vtex_cidade,
  uf AS vtex_uf, trim(concat(coalesce(sla_type, ''), ' (', coalesce(address_type, ''), ')'), ' ()')
    AS vtex_delivery_type,
  vtex_products, vtex_categories
FROM flat"""),
    "enrichment": (("disputes", "attributes"), """
SELECT i.order_id AS wanted, a.* FROM (
  SELECT DISTINCT trim(vtex_order_id) AS order_id FROM disputes
  WHERE trim(vtex_order_id) <> '') i
LEFT JOIN attributes a ON a.order_id = coalesce(
  (SELECT max(x.order_id) FROM attributes x WHERE x.order_id = concat(i.order_id, '-01')),
  (SELECT max(x.order_id) FROM attributes x WHERE x.order_id = i.order_id),
  (SELECT max(x.order_id) FROM attributes x WHERE x.order_id = concat(i.order_id, '-02')))"""),
    "consolidated": (("reconciled", "enrichment"), """
SELECT r.*, e.* EXCLUDE (wanted, order_id)
FROM reconciled r LEFT JOIN enrichment e ON trim(r.vtex_order_id) = e.wanted"""),
}

_ATTRIBUTES = """vtex_store, vtex_installments, vtex_installment_value, vtex_coupon,
vtex_discount_value, vtex_invoice_number, vtex_invoice_key, vtex_cidade, vtex_uf,
vtex_delivery_type, vtex_products, vtex_categories"""


def _with(views: str, body: str) -> str:
    """``body`` behind the named views and all views they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _VIEWS[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        need(name)
    if not ordered:
        return body.strip()
    clauses = ",\n".join(f"{n} AS ({_VIEWS[n][1].strip()})" for n in ordered)
    return f"WITH {clauses}\n{body.strip()}"


def _counts(views: str, label: str, source: str, k: int | None = None) -> str:
    body = (f"SELECT {label} AS label, count(*) AS n FROM {source} "
            f"WHERE {label} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label")
    return _with(views, body + (f" LIMIT {k}" if k else ""))


def _sum(amount: str, when: str = "TRUE") -> str:
    return f"CAST(coalesce(sum({amount}) FILTER (WHERE {when}), 0) AS DOUBLE)"


def _mean(when: str) -> str:
    """Mean amount rounded half up to cents."""
    cents = f"CAST(sum(dispute_amount) FILTER (WHERE {when}) * 100 AS HUGEINT)"
    n = f"count(dispute_amount) FILTER (WHERE {when})"
    return (f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE "
            f"CAST((2 * {cents} + {n}) // (2 * {n}) AS DOUBLE) / 100.0::DOUBLE END")


def _pct(part: str, whole: str) -> str:
    return (f"CAST((2000 * ({part}) + greatest({whole}, 1)) // (2 * greatest({whole}, 1)) AS DOUBLE)"
            " / 10.0::DOUBLE")


_CB, _NOC = "record_type = 'Chargeback'", "record_type = 'NotificationOfChargeback'"
_N_CB, _N_NOC = f"count(*) FILTER (WHERE {_CB})", f"count(*) FILTER (WHERE {_NOC})"
_N_CONV = "count(*) FILTER (WHERE virou_chargeback = 'Sim')"
_N_LEDGER = "count(psp_reference_sap)"
_N_ANTIFRAUD = "count(cs_pedido)"

_KPI_COUNTS = f"""{_N_CB} AS total_chargebacks, {_N_NOC} AS total_notifications,
  {_sum('dispute_amount', _CB)} AS valor_total_cb, {_sum('dispute_amount', _NOC)} AS valor_total_noc,
  {_N_CONV} AS noc_que_viraram_cb, {_N_NOC} AS noc_total,
  {_pct(_N_CONV, _N_NOC)} AS taxa_conversao_noc_cb, {_N_LEDGER} AS com_sap"""

_MONTHLY = f"""SELECT strftime(record_date, '%Y-%m') AS month,
  count(dispute_amount) FILTER (WHERE {_CB}) AS cb_count, {_sum('dispute_amount', _CB)} AS cb_total,
  count(dispute_amount) FILTER (WHERE {_NOC}) AS noc_count, {_sum('dispute_amount', _NOC)} AS noc_total
FROM disputes WHERE record_date IS NOT NULL {{extra}} GROUP BY 1 ORDER BY 1"""

# the month range used by the dashboard queries
DASH_START, DASH_END = "1998-03", "2000-11"
_RANGE = ("record_date >= TIMESTAMP '1998-03-01' AND record_date < TIMESTAMP '2000-12-01'")

_DELIVERY = """CASE
  WHEN regexp_matches(lower(vtex_delivery_type), 'retirada|retire|retira|pickup|retirar') THEN 'Clique e Retire'
  WHEN regexp_matches(lower(vtex_delivery_type), 'entrega|delivery|normal|expressa|sedex|pac|correios|economic') THEN 'Entrega em Casa'
  WHEN trim(vtex_delivery_type) = '' OR lower(vtex_delivery_type) = 'nan' THEN NULL
  ELSE vtex_delivery_type END"""
_DASH_DELIVERY = """CASE WHEN vtex_delivery_type IS NULL OR vtex_delivery_type IN ('', 'nan') THEN NULL
  WHEN regexp_matches(lower(vtex_delivery_type), 'retira|pickup') THEN 'Clique e Retire'
  WHEN regexp_matches(lower(vtex_delivery_type), 'entrega|normal|express') THEN 'Entrega em Casa'
  ELSE 'Outros' END"""


def _cross(antifraud: str) -> str:
    return f"""count(*) AS total_adyen_cb_noc, {_N_LEDGER} AS encontrados_no_sap,
  count(*) - {_N_LEDGER} AS nao_encontrados_sap, {_pct(_N_LEDGER, 'count(*)')} AS taxa_match_sap,
  {antifraud} AS encontrados_no_clearsale, count(*) - {antifraud} AS nao_encontrados_clearsale,
  {_pct(antifraud, 'count(*)')} AS taxa_match_clearsale"""


def _dash_counts(views: str, label: str, k: int | None = None) -> str:
    source = views.split()[-1]
    body = (f"SELECT {label} AS label, count(*) AS n FROM {source} WHERE {_RANGE} "
            f"AND ({label}) IS NOT NULL AND ({label}) NOT IN ('', 'nan') "
            "GROUP BY 1 ORDER BY n DESC, label")
    return _with(views, body + (f" LIMIT {k}" if k else ""))


def _categories(where: str, k: int) -> str:
    return _with("consolidated", f"""
SELECT label, count(*) AS n FROM (
  SELECT trim(unnest(string_split(vtex_categories, '|'))) AS label FROM consolidated WHERE {where})
WHERE label <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT {k}""")


_EXPORT = """dispute_id, psp_reference, record_type, dispute_amount, dispute_reason, payment_method,
record_date, virou_chargeback, fonte, vtex_order_id, vtex_store, vtex_cidade, vtex_uf,
vtex_delivery_type, vtex_categories, cs_item_principal, psp_reference_sap, cs_status_do_chargeback"""

_OUTER_V2 = """CASE WHEN (SELECT count(*) FROM disputes WHERE record_type = 'Chargeback') = 0 THEN 'Não'
       WHEN record_type = 'Chargeback' THEN 'Sim'
       WHEN psp_reference IN (SELECT psp_reference FROM disputes WHERE record_type = 'Chargeback')
       THEN 'Sim' ELSE 'Não' END"""

_OUTER = """SELECT d.dispute_id, coalesce(d.psp_reference, l.psp_reference_sap) AS psp_reference,
  coalesce(d.record_type, 'SAP Only') AS record_type, d.dispute_amount, d.vtex_order_id,
  l.ordinal, l.psp_reference_sap, l.nsu, l.valor_sap
FROM disputes d FULL OUTER JOIN ledger l ON d.psp_reference = l.psp_reference_sap"""


#: Columns of the disputes with their types, in the order the column profile lists them.
_DISPUTE_TYPES = {
    "dispute_id": "string", "psp_reference": "string", "record_type": "string",
    "dispute_amount": "decimal(18,2)", "record_date": "timestamp_ntz", "shopper_interaction": "string",
    "metadata": "string", "dispute_reason": "string", "payment_method": "string",
    "shopper_email": "string", "vtex_order_id": "string",
}


def _profile() -> str:
    return _with("disputes", "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type,
  coalesce(list(CAST({c} AS VARCHAR) ORDER BY dispute_id) FILTER (WHERE {c} IS NOT NULL), []) AS sample
FROM (SELECT * FROM disputes ORDER BY dispute_id LIMIT 5)"""
        for i, (c, t) in enumerate(_DISPUTE_TYPES.items())) + ")")


def _scans_and_normalisation() -> dict[str, str]:
    return {
        "sample_scan": _with("disputes_all", """SELECT dispute_id, psp_reference, record_type, dispute_amount,
  record_date, shopper_interaction, metadata FROM disputes_all ORDER BY dispute_id LIMIT 5"""),
        "preview": _with("disputes enrichment", f"""SELECT psp_reference, record_type, vtex_order_id, {_ATTRIBUTES}
FROM disputes d LEFT JOIN enrichment e ON trim(d.vtex_order_id) = e.wanted ORDER BY dispute_id LIMIT 15"""),
        "profile_columns": _profile(),
        "union_by_name": """SELECT o_orderkey AS key, o_orderdate AS placed, o_custkey AS customer,
  CAST(NULL AS VARCHAR) AS segment FROM orders
UNION ALL SELECT c_custkey, NULL, NULL, c_mktsegment FROM customer""",
        "filter_record_types": _with("disputes_all", """SELECT dispute_id, record_type, dispute_amount
FROM disputes_all WHERE record_type IN ('Chargeback', 'NotificationOfChargeback')"""),
        "extract_order_id": _with("disputes_all", """SELECT dispute_id,
  CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.orderId') END AS vtex_order_id
FROM disputes_all"""),
        "normalize_mixed_dates": """SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS record_date,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderdate + INTERVAL 13 HOUR + INTERVAL 5 MINUTE END AS payment_date
FROM orders""",
        "filter_narrative": _with("ledger_all", """SELECT ordinal, denominacao_sap FROM ledger_all
WHERE contains(upper(denominacao_sap), 'CHARGEBACK')"""),
        "extract_psp": _with("ledger", "SELECT ordinal, denominacao_sap, psp_reference_sap FROM ledger"),
        "extract_nsu": _with("ledger", "SELECT ordinal, denominacao_sap, nsu FROM ledger"),
        "order_key_prefix": _with("antifraud_all", """SELECT ordinal, pedido,
  trim(split_part(pedido, '-', 1)) AS vtex_order_id FROM antifraud_all"""),
        "prefix_columns": _with("antifraud_all", """SELECT ordinal, pedido AS cs_pedido,
  status_do_chargeback AS cs_status_do_chargeback, uf AS cs_uf, cidade AS cs_cidade,
  item_principal AS cs_item_principal, score AS cs_score FROM antifraud_all"""),
        "dense_ids": _with("ledger", """SELECT ordinal, psp_reference_sap,
  row_number() OVER (ORDER BY ordinal) AS sap_id FROM ledger"""),
        "dense_ids_disputes": _with("disputes", """SELECT dispute_id,
  row_number() OVER (ORDER BY dispute_id) AS adyen_id FROM disputes"""),
        "rename_select": _with("disputes", """SELECT dispute_id, psp_reference AS "Psp Reference",
  record_type AS "type", dispute_amount AS amount, record_date AS "date", vtex_order_id FROM disputes"""),
        "try_numeric": _with("ledger", """SELECT ordinal, TRY_CAST(valor_sap AS DOUBLE) AS valor_sap
FROM ledger"""),
        "parse_utc": """SELECT event_id,
  CASE WHEN event_id % 31 <> 0 THEN ts END AS creation_date,
  CASE WHEN event_id % 37 <> 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS last_change,
  CAST(NULL AS TIMESTAMP) AS authorized_date
FROM events""",
        "cents_to_amount": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END AS DOUBLE) / 100.0::DOUBLE AS total_value
FROM orders""",
        "valid_order_ids": _with("disputes", """SELECT DISTINCT trim(vtex_order_id) AS order_id
FROM disputes WHERE trim(vtex_order_id) <> ''"""),
        "classify_delivery": _with("attributes", f"""SELECT order_id, vtex_delivery_type,
  {_DELIVERY} AS delivery FROM attributes"""),
        "classify_delivery_dash": _with("attributes", f"""SELECT order_id, vtex_delivery_type,
  {_DASH_DELIVERY} AS delivery FROM attributes"""),
        "truncate_label": "SELECT doc_id, substr(text, 1, 60) AS label FROM documents",
        "month_range_filter": _with("disputes", f"""SELECT dispute_id, record_date, dispute_amount
FROM disputes WHERE {_RANGE}"""),
        "coalesce_location": _with("consolidated", """SELECT dispute_id, coalesce(vtex_uf, cs_uf) AS uf_combined,
  coalesce(vtex_cidade, cs_cidade) AS cidade_combined FROM consolidated"""),
        "upper_method": _with("disputes", """SELECT dispute_id, upper(nullif(nullif(payment_method, ''), 'nan')) AS pm FROM disputes"""),
        "month_label": _with("disputes", """SELECT DISTINCT strftime(record_date, '%Y-%m') AS month,
  concat(['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'][CAST(month(record_date) AS INT)],
         '/', strftime(record_date, '%y')) AS label FROM disputes"""),
        "move_to_front": _with("flagged", """SELECT virou_chargeback, record_type, dispute_id, psp_reference
FROM flagged"""),
    }


def _matching() -> dict[str, str]:
    return {
        "dedup_first": _with("ledger_first", """SELECT ordinal, psp_reference_sap, denominacao_sap,
  valor_sap FROM ledger_first"""),
        "dedup_last": _with("antifraud", """SELECT vtex_order_id, cs_pedido,
  cs_status_do_chargeback, cs_score FROM antifraud"""),
        "dedup_by_key": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber,
    l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
        "match_ledger": _with("disputes ledger_first", """SELECT d.dispute_id, d.psp_reference,
  l.psp_reference_sap, l.denominacao_sap, l.data_lancamento_sap, l.valor_sap
FROM disputes d LEFT JOIN ledger_first l ON d.psp_reference = l.psp_reference_sap"""),
        "match_ledger_outer": _with("disputes ledger", _OUTER),
        "match_antifraud": _with("disputes antifraud", """SELECT d.dispute_id, d.vtex_order_id,
  a.cs_pedido, a.cs_status_do_chargeback, a.cs_uf, a.cs_cidade, a.cs_item_principal, a.cs_score
FROM disputes d LEFT JOIN antifraud a ON trim(d.vtex_order_id) = a.vtex_order_id"""),
        "flag_noc_conversion": _with("flagged", """SELECT dispute_id, record_type, virou_chargeback
FROM flagged"""),
        "flag_noc_conversion_v2": _with("disputes", f"""SELECT dispute_id, record_type,
  {_OUTER_V2} AS virou_chargeback FROM disputes"""),
        "label_provenance": _with("reconciled", "SELECT dispute_id, fonte FROM reconciled"),
        "match_rates": _with("reconciled", f"""SELECT count(*) AS total,
  {_N_LEDGER} AS ledger_matched, {_pct(_N_LEDGER, 'count(*)')} AS ledger_pct,
  count(vtex_order_id) AS order_id_matched, {_pct('count(vtex_order_id)', 'count(*)')} AS order_id_pct,
  {_N_ANTIFRAUD} AS antifraud_matched, {_pct(_N_ANTIFRAUD, 'count(*)')} AS antifraud_pct
FROM reconciled"""),
        "missing_orders": _with("disputes", """SELECT DISTINCT vtex_order_id AS order_id FROM disputes
WHERE vtex_order_id <> '' AND NOT (CAST(vtex_order_id AS BIGINT) % 3 = 0 AND CAST(vtex_order_id AS BIGINT) % 9 <> 0)"""),
        "resolve_candidates": _with("document_rows", """
SELECT wanted AS order_id, matched_id, d.hostname, d.city FROM (
  SELECT wanted, CASE WHEN contains(wanted, '-') THEN
      (SELECT max(order_id) FROM document_rows x WHERE x.order_id = wanted)
    ELSE coalesce(
      (SELECT max(order_id) FROM document_rows x WHERE x.order_id = concat(wanted, '-01')),
      (SELECT max(order_id) FROM document_rows x WHERE x.order_id = wanted),
      (SELECT max(order_id) FROM document_rows x WHERE x.order_id = concat(wanted, '-02'))) END AS matched_id
  FROM (SELECT concat(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 10 = 2 THEN '-02' ELSE '' END)
          AS wanted FROM orders))
LEFT JOIN document_rows d ON d.order_id = matched_id"""),
        "upsert_cache": """SELECT order_id, arg_max(vtex_store, row(placed, side)) AS vtex_store,
  arg_max(status, row(placed, side)) AS status FROM (
  SELECT concat(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'A' END, CAST(o_orderkey AS VARCHAR)) AS order_id,
         concat('old ', o_orderstatus) AS vtex_store, 'found' AS status, o_orderdate AS placed, 0 AS side FROM orders
  UNION ALL
  SELECT concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'B' END, CAST(o_orderkey AS VARCHAR)),
         concat('new ', o_orderstatus), 'not_found',
         o_orderdate - CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, 1 FROM orders)
GROUP BY order_id""",
        "attach_enrichment": _with("consolidated", f"SELECT dispute_id, vtex_order_id, {_ATTRIBUTES} FROM consolidated"),
        "attach_documents": _with("consolidated", f"SELECT dispute_id, vtex_order_id, {_ATTRIBUTES} FROM consolidated"),
        "record_type_set": _with("disputes_all", "SELECT DISTINCT record_type FROM disputes_all"),
        "reconcile": _with("reconciled", """SELECT dispute_id, psp_reference, record_type, dispute_amount,
  record_date, vtex_order_id, psp_reference_sap, data_lancamento_sap, valor_sap, cs_pedido,
  cs_status_do_chargeback, cs_item_principal, virou_chargeback, fonte FROM reconciled"""),
    }


def _orders() -> dict[str, str]:
    flat = {
        "order_address": "uf, cidade, cep, address_type",
        "order_logistics": "sla_type, delivery_deadline",
        "order_invoice": "invoice_key, invoice_number",
        "order_store": "vtex_store",
        "order_installments": "vtex_installments, vtex_installment_value",
        "order_coupon": "vtex_coupon",
        "order_discount": "vtex_discount_value",
        "order_products": "vtex_products",
        "order_categories": "vtex_categories",
    }
    out = {name: _with("flat", f"SELECT order_id, {cols} FROM flat") for name, cols in flat.items()}
    out["delivery_type"] = _with("attributes", "SELECT order_id, vtex_delivery_type FROM attributes")
    out["flatten_detail"] = _with("flat", "SELECT order_id, " + ", ".join(flat.values()) + " FROM flat")
    out["flatten_order"] = """SELECT concat(CAST(o_orderkey AS VARCHAR), '-01') AS order_id,
  CAST(o_orderkey + 500000 AS VARCHAR) AS sequence, c_name AS client_name,
  concat('host', CAST(o_orderkey % 5 AS VARCHAR)) AS hostname, 'Marketplace' AS origin,
  CAST(o_orderkey % 3 AS VARCHAR) AS sales_channel, o_orderstatus AS status,
  concat('status ', o_orderstatus) AS status_description, o_orderstatus = 'F' AS is_all_delivered,
  o_orderstatus <> 'O' AS is_any_delivered, o_orderkey % 50 = 0 AS workflow_error,
  CASE WHEN o_orderkey % 29 = 0 THEN 0.0::DOUBLE ELSE
    CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS DOUBLE) / 100.0::DOUBLE END AS total_value,
  o_orderkey % 6 AS total_items, c_mktsegment AS payment_name,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS creation_date,
  strftime(o_orderdate, '%Y-%m-%dT03:04:05+02:00') AS last_change,
  CASE WHEN o_orderkey % 10 = 0 THEN 'pending' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS authorized_date,
  CAST(NULL AS VARCHAR) AS payment_approved_date, CAST(NULL AS VARCHAR) AS ready_for_handling_date,
  CAST(NULL AS VARCHAR) AS shipping_estimated_date, CAST(NULL AS VARCHAR) AS shipping_estimated_date_min,
  CAST(NULL AS VARCHAR) AS shipping_estimated_date_max
FROM orders JOIN customer ON o_custkey = c_custkey"""
    out["scan_orders_json"] = """SELECT concat(CAST(o_orderkey AS VARCHAR), '-01') AS order_id,
  o_orderkey + 500000 AS sequence, c_name AS client_name,
  CASE WHEN o_orderkey % 29 = 0 THEN 0.0::DOUBLE ELSE
    CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS DOUBLE) / 100.0::DOUBLE END AS total_value,
  o_orderdate AS creation_date,
  date_trunc('day', o_orderdate) + INTERVAL 1 HOUR + INTERVAL 4 MINUTE + INTERVAL 5 SECOND AS last_change,
  CASE WHEN o_orderkey % 10 <> 0 THEN date_trunc('day', o_orderdate) END AS authorized_date
FROM orders JOIN customer ON o_custkey = c_custkey"""
    first = "first({c} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (WHERE {c} IS NOT NULL)"
    out["collapse_orders"] = f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
  {first.format(c='sla_type')} AS sla_type, {first.format(c='uf')} AS uf,
  {first.format(c='tracking_number')} AS tracking_number, {first.format(c='sequence')} AS sequence
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN concat('SLA ', l_returnflag) END AS sla_type,
        CASE WHEN l_linenumber > 2 THEN l_linestatus END AS uf,
        CASE WHEN l_partkey % 3 = 0 THEN concat('TR', CAST(l_suppkey AS VARCHAR)) END AS tracking_number,
        l_partkey AS sequence FROM lineitem)
GROUP BY l_orderkey"""
    out["window_plan"] = """SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end FROM (
  SELECT unnest(generate_series(date_trunc('day', min(ts)),
    date_trunc('day', max(ts)) + INTERVAL 22 HOUR, INTERVAL 2 HOUR)) AS s FROM events)"""
    out["window_volume"] = """SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 2 HOUR AS window_end,
  count(*) AS n_rows, count(*) > 35 AS over_cap FROM events GROUP BY 1"""
    out["capped_extract"] = """SELECT event_id, ts, user_id, event_type, window_start FROM (
  SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY ts, event_id) AS rn FROM (
    SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM events))
WHERE rn <= 35"""
    return out


def _breakdowns() -> dict[str, str]:
    return {
        "kpis": _with("reconciled", f"""SELECT {_KPI_COUNTS},
  {_mean(_CB)} AS ticket_medio_cb, {_mean(_NOC)} AS ticket_medio_noc,
  {_N_ANTIFRAUD} AS com_clearsale FROM reconciled"""),
        "monthly_evolution": _with("disputes", _MONTHLY.format(extra="")),
        "ledger_monthly": _with("reconciled", f"""SELECT strftime(record_date, '%Y-%m') AS month,
  count(TRY_CAST(valor_sap AS DECIMAL(18,2))) AS n,
  {_sum('TRY_CAST(valor_sap AS DECIMAL(18,2))')} AS total
FROM reconciled WHERE psp_reference_sap IS NOT NULL GROUP BY 1 ORDER BY 1"""),
        "by_source": _counts("reconciled", "fonte", "reconciled"),
        "by_reason": _counts("disputes", "dispute_reason", "disputes", 10),
        "by_reason_profile": _counts("disputes", "dispute_reason", "disputes", 15),
        "by_payment_method": _counts("disputes", "payment_method", "disputes"),
        "by_interaction": _counts("disputes", "shopper_interaction", "disputes"),
        "by_antifraud_status": _counts("reconciled", "cs_status_do_chargeback", "reconciled"),
        "by_state": _with("consolidated", f"""SELECT coalesce(vtex_uf, cs_uf) AS label,
  count(dispute_amount) AS n, {_sum('dispute_amount')} AS total
FROM consolidated WHERE coalesce(vtex_uf, cs_uf) IS NOT NULL GROUP BY 1 ORDER BY n DESC, label"""),
        "by_city": _with("consolidated", f"""SELECT coalesce(vtex_cidade, cs_cidade) AS label,
  count(dispute_amount) AS n, {_sum('dispute_amount')} AS total
FROM consolidated WHERE coalesce(vtex_cidade, cs_cidade) IS NOT NULL
GROUP BY 1 ORDER BY n DESC, label LIMIT 20"""),
        "by_delivery": _with("consolidated", f"""SELECT label, count(*) AS n FROM (
  SELECT {_DELIVERY} AS label FROM consolidated) WHERE label IS NOT NULL
GROUP BY 1 ORDER BY n DESC, label"""),
        "by_delivery_detail": _counts("consolidated", "vtex_delivery_type", "consolidated", 15),
        "by_category": _categories("TRUE", 20),
        "by_category_documents": """SELECT label, count(*) AS n FROM (
  SELECT trim(unnest(string_split(text, '|')), ' ') AS label FROM documents)
WHERE label <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT 20""",
        "by_item": _with("reconciled", """SELECT substr(label, 1, 60) AS label, n FROM (
  SELECT cs_item_principal AS label, count(*) AS n FROM reconciled
  WHERE cs_item_principal IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 20)"""),
        "by_store": _counts("consolidated", "vtex_store", "consolidated", 30),
        "cross_validation": _with("reconciled", f"SELECT {_cross(_N_ANTIFRAUD)} FROM reconciled"),
        "top_emails": _counts("disputes", "shopper_email", "disputes", 15),
        "by_conversion": _counts("flagged", "virou_chargeback", "flagged"),
        "by_record_type": _counts("disputes", "record_type", "disputes"),
        "by_record_type_all": _counts("disputes_all", "record_type", "disputes_all"),
        "top_records": _with("consolidated", f"""SELECT {_EXPORT} FROM consolidated
ORDER BY dispute_amount DESC NULLS LAST, dispute_id LIMIT 100"""),
        "monthly_summary": _with("disputes", f"""SELECT strftime(record_date, '%Y-%m') AS month, record_type,
  count(dispute_amount) AS quantidade, {_sum('dispute_amount')} AS valor_total,
  CASE WHEN count(dispute_amount) > 0 THEN {_mean('TRUE')} END AS ticket_medio FROM disputes GROUP BY 1, 2 ORDER BY 1, 2"""),
        "type_totals": _with("disputes", f"""SELECT {_sum('dispute_amount', _CB)} AS total_cb, {_N_CB} AS rows_cb,
  {_sum('dispute_amount', _NOC)} AS total_noc, {_N_NOC} AS rows_noc FROM disputes"""),
        "recurrence_tier": _with("disputes", """SELECT label, n, CASE WHEN n >= 50 THEN 'danger' ELSE 'warning' END AS tier
FROM (SELECT shopper_email AS label, count(*) AS n FROM disputes GROUP BY 1)"""),
        "share_of_total": _with("disputes", f"""SELECT label, n, {_pct('n', 'CAST(total AS BIGINT)')} AS pct FROM (
  SELECT label, n, sum(n) OVER () AS total FROM (
    SELECT payment_method AS label, count(*) AS n FROM disputes GROUP BY 1))"""),
    }


def _dashboard() -> dict[str, str]:
    reported = "count(coalesce(nullif(cs_item_principal, ''), nullif(cs_status_do_chargeback, '')))"
    seen = ("count(coalesce(nullif(cs_item_principal, ''), nullif(cs_status_do_chargeback, ''), "
            "nullif(vtex_cidade, '')))")
    mean = "CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {s} / {n} END"
    return {
        "dash_group_count": _dash_counts("disputes", "shopper_interaction"),
        "dash_kpis": _with("reconciled", f"""SELECT {_KPI_COUNTS},
  {mean.format(n=_N_CB, s=_sum('dispute_amount', _CB))} AS ticket_medio_cb,
  {mean.format(n=_N_NOC, s=_sum('dispute_amount', _NOC))} AS ticket_medio_noc,
  {reported} AS com_clearsale FROM reconciled WHERE {_RANGE}"""),
        # here rows count, whatever their amount
        "dash_monthly": _with("disputes", _MONTHLY.format(extra=f"AND {_RANGE}").replace("count(dispute_amount)", "count(*)")),
        "dash_reason": _dash_counts("disputes", "dispute_reason", 10),
        "dash_method": _dash_counts("disputes", "upper(nullif(nullif(payment_method, ''), 'nan'))"),
        "dash_status": _dash_counts("reconciled", "cs_status_do_chargeback"),
        "dash_delivery": _dash_counts("consolidated", _DASH_DELIVERY),
        "dash_state": _with("consolidated", f"""SELECT vtex_uf AS label, count(*) AS n,
  {_sum('dispute_amount')} AS total FROM consolidated
WHERE {_RANGE} AND vtex_uf IS NOT NULL AND vtex_uf NOT IN ('', 'nan') GROUP BY 1 ORDER BY n DESC, label"""),
        "dash_city": _dash_counts("consolidated", "vtex_cidade", 20),
        "dash_store": _dash_counts("consolidated", "vtex_store", 20),
        "dash_item": _dash_counts("reconciled", "cs_item_principal", 15),
        "dash_category": _categories(_RANGE + " AND vtex_categories NOT IN ('', 'nan')", 15),
        "dash_source": _dash_counts("reconciled", "fonte"),
        "dash_conversion": _dash_counts("flagged", "virou_chargeback"),
        "dash_cross_validation": _with("consolidated", f"SELECT {_cross(seen)} FROM consolidated WHERE {_RANGE}"),
        "dash_top_records": _with("consolidated", f"""SELECT dispute_id, psp_reference, record_type,
  dispute_amount, dispute_reason, payment_method, record_date, virou_chargeback, vtex_store, vtex_cidade,
  vtex_uf, vtex_delivery_type FROM consolidated WHERE {_RANGE}
ORDER BY coalesce(dispute_amount, 0) DESC, dispute_id LIMIT 100"""),
    }


def _section(name: str, label: str, k: int | None, money: bool = False, source: str = "consolidated") -> str:
    """One section of the document: ranked and cut with a length, unranked without."""
    n = "count(dispute_amount)" if money else "count(*)"
    total = _sum("dispute_amount") if money else "CAST(NULL AS DOUBLE)"
    counts = (f"SELECT {label} AS label, {n} AS n, {total} AS total FROM {source} "
              f"WHERE ({label}) IS NOT NULL GROUP BY 1")
    if k is None:
        return f"SELECT '{name}' AS section, CAST(NULL AS INTEGER) AS rank, label, n, total FROM ({counts})"
    shown = "substr(label, 1, 60)" if name == "por_produto_cs" else "label"
    return (f"SELECT '{name}', rank, {shown}, n, total FROM (SELECT *, CAST(row_number() OVER "
            f"(ORDER BY n DESC, label) AS INTEGER) AS rank FROM ({counts})) WHERE rank <= {k}")


def _sections() -> str:
    categories = ("(SELECT dispute_amount, nullif(trim(unnest(string_split(vtex_categories, '|'))), '') "
                  "AS category FROM consolidated)")
    return _with("consolidated", "\nUNION ALL ".join([
        _section("por_ferramenta", "fonte", None),
        _section("por_motivo", "dispute_reason", 10),
        _section("por_bandeira", "payment_method", None),
        _section("cs_status_chargeback", "cs_status_do_chargeback", None),
        _section("por_uf", "coalesce(vtex_uf, cs_uf)", None, money=True),
        _section("por_cidade", "coalesce(vtex_cidade, cs_cidade)", 20, money=True),
        _section("por_entrega", _DELIVERY, None),
        _section("por_entrega_detalhe", "vtex_delivery_type", 15),
        _section("por_categoria_vtex", "category", 20, source=categories),
        _section("por_produto_cs", "cs_item_principal", 20),
        _section("por_loja", "vtex_store", 30),
        _section("top_emails", "shopper_email", 15),
        _section("virou_chargeback", "virou_chargeback", None),
        _section("record_types", "record_type", None),
    ]))


REPORT_TIME = "2025-06-30 12:00:00"

_QUOTED = "CAST(to_json({}) AS VARCHAR)"
_FIGURE = "CAST(CAST({} AS DECIMAL(38,2)) AS VARCHAR)"
_PLAIN = "CAST({} AS VARCHAR)"


def _object(columns: dict[str, str]) -> str:
    """A JSON object as text: keys in order, values by the given form, nulls written out."""
    pairs = [f"""'"{c}":' || coalesce({form.format(c)}, 'null')""" for c, form in columns.items()]
    return "'{' || " + " || ',' || ".join(pairs) + " || '}'"


def _list(value: str, order: str) -> str:
    return f"'[' || string_agg({value}, ',' ORDER BY {order}) || ']'"


def _document(found: dict[str, str]) -> str:
    """The dashboard document from the SQL of its reports."""
    ranked = "n DESC, label"
    kpis = {c: _PLAIN for c in ("total_chargebacks", "total_notifications")} | {
        c: _FIGURE for c in ("valor_total_cb", "valor_total_noc", "ticket_medio_cb", "ticket_medio_noc")} | {
        "noc_que_viraram_cb": _PLAIN, "noc_total": _PLAIN, "taxa_conversao_noc_cb": _FIGURE,
        "com_sap": _PLAIN, "com_clearsale": _PLAIN}
    cross = {"total_adyen_cb_noc": _PLAIN, "encontrados_no_sap": _PLAIN, "nao_encontrados_sap": _PLAIN,
             "taxa_match_sap": _FIGURE, "encontrados_no_clearsale": _PLAIN,
             "nao_encontrados_clearsale": _PLAIN, "taxa_match_clearsale": _FIGURE}
    record = {c.strip(): _QUOTED for c in _EXPORT.split(",")} | {"dispute_amount": _FIGURE, "record_date": _QUOTED}
    months = "['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez']"

    def label(x: str) -> str:
        return f"concat({months}[CAST(month({x}) AS INT)], '/', strftime({x}, '%y'))"

    def side(name: str) -> str:
        return (f"""'"count":' || {_list(_PLAIN.format(name + '_count'), 'month')} || ',"total":' || """
                f"{_list(_FIGURE.format(name + '_total'), 'month')}")

    money = "section IN ('por_uf', 'por_cidade')"
    return f"""
WITH s AS ({_sections()}), m AS ({found['monthly_evolution']}), l AS ({found['ledger_monthly']}),
t AS (SELECT * REPLACE (strftime(record_date, '%Y-%m-%d %H:%M:%S') AS record_date) FROM ({found['top_records']})),
d AS ({_with('disputes', 'SELECT min(record_date) AS low, max(record_date) AS high FROM disputes')})
SELECT section, '{{"labels":' || {_list(_QUOTED.format('label'), ranked)} || ',"values":' || {_list(_PLAIN.format('n'), ranked)} || '}}' AS json
FROM s WHERE NOT {money} GROUP BY section
UNION ALL SELECT section, '{{"labels":' || {_list(_QUOTED.format('label'), ranked)} || ',"count":' || {_list(_PLAIN.format('n'), ranked)}
  || ',"total":' || {_list(_FIGURE.format('total'), ranked)} || '}}' FROM s WHERE {money} GROUP BY section
UNION ALL SELECT 'kpis', {_object(kpis)} FROM ({found['kpis']})
UNION ALL SELECT 'cross_validation', {_object(cross)} FROM ({found['cross_validation']})
UNION ALL SELECT 'evolucao_mensal', '{{"labels":' || {_list(_QUOTED.format('month'), 'month')}
  || ',"chargeback":{{' || {side('cb')} || '}},"notification":{{' || {side('noc')} || '}}}}' FROM m
UNION ALL SELECT 'sap_mensal', '{{"labels":' || {_list(_QUOTED.format('month'), 'month')} || ',"count":' || {_list(_PLAIN.format('n'), 'month')}
  || ',"total":' || {_list(_FIGURE.format('total'), 'month')} || '}}' FROM l
UNION ALL SELECT 'top_registros', {_list(_object(record), 'dispute_amount IS NULL, dispute_amount DESC, dispute_id')} FROM t
UNION ALL SELECT 'meta', '{{"periodo":"' || {label('low')} || ' — ' || {label('high')} || '","gerado_em":"{REPORT_TIME}"}}' FROM d"""


def _outputs() -> dict[str, str]:
    outer = f"outer_rows AS ({_OUTER})"
    prefix = _with("disputes ledger antifraud", "")
    return {
        "dashboard_sections": _sections(),
        "raw_export": _with("consolidated", """SELECT dispute_id, psp_reference AS "Psp Reference",
  record_type AS "type", CAST(dispute_amount AS DOUBLE) AS amount, dispute_reason AS reason,
  payment_method AS pm, strftime(record_date, '%Y-%m-%d') AS "date", virou_chargeback AS virou, fonte,
  vtex_order_id, vtex_store AS store, vtex_cidade AS cidade, vtex_uf AS uf, vtex_delivery_type AS delivery,
  vtex_categories, cs_item_principal AS cs_item, psp_reference_sap IS NOT NULL AS sap,
  cs_status_do_chargeback AS cs_status FROM consolidated"""),
        "outer_flow": _with("consolidated ledger antifraud", """
SELECT d.dispute_id, coalesce(d.psp_reference, l.psp_reference_sap) AS psp_reference,
  coalesce(d.record_type, 'SAP Only') AS record_type, d.vtex_order_id, d.adyen_id, l.ordinal,
  l.psp_reference_sap, l.sap_id, a.cs_pedido AS clearsale_pedido, d.vtex_store, d.vtex_cidade, d.vtex_uf
FROM (SELECT *, row_number() OVER (ORDER BY dispute_id) AS adyen_id FROM consolidated) d
FULL OUTER JOIN (SELECT *, row_number() OVER (ORDER BY ordinal) AS sap_id FROM ledger) l
  ON d.psp_reference = l.psp_reference_sap
LEFT JOIN antifraud a ON trim(d.vtex_order_id) = a.vtex_order_id"""),
        "chargeback_extract": f"{prefix}, {outer} SELECT * FROM outer_rows WHERE {_CB}",
        "notification_extract": f"{prefix}, {outer} SELECT * FROM outer_rows WHERE {_NOC}",
        "conversion_extract": f"""{prefix}, {outer}
SELECT {_OUTER_V2} AS virou_chargeback,
  concat('Adyen', CASE WHEN psp_reference_sap IS NOT NULL THEN ' + SAP' ELSE '' END,
         CASE WHEN cs_pedido IS NOT NULL THEN ' + ClearSale' ELSE '' END) AS fonte,
  dispute_id, psp_reference, record_type, dispute_amount, outer_rows.vtex_order_id, ordinal,
  psp_reference_sap, cs_pedido AS clearsale_pedido
FROM outer_rows LEFT JOIN antifraud a ON trim(outer_rows.vtex_order_id) = a.vtex_order_id
WHERE record_type IN ('Chargeback', 'NotificationOfChargeback')""",
    }


def _files() -> dict[str, str]:
    first = ("first({c} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) "
             "FILTER (WHERE {c} IS NOT NULL)")
    report = "pedido, status_do_chargeback, {city} AS cidade, uf, item_principal"
    return {
        "scan_delimited": _with("disputes_all", """SELECT dispute_id, record_type,
  CAST(dispute_amount AS VARCHAR) AS dispute_amount, metadata, TRUE AS from_csv FROM disputes_all"""),
        "load_disputes": _with("disputes", """SELECT dispute_id, record_type, psp_reference, dispute_amount,
  date_trunc('day', record_date) AS record_date, vtex_order_id FROM disputes"""),
        "scan_workbooks": _with("ledger_all", """SELECT denominacao_sap, valor_sap,
  CASE WHEN (ordinal // 2000) % 2 = 0 THEN CAST(date_diff('day', DATE '1899-12-30', data_lancamento_sap) AS VARCHAR)
       ELSE strftime(data_lancamento_sap, '%d/%m/%Y') END AS placed FROM ledger_all"""),
        "load_ledger": _with("ledger", """SELECT denominacao_sap, psp_reference_sap, nsu,
  date_trunc('day', data_lancamento_sap) AS data_lancamento_sap, valor_sap,
  TRY_CAST(valor_sap AS DECIMAL(18,2)) AS valor_sap_numero FROM ledger"""),
        "load_antifraud": _with("antifraud", """SELECT vtex_order_id, cs_pedido AS clearsale_pedido,
  cs_status_do_chargeback AS clearsale_status_do_chargeback, cs_cidade AS clearsale_cidade,
  cs_uf AS clearsale_uf, cs_item_principal AS clearsale_item_principal FROM antifraud"""),
        "outer_from_files": _with("disputes ledger antifraud", f"""
SELECT d.dispute_id, d.psp_reference, d.record_type, d.vtex_order_id, l.psp_reference_sap,
  {_OUTER_V2.replace('record_type', 'd.record_type').replace('psp_reference IN (SELECT psp_reference FROM disputes WHERE d.record_type', 'd.psp_reference IN (SELECT psp_reference FROM disputes WHERE record_type').replace('FROM disputes WHERE d.record_type', 'FROM disputes WHERE record_type')} AS virou_chargeback,
  concat('Adyen', CASE WHEN l.psp_reference_sap IS NOT NULL THEN ' + SAP' ELSE '' END,
         CASE WHEN a.cs_pedido IS NOT NULL THEN ' + ClearSale' ELSE '' END) AS fonte
FROM disputes d LEFT JOIN ledger l ON d.psp_reference = l.psp_reference_sap
LEFT JOIN antifraud a ON trim(d.vtex_order_id) = a.vtex_order_id"""),
        "list_inputs": _with("antifraud_all", """SELECT DISTINCT concat('page', ordinal // 1000) AS page,
  1 AS n_files, TRUE AS filled FROM antifraud_all"""),
        "with_source_file": _with("antifraud_all", """SELECT DISTINCT concat('page', ordinal // 1000) AS page,
  1 AS n_files, 1 AS n_lines, TRUE AS named FROM antifraud_all"""),
        "resolve_column": _with("ledger_all", """SELECT ordinal, denominacao_sap, data_lancamento_sap,
  valor_sap FROM ledger_all"""),
        "scan_semicolon": _with("antifraud_all", f"SELECT {report.format(city=chr(39) + 'São ' + chr(39) + ' || cidade')} FROM antifraud_all"),
        "scan_html_tables": _with("antifraud_all", f"SELECT {report.format(city='cidade')} FROM antifraud_all"),
        "scan_order_export": f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
  {first.format(c='sequence')} AS sequence, {first.format(c='status_description')} AS status_description,
  {first.format(c='creation_date')} AS creation_date, {first.format(c='total_value')} AS total_value
FROM (SELECT *, CAST(l_linenumber AS BIGINT) AS sequence,
        CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS status_description,
        l_shipdate AS creation_date, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS total_value
      FROM lineitem) GROUP BY l_orderkey""",
        "scan_cache": _with("enrichment", f"""SELECT wanted AS order_id, {_ATTRIBUTES},
  CASE WHEN order_id IS NULL THEN 'not_found' ELSE 'found' END AS status,
  TIMESTAMP '2025-01-02' AS fetched_at FROM enrichment"""),
        "consolidated_extracts": _with("flagged", f"""
SELECT 'Consolidado' AS extract, count(*) AS n_rows FROM flagged
UNION ALL SELECT 'Chargebacks', {_N_CB} FROM flagged
UNION ALL SELECT 'Notifications', {_N_NOC} FROM flagged
UNION ALL SELECT 'Virou_Chargeback', {_N_CONV} FROM flagged
UNION ALL SELECT 'Resumo_Mensal', count(DISTINCT (strftime(record_date, '%Y-%m'), record_type)) FROM flagged"""),
    }


def oracle_sql() -> dict[str, str]:
    found = {
        **_scans_and_normalisation(), **_matching(), **_orders(),
        **_breakdowns(), **_dashboard(), **_outputs(), **_files(),
    }
    joined = {f"{name}_joined": found[name] for name in ("kpis", "top_records")}
    return found | joined | {"update_cache": found["upsert_cache"], "dashboard_document": _document(found)}
