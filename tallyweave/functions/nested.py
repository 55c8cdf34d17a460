"""Attributes read out of the nested order documents.

Every function takes the parsed document column (see ``schemas``) and returns
one column; a caller that needs several parses once and selects them together.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave.functions.numbers import as_double, cents_to_amount
from tallyweave.functions.text import blank_to_null

#: separator used when a list of names is shown as one text
LIST_SEPARATOR = " | "

# Document field of each summary column, in output order.
SUMMARY_FIELDS = {
    "order_id": "orderId",
    "sequence": "sequence",
    "client_name": "clientName",
    "hostname": "hostname",
    "origin": "origin",
    "sales_channel": "salesChannel",
    "status": "status",
    "status_description": "statusDescription",
    "is_all_delivered": "isAllDelivered",
    "is_any_delivered": "isAnyDelivered",
    "workflow_error": "workflowInErrorState",
    "total_value": "totalValue",
    "total_items": "totalItems",
    "payment_name": "paymentNames",
    "creation_date": "creationDate",
    "last_change": "lastChange",
    "authorized_date": "authorizedDate",
    "payment_approved_date": "paymentApprovedDate",
    "ready_for_handling_date": "readyForHandlingDate",
    "shipping_estimated_date": "ShippingEstimatedDate",
    "shipping_estimated_date_min": "ShippingEstimatedDateMin",
    "shipping_estimated_date_max": "ShippingEstimatedDateMax",
}


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def summary(doc: Column) -> list[Column]:
    columns = []
    for name, field in SUMMARY_FIELDS.items():
        value = doc[field]
        columns.append((cents_to_amount(value) if name == "total_value" else value).alias(name))
    return columns


def address(doc: Column) -> list[Column]:
    where = doc["shippingData"]["address"]
    return [
        where["state"].alias("uf"),
        where["city"].alias("cidade"),
        where["postalCode"].alias("cep"),
        where["addressType"].alias("address_type"),
    ]


def logistics(doc: Column) -> list[Column]:
    leg = _first(doc["shippingData"]["logisticsInfo"])
    return [
        leg["selectedSla"].alias("sla_type"),
        leg["shippingEstimate"].alias("delivery_deadline"),
    ]


def invoice(doc: Column) -> list[Column]:
    package = _first(doc["packageAttachment"]["packages"])
    return [
        package["invoiceKey"].alias("invoice_key"),
        package["invoiceNumber"].alias("invoice_number"),
    ]


def store(doc: Column) -> Column:
    """Seller name up to the first spaced dash, else the host name."""
    seller = F.substring_index(_first(doc["sellers"])["name"], " - ", 1)
    host = F.nullif(doc["hostname"], F.lit(""))
    return F.coalesce(blank_to_null(seller), host).alias("vtex_store")


def installments(doc: Column) -> list[Column]:
    """Instalments of the first payment and the value of one, rounded to cents."""
    payment = _first(_first(doc["paymentData"]["transactions"])["payments"])
    count, cents = payment["installments"], payment["value"]
    each = F.round(cents.cast("decimal(20,0)") / (count * 100).cast("decimal(20,0)"), 2)
    return [
        count.alias("vtex_installments"),
        F.when(count != 0, as_double(each)).alias("vtex_installment_value"),
    ]


def coupon(doc: Column) -> Column:
    code = doc["marketingData"]
    return F.coalesce(
        F.nullif(code["coupon"], F.lit("")), F.nullif(code["couponCode"], F.lit(""))
    ).alias("vtex_coupon")


def discount(doc: Column) -> Column:
    """First total called "Discounts", as a positive amount; zero counts as none."""
    line = _first(F.filter(doc["totals"], lambda t: t["id"] == "Discounts"))
    cents = F.nullif(F.abs(line["value"]), F.lit(0))
    return (cents / 100).alias("vtex_discount_value")


def products(doc: Column) -> Column:
    names = F.filter(doc["items"]["name"], lambda n: n != "")
    return F.nullif(F.concat_ws(LIST_SEPARATOR, names), F.lit("")).alias("vtex_products")


def categories(doc: Column) -> Column:
    """Distinct category names over all items, sorted."""
    per_item = F.transform(
        doc["items"]["productCategories"],
        lambda m: F.coalesce(F.map_values(m), F.array().cast("array<string>")),
    )
    names = F.filter(F.flatten(per_item), lambda n: n != "")
    ordered = F.array_sort(F.array_distinct(names))
    return F.nullif(F.concat_ws(LIST_SEPARATOR, ordered), F.lit("")).alias("vtex_categories")


def delivery_type(sla: Column, address_kind: Column) -> Column:
    """``sla (address)`` with spaces and brackets stripped at both ends."""
    shown = F.concat(
        F.coalesce(sla, F.lit("")), F.lit(" ("), F.coalesce(address_kind, F.lit("")), F.lit(")")
    )
    return F.trim(shown, F.lit(" ()"))
