"""Declared schemas of the feeds that arrive as JSON, and of the order cache."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ORDER_SUMMARY = _struct(
    orderId=_S, sequence=_S, clientName=_S, hostname=_S, origin=_S,
    salesChannel=_S, status=_S, statusDescription=_S, isAllDelivered=_B,
    isAnyDelivered=_B, workflowInErrorState=_B, totalValue=_L, totalItems=_L,
    paymentNames=_S, creationDate=_S, lastChange=_S, authorizedDate=_S,
    paymentApprovedDate=_S, readyForHandlingDate=_S, ShippingEstimatedDate=_S,
    ShippingEstimatedDateMin=_S, ShippingEstimatedDateMax=_S,
)

ORDER_DETAIL = _struct(
    hostname=_S,
    sellers=T.ArrayType(_struct(name=_S)),
    shippingData=_struct(
        address=_struct(state=_S, city=_S, postalCode=_S, addressType=_S),
        logisticsInfo=T.ArrayType(_struct(selectedSla=_S, shippingEstimate=_S)),
    ),
    packageAttachment=_struct(
        packages=T.ArrayType(_struct(invoiceKey=_S, invoiceNumber=_S)),
    ),
    paymentData=_struct(
        transactions=T.ArrayType(
            _struct(payments=T.ArrayType(_struct(installments=_L, value=_L))),
        ),
    ),
    marketingData=_struct(coupon=_S, couponCode=_S),
    totals=T.ArrayType(_struct(id=_S, value=_L)),
    items=T.ArrayType(_struct(name=_S, productCategories=T.MapType(_S, _S))),
)

ENRICHMENT = _struct(
    vtex_store=_S, vtex_installments=_L, vtex_installment_value=T.DoubleType(),
    vtex_coupon=_S, vtex_discount_value=T.DoubleType(), vtex_invoice_number=_S,
    vtex_invoice_key=_S, vtex_cidade=_S, vtex_uf=_S, vtex_delivery_type=_S,
    vtex_products=_S, vtex_categories=_S,
)

#: status is "found", "not_found" (never asked again) or "error" (asked again)
CACHE = T.StructType(
    [T.StructField("order_id", _S)]
    + ENRICHMENT.fields
    + [T.StructField("status", _S), T.StructField("fetched_at", T.TimestampNTZType())]
)
