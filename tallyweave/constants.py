"""Result texts, header names and limits that outputs must carry.

Everything in this module is data that has to be spelled exactly as the
existing feeds and reports spell it, so that results can be compared with them.
"""

# --- Fixed values: record types kept by the reconciliation -------------------
CHARGEBACK = "Chargeback"
NOTIFICATION = "NotificationOfChargeback"
RECORD_TYPES = (NOTIFICATION, CHARGEBACK)
LEDGER_ONLY = "SAP Only"

# --- Fixed values: conversion flag -------------------------------------------
CONVERTED = "Sim"
NOT_CONVERTED = "Não"
IS_CHARGEBACK = "É Chargeback"
NOT_APPLICABLE = "N/A"

# --- Fixed values: provenance labels -----------------------------------------
SOURCE_ACQUIRER = "Adyen"
SOURCE_LEDGER = "SAP"
SOURCE_ANTIFRAUD = "ClearSale"
SOURCE_SEPARATOR = " + "

# --- Fixed values: delivery classes and their keywords (tested in this order) -
PICKUP = "Clique e Retire"
HOME = "Entrega em Casa"
OTHER = "Outros"
PICKUP_WORDS = ("retirada", "retire", "retira", "pickup", "retirar")
HOME_WORDS = (
    "entrega", "delivery", "normal", "expressa",
    "sedex", "pac", "correios", "economic",
)
DASH_PICKUP_WORDS = ("retira", "pickup")
DASH_HOME_WORDS = ("entrega", "normal", "express")

# --- Fixed values: ledger narrative ------------------------------------------
NARRATIVE_TEXT = "CHARGEBACK"
# 16 alphanumerics after "NSU"; (?U) makes \w match Unicode letters.
PSP_PATTERN = r"(?U)NSU[^\w]*([A-Za-z0-9]{16})"
# the alphanumeric run that ends the text, after a 16-character code
NSU_PATTERN = r"(?U)[A-Za-z0-9]{16}[^\w]*([A-Za-z0-9]+)$"

# --- Fixed values: month names of the dashboard ------------------------------
MONTH_NAMES = (
    "Jan", "Fev", "Mar", "Abr", "Mai", "Jun",
    "Jul", "Ago", "Set", "Out", "Nov", "Dez",
)

# --- Fixed values: headers of the dispute CSV feed ---------------------------
DISPUTE_HEADERS = {
    "Record Type": "record_type",
    "Psp Reference": "psp_reference",
    "Merchant Reference": "merchant_reference",
    "Dispute Amount": "dispute_amount",
    "Dispute Reason": "dispute_reason",
    "Payment Method": "payment_method",
    "Shopper Interaction": "shopper_interaction",
    "Shopper Email": "shopper_email",
    "Record Date": "record_date",
    "Payment Date": "payment_date",
    "Dispute Date": "dispute_date",
    "Dispute End Date": "dispute_end_date",
    "Metadata": "metadata",
}
DISPUTE_DATES = ("record_date", "payment_date", "dispute_date", "dispute_end_date")

# --- Fixed values: attributes attached to each order -------------------------
ENRICHMENT_COLUMNS = (
    "vtex_store", "vtex_installments", "vtex_installment_value", "vtex_coupon",
    "vtex_discount_value", "vtex_invoice_number", "vtex_invoice_key",
    "vtex_cidade", "vtex_uf", "vtex_delivery_type", "vtex_products",
    "vtex_categories",
)
CANDIDATE_SUFFIXES = ("-01", "", "-02")  # tried in this order

# --- Fixed values: columns of the raw export and their short names -----------
RAW_EXPORT_COLUMNS = {
    "psp_reference": "Psp Reference",
    "record_type": "type",
    "dispute_amount": "amount",
    "dispute_reason": "reason",
    "payment_method": "pm",
    "record_date": "date",
    "virou_chargeback": "virou",
    "fonte": "fonte",
    "vtex_order_id": "vtex_order_id",
    "vtex_store": "store",
    "vtex_cidade": "cidade",
    "vtex_uf": "uf",
    "vtex_delivery_type": "delivery",
    "vtex_categories": "vtex_categories",
    "cs_item_principal": "cs_item",
    "psp_reference_sap": "sap",
    "cs_status_do_chargeback": "cs_status",
}

# --- Fixed values: headers of the order CSV export ---------------------------
ORDER_EXPORT_HEADERS = {
    "Order": "order_id",
    "Sequence": "sequence",
    "Status": "status_description",
    "Creation Date": "creation_date",
    "Last Change Date": "last_change",
    "Total Value": "total_value",
    "Origin": "origin",
    "SalesChannel": "sales_channel",
    "Seller Order Id": "seller_order_id",
    "SLA Type": "sla_type",
    "Estimate Delivery Date": "shipping_estimated_date",
    "Delivery Deadline": "delivery_deadline",
    "UF": "uf",
    "City": "cidade",
    "Address Type": "address_type",
    "Tracking Number": "tracking_number",
    "Delivered": "is_all_delivered",
    "Client Name": "client_name",
    "Payment System Name": "payment_name",
}
COLLAPSE_COLUMNS = (
    "sequence", "status_description", "creation_date", "last_change",
    "total_value", "sla_type", "shipping_estimated_date", "delivery_deadline",
    "uf", "cidade", "address_type", "tracking_number", "is_all_delivered",
    "client_name", "payment_name", "origin", "sales_channel",
)

# --- Fixed values: report sizes ----------------------------------------------
TOP_REASONS = 10
TOP_REASONS_PROFILE = 15
TOP_CITIES = 20
TOP_DELIVERY_DETAIL = 15
TOP_CATEGORIES = 20
TOP_ITEMS = 20
TOP_STORES = 30
TOP_EMAILS = 15
TOP_RECORDS = 100
DASH_TOP_STORES = 20
DASH_TOP_ITEMS = 15
DASH_TOP_CATEGORIES = 15
LABEL_WIDTH = 60
PREVIEW_ROWS = 15
SAMPLE_ROWS = 5
RECURRENCE_DANGER = 50

# --- Fixed values: order extraction windows ----------------------------------
WINDOW_HOURS = 2
WINDOW_CAP = 3000
