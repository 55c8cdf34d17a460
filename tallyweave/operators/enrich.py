"""Order enrichment: documents to attributes, candidate ids and the order cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave import constants as C, schemas
from tallyweave.functions import nested, numbers
from tallyweave.functions.text import base_order_id, dashed, order_id_suffix
from tallyweave.operators.prefilter import likely_members
from tallyweave.operators.skew import KeyProfile, first_per_key, lookup_join

ATTRIBUTES = C.ENRICHMENT_COLUMNS


def parse_documents(df: DataFrame, column: str, schema, name: str = "doc") -> DataFrame:
    """JSON text to a typed document; unreadable text gives null."""
    return df.withColumn(name, F.from_json(column, schema)).drop(column)


def flatten_order(df: DataFrame, column: str = "order_json") -> DataFrame:
    """The 22 summary fields of each listed order."""
    return parse_documents(df, column, schemas.ORDER_SUMMARY).select(*nested.summary(F.col("doc")))


def flatten_detail(df: DataFrame, column: str = "detail", key: str = "order_id") -> DataFrame:
    """All attributes of each order document, from one parse."""
    doc = F.col("doc")
    return parse_documents(df.select(key, column), column, schemas.ORDER_DETAIL).select(
        key, *nested.address(doc), *nested.logistics(doc), *nested.invoice(doc),
        nested.store(doc), *nested.installments(doc), nested.coupon(doc),
        nested.discount(doc), nested.products(doc), nested.categories(doc),
    )


def flatten_part(df: DataFrame, *parts: Column, column: str = "detail",
                 key: str = "order_id") -> DataFrame:
    """Some attributes only; fields nobody asked for are not even parsed."""
    parsed = parse_documents(df.select(key, column), column, schemas.ORDER_DETAIL)
    return parsed.select(key, *parts)


def order_attributes(flat: DataFrame, key: str = "order_id") -> DataFrame:
    """The attributes attached to disputes, named as they are there."""
    return flat.select(
        key, "vtex_store", "vtex_installments", "vtex_installment_value", "vtex_coupon",
        "vtex_discount_value",
        F.col("invoice_number").alias("vtex_invoice_number"),
        F.col("invoice_key").alias("vtex_invoice_key"),
        F.col("cidade").alias("vtex_cidade"),
        F.col("uf").alias("vtex_uf"),
        nested.delivery_type(F.col("sla_type"), F.col("address_type")).alias("vtex_delivery_type"),
        "vtex_products", "vtex_categories",
    )


def missing_orders(needed: DataFrame, cache: DataFrame) -> DataFrame:
    """Needed ids without an answer yet; ids whose lookup failed are asked again."""
    answered = cache.where(F.col("status") != "error").select("order_id")
    return needed.join(answered, "order_id", "left_anti")


def candidates(ids: DataFrame, key: str = "order_id") -> DataFrame:
    """Ids to try, in order: a dashed id as it is, otherwise with each suffix."""
    value = F.col(key)
    variants = F.array(*[F.concat(value, F.lit(s)) for s in C.CANDIDATE_SUFFIXES])
    tried = F.when(dashed(value), F.array(value)).otherwise(variants)
    return ids.select(key, F.posexplode(tried).alias("rank", "candidate"))


#: Columns of a document beside a row that looks it up.
_DOCUMENT = "_document_"


def wanted_documents(documents: DataFrame, rows: DataFrame, order_col: str = "vtex_order_id",
                     key: str = "order_id") -> DataFrame:
    """The documents that an order of the rows may resolve to, and a few others.

    Applied to raw documents, so that those nobody asks for are not even parsed.
    """
    return likely_members(documents, base_order_id(F.col(key)), rows, base_order_id(F.trim(order_col)))


def documents_by_base(details: DataFrame, key: str = "order_id") -> DataFrame:
    """Documents by base id: each id once, with its suffix and whether it is the first to try.

    All candidates of an order share its base id, so the documents are shuffled and
    sorted once, for this and for the join; a row then takes the one that fits it.
    """
    base = base_order_id(F.col(key))
    suffix = order_id_suffix(F.col(key))
    slots = F.coalesce(*[F.when(suffix == s, F.lit(i)) for i, s in enumerate(C.CANDIDATE_SUFFIXES)])
    placed = details.select(
        base.alias("_base"), suffix.alias("_document_suffix"), slots.alias("_slot"),
        *[F.col(c).alias(_DOCUMENT + c) for c in details.columns])
    # several documents of one id: any one, but always the same
    order = Window.partitionBy("_base").orderBy("_slot", F.xxhash64(*[_DOCUMENT + c for c in details.columns]))
    slot = F.col("_slot")
    return placed.withColumns({
        "_again": F.coalesce(F.lag("_slot").over(order) == slot, F.lit(False)),
        "_first": F.first("_slot").over(order) == slot,
    }).where(~F.col("_again")).drop("_again", "_slot")


def fits() -> Column:
    """Whether a document of the row's base id is the one the row takes.

    A plain id takes the first candidate there is, a dashed one that of its own suffix.
    """
    return F.when(F.col("_suffix").isNull(), F.col("_first")).otherwise(
        F.col("_suffix") == F.col("_document_suffix"))


def attach_documents(
    df: DataFrame,
    details: DataFrame,
    row_id: Sequence[str],
    order_col: str = "vtex_order_id",
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Left-join the best-ranked document of each row's order; keeps the row count.

    A given ``profile`` must be that of ``base_order_id`` of the order column.
    """
    keyed = key_by_base(df, order_col)
    joined = lookup_join(keyed, "_order", [(documents_by_base(details), "_base", fits())], row_id, profile)
    return pick_document(joined, df.columns, details.columns)


def key_by_base(df: DataFrame, order_col: str = "vtex_order_id") -> DataFrame:
    """Add the base id documents are looked up by, whether it is the wanted id itself,
    and for a dashed id the suffix its document must have."""
    wanted = F.trim(order_col)
    return df.withColumns({
        "_order": base_order_id(wanted),
        "_own_base": base_order_id(wanted) == wanted,
        "_suffix": F.when(dashed(wanted), order_id_suffix(wanted)),
    })


def pick_document(joined: DataFrame, columns: Sequence[str], fields: Sequence[str],
                  key: str = "order_id") -> DataFrame:
    """Keep ``columns`` and add the fields of the joined document, its id as ``matched_id``."""
    payload = [c for c in fields if c != key]
    kept = [c for c in columns if c not in payload]
    return joined.select(*kept, F.col(_DOCUMENT + key).alias("matched_id"),
                         *[F.col(_DOCUMENT + c).alias(c) for c in payload])


def resolve_candidates(ids: DataFrame, details: DataFrame) -> DataFrame:
    """Best-ranked document of each distinct id; ids without one are kept with nulls."""
    renamed = ids.select(F.col("order_id").alias("_id"))
    found = attach_documents(renamed, details, ["_id"], "_id", KeyProfile())
    return found.withColumnRenamed("_id", "order_id")


def as_cache(resolved: DataFrame, fetched_at: Column) -> DataFrame:
    """Resolved orders as cache rows; an id without a document is "not_found"."""
    status = F.when(F.col("matched_id").isNull(), "not_found").otherwise("found")
    return resolved.withColumn("status", status).withColumn("fetched_at", fetched_at).drop("matched_id")


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Latest answer per order; on equal times the fresh one wins."""
    both = cache.withColumn("_fresh", F.lit(0)).unionByName(
        fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True
    )
    order = [F.desc_nulls_last("fetched_at"), F.desc("_fresh")]
    return first_per_key(both, ["order_id"], order).drop("_fresh")


def attach_enrichment(
    df: DataFrame,
    cache: DataFrame,
    row_id: Sequence[str],
    order_col: str = "vtex_order_id",
    profile: KeyProfile | None = None,
) -> DataFrame:
    """All order attributes in one left join by trimmed order id."""
    attributes = [c for c in ATTRIBUTES if c in cache.columns]
    side = cache.select(F.col("order_id").alias("_cached_order"), *attributes)
    keyed = df.drop(*attributes).withColumn("_order", F.trim(order_col))
    return lookup_join(keyed, "_order", [(side, "_cached_order")], row_id,
                       profile).drop("_order", "_cached_order")


def collapse_orders(df: DataFrame, order: Sequence[str], key: str = "order_id",
                    columns: Sequence[str] = C.COLLAPSE_COLUMNS) -> DataFrame:
    """One row per order: the first non-null value of each column in load order."""
    position = F.struct(*order)
    kept = [c for c in columns if c in df.columns]
    firsts = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(c) for c in kept
    ]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*firsts)


def normalize_order_types(df: DataFrame) -> DataFrame:
    """Summary columns with proper types; bad values become null."""
    out = df
    if "sequence" in df.columns:
        out = out.withColumn("sequence", numbers.try_numeric("sequence", "bigint"))
    if "total_value" in df.columns:
        out = out.withColumn("total_value", numbers.try_numeric("total_value"))
    return out


def coalesce_location(df: DataFrame) -> DataFrame:
    """State and city of the order document, else of the antifraud report."""
    def pick(*names: str) -> Column:
        found = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.withColumn("uf_combined", pick("vtex_uf", "cs_uf")).withColumn(
        "cidade_combined", pick("vtex_cidade", "cs_cidade")
    )


