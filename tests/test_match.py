"""Matching against brute force, with null keys and one key holding a third of the rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import enrich, feeds, match
from tallyweave.operators.ids import dense_ids
from tallyweave.operators.prefilter import likely_members
from tallyweave.operators.skew import (
    KeyProfile, fanout_join, lookup_join, profile_frames, profile_key, profile_keys, top_n_per_group,
)

DISPUTE = "dispute_id string, psp_reference string, record_type string, dispute_amount decimal(18,2), vtex_order_id string"
LEDGER = "ordinal bigint, psp_reference_sap string, valor_sap string"
CB, NOC = "Chargeback", "NotificationOfChargeback"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def skewed_disputes(n=600, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ref = rng.choice(["HOT", None, f"K{rng.randrange(80)}"])
        kind = CB if ref != "K1" and rng.random() < 0.3 else NOC
        out.append((f"d{i}", ref, kind, None, rng.choice(["O-HOT", None, f"{rng.randrange(50)} "])))
    return out


def skewed_ledger(n=300, seed=8):
    rng = random.Random(seed)
    keys = ["HOT", None, "ONLY", "LHOT"]
    return [(i, rng.choice([*keys, f"K{rng.randrange(80)}"]), str(i)) for i in range(n)]


@pytest.fixture(scope="module")
def disputes(spark):
    return spark.createDataFrame(skewed_disputes(), DISPUTE).repartition(5)


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(skewed_ledger(), LEDGER).repartition(4)


def test_profile_finds_hot_and_null_keys(disputes):
    profile = profile_key(disputes, "psp_reference")
    assert "HOT" in profile.hot and profile.hot_null
    even = disputes.withColumn("k", F.col("dispute_id"))
    assert profile_key(even, "k") == KeyProfile()


def test_frequent_keys_are_counted_exactly(spark):
    # 8 shuffle partitions: frequent is more than an eighth of 16,000 rows, beside 9,999 keys met once
    rows = ["at"] * 2000 + ["above"] * 2001 + [f"u{i}" for i in range(9_999)] + [None] * 2000
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(k, k) for k in rows], "k string, other string").repartition(7)
    assert len(rows) == 16_000
    assert profile_key(df, "k") == KeyProfile(("above",), False)
    both = profile_keys(df, {"one": F.col("k"), "two": F.coalesce("other", F.lit("none"))})
    assert both == {"one": KeyProfile(("above",), False), "two": KeyProfile(("above",), False)}
    more = profile_frames({"l": (df, "k"), "r": (df.where("k IS NULL"), "k")})
    assert more == {"l": KeyProfile(("above",), False), "r": KeyProfile((), True)}


def test_profile_of_empty_frame(disputes):
    assert profile_key(disputes.limit(0), "psp_reference") == KeyProfile()


def test_match_ledger_takes_first_posting_and_keeps_rows(disputes, ledger):
    first = {}
    for ordinal, ref, value in sorted(skewed_ledger()):
        first.setdefault(ref, value)
    expected = Counter(
        (d[0], first.get(d[1]) if d[1] is not None else None) for d in skewed_disputes())
    got = match.match_ledger(disputes, ledger).select("dispute_id", "valor_sap")
    assert rows_of(got) == expected


def test_null_references_match_on_request(disputes, ledger):
    first = {}
    for ordinal, ref, value in sorted(skewed_ledger()):
        first.setdefault(ref, value)
    expected = Counter((d[0], first.get(d[1])) for d in skewed_disputes())
    got = match.match_ledger(disputes, ledger, null_keys="match").select("dispute_id", "valor_sap")
    assert rows_of(got) == expected


def test_outer_match_fans_out_on_both_sides(disputes, ledger):
    left, right = skewed_disputes(), skewed_ledger()
    expected = Counter()
    for d in left:
        hits = [p for p in right if d[1] is not None and p[1] == d[1]]
        for p in hits or [(None, None, None)]:
            expected[(d[0], d[1], d[2], p[0])] += 1
    known = {d[1] for d in left}
    for p in right:
        if p[1] is None or p[1] not in known:
            expected[(None, p[1], "SAP Only", p[0])] += 1
    got = match.match_ledger_outer(disputes, ledger).select(
        "dispute_id", "psp_reference", "record_type", "ordinal")
    assert rows_of(got) == expected


def test_fanout_join_with_one_sided_hot_keys(spark):
    left = [(i, "A" if i % 2 else f"x{i}") for i in range(60)] + [(900, "B")]
    right = [(i, "B" if i % 3 else f"x{i}") for i in range(60)] + [(901, "A")]
    l = spark.createDataFrame(left, "i int, lk string")
    r = spark.createDataFrame(right, "j int, rk string")
    expected = Counter()
    for i, k in left:
        hits = [j for j, q in right if q == k]
        for j in hits or [None]:
            expected[(i, j)] += 1
    got = fanout_join(l, r, "lk", "rk", ["i"], ["j"]).select("i", "j")
    assert rows_of(got) == expected


def test_spread_and_plain_joins_agree(disputes, ledger):
    lookup = match.dedup_first(ledger, "psp_reference_sap", "ordinal")
    profiles = [KeyProfile(), KeyProfile(("HOT",), True), KeyProfile((), True), KeyProfile(("HOT", "K1"))]
    results = [
        rows_of(lookup_join(disputes, "psp_reference", [(lookup, "psp_reference_sap")], ["dispute_id"], p)
                .select("dispute_id", "valor_sap"))
        for p in profiles
    ]
    assert all(r == results[0] for r in results)


def test_conversion_flags(disputes):
    charged = {d[1] for d in skewed_disputes() if d[2] == CB and d[1] is not None}
    expected = Counter(
        (d[0], "É Chargeback" if d[2] == CB else "Sim" if d[1] in charged else "Não")
        for d in skewed_disputes())
    assert rows_of(match.flag_noc_conversion(disputes).select("dispute_id", "virou_chargeback")) == expected
    v2 = Counter((d, "Sim" if f == "É Chargeback" else f) for (d, f) in expected.elements())
    assert rows_of(match.flag_noc_conversion_v2(disputes).select("dispute_id", "virou_chargeback")) == v2


def test_without_any_chargeback(disputes):
    only = disputes.where(F.col("record_type") == NOC)
    for flagged in (match.flag_noc_conversion(only), match.flag_noc_conversion_v2(only)):
        assert {r[0] for r in flagged.select("virou_chargeback").distinct().collect()} == {"Não"}


def test_other_types_are_not_applicable(spark):
    df = spark.createDataFrame([("d", "K", "Settled", None, None)], DISPUTE)
    assert match.flag_noc_conversion(df).first()["virou_chargeback"] == "N/A"


def test_reconcile_end_to_end(spark, disputes, ledger):
    reports = spark.createDataFrame(
        [("O-HOT", "p1", "closed"), ("7", "p2", None), ("8", None, None)],
        "vtex_order_id string, cs_pedido string, cs_status string")
    out = match.reconcile(disputes, ledger, reports)
    assert out.count() == len(skewed_disputes())
    refs = {p[1] for p in skewed_ledger() if p[1] is not None}
    orders = {"O-HOT", "7"}  # the report of order 8 holds no value at all
    expected = Counter()
    for d in skewed_disputes():
        order = d[4].strip() if d[4] else None
        label = "Adyen" + (" + SAP" if d[1] in refs else "") + (" + ClearSale" if order in orders else "")
        expected[(d[0], label)] += 1
    assert rows_of(out.select("dispute_id", "fonte")) == expected
    shuffled = match.reconcile(disputes.repartition(3, "record_type"), ledger.orderBy(F.rand(3)), reports)
    assert rows_of(out.select(*sorted(out.columns))) == rows_of(shuffled.select(*sorted(out.columns)))
    rates = match.match_rates(out).first()
    assert rates["total"] == len(skewed_disputes())
    assert rates["ledger_matched"] == sum(d[1] in refs for d in skewed_disputes())


def test_reconcile_can_match_null_references(disputes, ledger, spark):
    reports = spark.createDataFrame([], "vtex_order_id string, cs_pedido string")
    plain = match.reconcile(disputes, ledger, reports)
    nulls = match.reconcile(disputes, ledger, reports, null_keys="match")
    assert nulls.count() == plain.count()
    matched = nulls.where("psp_reference IS NULL AND valor_sap IS NOT NULL").count()
    assert matched == sum(d[1] is None for d in skewed_disputes())


def test_dedup_last_keeps_null_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "ordinal int, k string")
    assert rows_of(match.dedup_last(df, "k", "ordinal")) == Counter([(2, "a"), (4, None)])
    assert rows_of(match.dedup_first(df, "k", "ordinal")) == Counter([(1, "a"), (3, None)])


def test_top_n_per_group_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 37) % 1000, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = rows_of(top_n_per_group(df, ["g"], [F.asc("v"), F.asc("i")], 5, ["i"]))
    expected = Counter()
    for g in {r[0] for r in rows}:
        expected.update(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))[:5])
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 500])
def test_dense_ids(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 100003).alias("k"))
    numbered = dense_ids(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in numbered] == list(range(1, n + 1))


def test_candidates_rank_and_upsert(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4-02",), ("5",)], "order_id string")
    docs = spark.createDataFrame(
        [("1-01", "a"), ("1", "b"), ("2", "c"), ("2-02", "d"), ("3-02", "e"), ("4-02", "f"), ("4", "g")],
        "order_id string, vtex_store string")
    got = {r["order_id"]: (r["matched_id"], r["vtex_store"]) for r in enrich.resolve_candidates(ids, docs).collect()}
    assert got == {"1": ("1-01", "a"), "2": ("2", "c"), "3": ("3-02", "e"), "4-02": ("4-02", "f"), "5": (None, None)}

    at = F.lit("2025-01-02").cast("timestamp_ntz")
    fresh = enrich.as_cache(enrich.resolve_candidates(ids, docs), at)
    old = spark.createDataFrame([("5", "x", "found"), ("9", "y", "error")],
                                "order_id string, vtex_store string, status string")
    cache = enrich.upsert_cache(old.withColumn("fetched_at", F.lit("2025-01-01").cast("timestamp_ntz")), fresh)
    state = {r["order_id"]: (r["vtex_store"], r["status"]) for r in cache.collect()}
    assert state["5"] == (None, "not_found") and state["9"] == ("y", "error") and len(state) == 6
    needed = spark.createDataFrame([("5",), ("9",), ("10",)], "order_id string")
    assert {r[0] for r in enrich.missing_orders(needed, cache).collect()} == {"9", "10"}


def test_attach_enrichment_is_null_for_unknown_orders(spark):
    rows = [(i, " 1 " if i % 3 else None) for i in range(90)] + [(99, "zz")]
    df = spark.createDataFrame(rows, "dispute_id int, vtex_order_id string")
    cache = spark.createDataFrame([("1", "shop")], "order_id string, vtex_store string")
    out = enrich.attach_enrichment(df, cache, ["dispute_id"])
    assert out.count() == 91
    assert out.where("vtex_store = 'shop'").count() == sum(1 for _, o in rows if o == " 1 ")




def test_documents_attach_to_hot_missing_and_dashed_orders(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["1", None, " 2 ", "3-02", "4", "a-b-c", "5-01", "9"] + ["1"] * 6)) for i in range(400)]
    docs = [("1", "plain"), ("1-01", "first"), ("2-02", "second"), ("3-01", "no"), ("3-02", "exact"),
            ("4-03", "other suffix"), ("a-b-c", "free form"), ("5", "not the dashed one")]
    best = {"1": "first", "2": "second", "3-02": "exact", "a-b-c": "free form"}
    expected = Counter((i, best.get(o.strip()) if o else None) for i, o in rows)
    df = spark.createDataFrame(rows, "dispute_id int, vtex_order_id string").repartition(4)
    details = spark.createDataFrame(docs, "order_id string, vtex_store string")
    got = enrich.attach_documents(df, details, ["dispute_id"]).select("dispute_id", "vtex_store")
    assert rows_of(got) == expected


def test_every_key_beyond_an_average_partition_is_found(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        # 100 equal keys hold a third of the rows each ten times an average partition
        hot = spark.range(100_000).selectExpr("concat('h', id % 100) AS k")
        rest = spark.range(200_000).selectExpr("concat('r', id) AS k")
        assert set(profile_key(hot.union(rest), "k").hot) == {f"h{i}" for i in range(100)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("how", ["left", "full"])
@pytest.mark.parametrize("seed", range(4))
def test_fanout_join_against_pairs(spark, how, seed):
    """Keys that are frequent on either side, both or none, null ones, and keys of one side only."""
    rng = random.Random(seed)
    keys = ["A"] * 40 * (seed % 2) + ["B"] * 30 * (seed > 1) + [None] * 20 + [f"k{i}" for i in range(30)]
    other = ["B"] * 40 * (seed % 2) + ["A"] * 6 + [None] * 25 * (seed > 0) + [f"k{i}" for i in range(15, 45)] + ["Z"] * 9 * (seed > 2)
    left = [(i, rng.choice(keys)) for i in range(90)]
    right = [(i, rng.choice(other)) for i in range(80)]
    expected = Counter((i, j) for i, k in left for j, q in right if k is not None and k == q)
    expected += Counter((i, None) for i, k in left if k is None or k not in {q for _, q in right})
    if how == "full":
        expected += Counter((None, j) for j, q in right if q is None or q not in {k for _, k in left})
    got = fanout_join(spark.createDataFrame(left, "i int, lk string"), spark.createDataFrame(right, "j int, rk string"),
                      "lk", "rk", ["i"], ["j"], how)
    assert rows_of(got.select("i", "j")) == expected


def test_outer_match_is_one_join_after_one_profile(spark, disputes, ledger):
    even = disputes.withColumn("psp_reference", F.col("dispute_id").cast("string"))
    postings = ledger.withColumn("psp_reference_sap", F.col("ordinal").cast("string"))
    plan = match.match_ledger_outer(even, postings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("Join") == 1 and "Aggregate" not in plan


def test_documents_are_filtered_before_they_are_parsed(spark):
    rows = spark.createDataFrame([(1, " 7 "), (2, "8-02"), (3, None)], "dispute_id int, vtex_order_id string")
    raw = spark.createDataFrame([(f"{i}{s}", "{}") for i in range(500) for s in ("", "-01", "-02", "-99")] + [(None, "{}")],
                                "order_id string, detail string")
    kept = {r.order_id for r in enrich.wanted_documents(raw, rows).collect()}
    assert {"7", "7-01", "7-02", "8", "8-01", "8-02"} <= kept and len(kept) < 20
    flat = enrich.flatten_part(enrich.wanted_documents(raw, rows), F.col("doc")["hostname"].alias("hostname"))
    plan = enrich.attach_documents(rows, flat, ["dispute_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_repeated_documents_give_one_row(spark):
    rows = spark.createDataFrame([(1, "7"), (2, "7-01")], "dispute_id int, vtex_order_id string")
    docs = spark.createDataFrame([("7-01", "a"), ("7-01", "a"), ("7-01", "b"), ("7", "c")], "order_id string, vtex_store string")
    out = enrich.attach_documents(rows, docs, ["dispute_id"]).collect()
    assert len(out) == 2 and {r.matched_id for r in out} == {"7-01"} and len({r.vtex_store for r in out}) == 1


@pytest.mark.parametrize("bits", [64, 1024])
def test_likely_members_loses_no_member(spark, bits):
    df, members = spark.range(3000).selectExpr("concat('k', id) AS k"), spark.range(0, 3000, 100).selectExpr("concat('k', id) AS m")
    kept = {r.k for r in likely_members(df, F.col("k"), members, F.col("m"), bits).collect()}
    assert {f"k{i}" for i in range(0, 3000, 100)} <= kept
    assert bits == 64 or len(kept) < 300
    assert likely_members(df, F.col("k"), members.where("1 = 0"), F.col("m")).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_parsed_from_documents_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1, '{"orderId":" 7 "}'), (2, "{bad"), (3, '{"orderId":" "}'), (4, '{"orderId":"7"}'), (5, None)],
                          "dispute_id int, metadata string").write.parquet(path)
    rows = feeds.extract_order_id(spark.read.parquet(path))
    ids = feeds.valid_order_ids(rows)
    assert [tuple(r) for r in ids.collect()] == [("7",)]
    assert _plan(feeds.valid_order_ids(rows)).count("get_json_object(") == 1
    raw = spark.createDataFrame([("7-01", "{}"), ("8", "{}"), (None, "{}")], "order_id string, detail string")
    wanted = enrich.wanted_documents(raw, rows)
    assert _plan(wanted).count("get_json_object(") == 1
    assert "7-01" in {r.order_id for r in wanted.collect()}


def test_only_the_named_keys_are_profiled(spark):
    rows = spark.createDataFrame(skewed_disputes(), DISPUTE)
    some, every = match.profile_disputes(rows, "reference", "base_order"), match.profile_disputes(rows)
    assert some.order is None and (some.reference, some.base_order) == (every.reference, every.base_order)
    assert some.reference.hot == ("HOT",)
