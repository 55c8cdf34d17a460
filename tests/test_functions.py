from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyweave import constants as C
from tallyweave.functions import dates, numbers, text
from tallyweave.operators import feeds

CODE = "ABCD1234EFGH5678"


def test_order_id_from_metadata(values):
    cases = ['{"orderId": "42-01"}', '{"orderId": 42}', '{"x": 1}', "[1]", "null", "{bad", "", None]
    assert values(text.order_id_from_metadata, cases) == ["42-01", "42"] + [None] * 6


def test_narrative_codes(values):
    cases = [
        f"CHARGEBACK NSU: {CODE}-991", f"NSU{CODE}", f"NSU: {CODE[:15]}", f"NSU: {CODE}Z",
        f"nsu: {CODE}", f"NSU – {CODE}", f"NSU {CODE} NSU ZZZZ1234EFGH5678", "NSUé" + CODE, None,
    ]
    assert values(text.psp_reference, cases) == [
        CODE, CODE, None, CODE, None, CODE, CODE, None, None]
    assert values(text.nsu_suffix, [f"NSU: {CODE}-991", f"{CODE}", f"{CODE} - A1 ", CODE + "77", None]) == [
        "991", None, None, "77", None]


def test_mentions_ignores_case_and_null(values):
    assert values(text.mentions, ["x chargeback y", "ChargeBack", "estorno", None]) == [True, True, False, False]


def test_order_key_prefix(values):
    assert values(text.order_key_prefix, [" 12 -x", "12", "-5", "a-b-c", None]) == ["12", "12", "", "a", None]


@pytest.mark.parametrize("word", C.PICKUP_WORDS)
def test_every_pickup_word(values, word):
    assert values(text.classify_delivery, [f"x {word.upper()} y"]) == [C.PICKUP]


@pytest.mark.parametrize("word", C.HOME_WORDS)
def test_every_home_word(values, word):
    assert values(text.classify_delivery, [f"x {word.upper()} y"]) == [C.HOME]


def test_delivery_rules_differ(values):
    cases = ["Clique e Retire", "Entrega com retirada", "Motoboy", "", "  ", "nan", "SEDEX", None]
    assert values(text.classify_delivery, cases) == [
        C.PICKUP, C.PICKUP, "Motoboy", None, None, None, C.HOME, None]
    # "Clique e Retire" holds no "retira", and blanks are a value for the dashboard
    assert values(text.classify_delivery_dash, cases) == [
        C.OTHER, C.PICKUP, C.OTHER, None, C.OTHER, None, C.OTHER, None]


def test_categories_split(values):
    assert values(text.split_categories, ["a | b||  |c ", "", None]) == [["a", "b", "c"], [], None]


def test_truncate_after_width(values):
    assert values(text.truncate_label, ["é" * 70, "short"]) == ["é" * 60, "short"]


def test_provenance(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    labels = [r[0] for r in rows.select(text.provenance(F.col("a"), F.col("b"))).collect()]
    assert labels == ["Adyen + SAP + ClearSale", "Adyen + SAP", "Adyen + ClearSale", "Adyen"]


def test_numbers(values, spark):
    assert values(numbers.try_numeric, ["1.5", " 2 ", "n/d", "", None]) == [1.5, 2.0, None, None, None]
    assert values(numbers.cents_to_amount, [150, 0, None], "bigint") == [1.5, 0.0, 0.0]
    row = spark.createDataFrame([(1, 3), (0, 0)], "a bigint, b bigint")
    assert [r[0] for r in row.select(numbers.percent(F.col("a"), F.col("b"))).collect()] == [33.3, 0.0]


def test_month_label(values):
    assert values(dates.month_label, ["2025-01", "2025-12", "2026-05", "x", None]) == [
        "Jan/25", "Dez/25", "Mai/26", None, None]


def test_month_bounds_wrap_the_year():
    assert dates.month_bounds("2025-12", "2025-12") == (datetime(2025, 12, 1), datetime(2026, 1, 1))
    assert dates.month_bounds(None, "2026-01") == (None, datetime(2026, 2, 1))


def test_in_months(spark):
    days = [datetime(2024, 12, 31, 23, 59, 59), datetime(2025, 1, 1), datetime(2025, 2, 28, 12), datetime(2025, 3, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, record_date timestamp_ntz")

    def kept(start, end):
        return sorted(r["i"] for r in feeds.month_range_filter(df, start, end).collect())

    assert kept("2025-01", "2025-02") == [1, 2]
    assert kept(None, "2024-12") == [0]
    assert kept("2025-03", None) == [3]
    assert kept(None, None) == [0, 1, 2, 3]
    assert kept("2024-12", "2025-01") == [0, 1]


def test_parse_utc(values):
    assert values(dates.parse_utc, [
        "2026-04-20T10:00:00Z", "2026-04-20T10:00:00+02:00", "2026-04-20", "soon", None,
    ]) == [datetime(2026, 4, 20, 10), datetime(2026, 4, 20, 8), datetime(2026, 4, 20), None, None]


def test_dates_follow_their_file(spark):
    rows = [
        (1, "slash", "01/02/2025", "2025-02-01"), (2, "slash", "2025-02-03", "2025-02-03 04:05:06"),
        (3, "slash", "13/01/2025 10:30", None), (4, "slash", "01/13/2025", "x"),
        (5, "iso", "2025-03-04", "2025-03-04T01:02:03"), (6, "iso", "soon", ""), (7, "iso", None, "03-04-2025"),
    ]
    df = spark.createDataFrame(rows, "i int, f string, a string, b string")
    got = {r["i"]: (r["a"], r["b"]) for r in feeds.normalize_mixed_dates(df, ["a", "b"], "f", ["i"]).collect()}
    assert got == {
        1: (datetime(2025, 2, 1), datetime(2025, 2, 1)),
        2: (datetime(2025, 2, 3), datetime(2025, 2, 3, 4, 5, 6)),
        3: (datetime(2025, 1, 13, 10, 30), None),
        4: (datetime(2025, 1, 13), None),
        5: (datetime(2025, 3, 4), datetime(2025, 3, 4, 1, 2, 3)),
        6: (None, None),
        7: (None, datetime(2025, 3, 4)),
    }


def test_resolve_column():
    cols = ["Denominação do objeto", "Denominação", "Data de Entrada", "Dt.lançamento", "Montante em MI"]
    assert feeds.resolve_column(cols, ["Denomina"], ["objeto"]) == "Denominação"
    assert feeds.resolve_column(cols, ["entrada"], ignore_case=True) == "Data de Entrada"
    assert feeds.resolve_column(cols, ["Valor", "Montante"]) == "Montante em MI"
    assert feeds.resolve_column(cols, ["Saldo"]) is None


def test_prefix_and_move(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`vtex_order_id` int, `STATUS DO X` int, Score int")
    prefixed = feeds.prefix_columns(df, "cs_", keep=("vtex_order_id",))
    assert prefixed.columns == ["vtex_order_id", "cs_status_do_x", "cs_score"]
    assert feeds.move_to_front(prefixed, ["cs_score", "none"]).columns == [
        "cs_score", "vtex_order_id", "cs_status_do_x"]


def test_other_date_texts(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from tallyweave.functions import dates

    cases = {
        "2025/01/31": datetime(2025, 1, 31), "31/01/2025 10:00:00.250": datetime(2025, 1, 31, 10, 0, 0, 250000),
        "31/1/25": datetime(2025, 1, 31), "31/1/70": datetime(1970, 1, 31), "31 Jan 2025": datetime(2025, 1, 31),
        "20250131": datetime(2025, 1, 31), "01/31/2025 10:00 PM": datetime(2025, 1, 31, 22),
        "1/2/2025 12:05 am": datetime(2025, 2, 1, 0, 5), "January 31, 2025": datetime(2025, 1, 31),
        "2025-1-3 5:07": datetime(2025, 1, 3, 5, 7), "31-01-2025": datetime(2025, 1, 31), "20251341": None,
        "32/13/2025": None, "soon": None, "": None, "12345": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["d"] for r in rows.withColumn("d", dates.parse_mixed_date("v", F.lit(True))).collect()}
    assert got == cases
    number = spark.createDataFrame([("45000.25",), ("123",), ("x",), (None,)], "v string")
    assert [r[0] for r in number.select(dates.parse_day_number("v")).collect()] == [
        datetime(2023, 3, 15, 6), None, None, None]


@pytest.mark.parametrize("day_first", [True, False])
def test_days_without_a_time_are_turned_round_at_once(values, spark, day_first):
    texts = ["3/1/2025", "03.01.2025", "31-1-2025", "1/31/2025", "32/1/2025", "29/2/2023", "3/1/2025 10:00"]
    a, b = (datetime(2025, 1, 3), datetime(2025, 3, 1)) if day_first else (datetime(2025, 3, 1), datetime(2025, 1, 3))
    late = datetime(2025, 1, 31)
    expected = [a, a, late, late, None, None, a.replace(hour=10)]
    assert values(lambda c: dates.parse_mixed_date(c, F.lit(day_first)), texts) == expected
    plan = spark.range(1).select(dates._from_day(F.col("id").cast("string"), F.lit(day_first)))
    assert "regexp_extract" not in plan._jdf.queryExecution().optimizedPlan().toString()
