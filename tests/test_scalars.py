from decimal import Decimal

from pyspark.sql import functions as F

from folia.functions import scalars as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def lit(x):
    return F.lit(x)


def test_labels(spark):
    assert one(spark, S.label_key(lit("  Advertiser &  Client, Inc. ")), S.label_name(lit("Line Item - Start Data")), S.label_name(lit("line item - start data"), as_key=True)) == ("advertiser_and_client_inc", "Line Item - Start Date", "line_item_start_date")
    assert one(spark, S.normal_bio(lit("B-Gross Amount")), S.normal_bio(lit("O")), S.normal_bio(lit("X-a"))) == ("B-gross_amount", "O", None)
    assert one(spark, S.is_money(lit("Corporate Name")), S.is_money(lit("Internet")), S.is_date(lit("Start Date")), S.is_money(lit("Agency"))) == (True, True, True, False)
    assert one(spark, S.is_line_item(lit("Line Item - Rate")), S.without_line_item(lit("Line Item - Rate"))) == (True, "rate")


def test_money(spark):
    cases = {"$150.00P-2": "150.00", "$2,000.00P-1": "2000.00", "900.00P-2": "900.00", "($1,234.50)": "-1234.50", "-$5": "-5", "none": "none", "": "", "USD 5 and (7)": "-7", "+$ 3.10": "3.10", "a,b$": "ab"}
    for text, want in cases.items():
        assert one(spark, S.money(lit(text))) == (want,), text
    assert one(spark, S.money(lit("($1,234.50)"), True), S.without_ocr_suffix(lit("$150.00P-2")), S.without_ocr_suffix(lit("7p12"))) == ("-1,234.50", "$150.00", "7")
    assert one(spark, S.decimal_text(lit("007.50")), S.decimal_text(lit("x"))) == (str(Decimal("7.50")), "x")


def test_matching(spark):
    assert one(spark, S.loose_match(lit("Gross Amount"), lit("150.00"), lit("$150.00P-2")), S.loose_match(lit("Agency"), lit(""), lit("")), S.loose_match(lit("Agency"), lit(""), lit("a")), S.loose_match(lit("Agency"), lit("A-b"), lit("xabx"))) == (True, True, False, True)
    assert one(spark, S.exact_match(lit("Invoice Date"), lit("1 May 2020"), lit("1May 2020")), S.extracted_form(lit("Agency"), lit(" a – b ")), S.matching_form(lit("Agency"), lit(None).cast("string"))) == (True, "a - b", "")


def test_geometry(spark):
    row = spark.createDataFrame([(5, 15, 2000, 25, 1000, 2000), (1, 2, 3, 4, None, 10)], "x0 int, y0 int, x1 int, y1 int, page_width int, page_height int")
    made = row.select(*S.normal_box().values(), *S.box_features().values()).collect()
    assert tuple(made[0])[:4] == (5, 8, 1000, 12)  # 7.5 and 12.5 go to the even neighbour
    assert all(v is None for v in made[1])
    assert one(spark, S.bucket(lit(999)), S.bucket(lit(1000)), S.bucket(lit(-5)), S.real_side(lit(500), lit(1001))) == (99, 99, 0, 500)
    boxes = spark.createDataFrame([((0, 0, 10, 10), (5, 0, 15, 10)), ((0, 0, 0, 0), (0, 0, 0, 0))], "a struct<x0:int,y0:int,x1:int,y1:int>, b struct<x0:int,y0:int,x1:int,y1:int>")
    assert [round(r[0], 4) for r in boxes.select(S.iou("a", "b")).collect()] == [0.3333, 0.0]


def test_layout_tokens(spark):
    assert one(spark, S.layout_token(lit("compact_bbox")), S.layout_token(lit("coord_suffix")), S.layout_token(lit("unseen"))) == ("[LAYOUT_BBOX]", "[LAYOUT_COORD]", "[LAYOUT_UNKNOWN]")
    assert len(set(S.ROLE_TOKENS.values())) < 32
    assert one(spark, S.safe_name(lit("a b/ç-1.x"))) == ("a_b_ç-1.x",)
