from pyspark.sql import functions as F

from linkstrata.functions import text as X
from linkstrata.operators.companies import selected_taxonomy, taxonomy_paths, taxonomy_role_coverage


def values(spark, items, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_tree_label(spark):
    given = ["白酒Ⅰ", "白酒Ⅱ", "白酒Ⅲ", "LEDⅢ", "综合 III", "维生素B", "ＡＢ　Ｃ", None]
    assert values(spark, given, X.tree_label) == ["白酒", "白酒", "白酒", "LED", "综合", "维生素B", "AB C", ""]


def test_match_label(spark):
    assert values(spark, ["白 酒Ⅱ", "LED Ⅲ", "Ⅱ型 A"], X.match_label) == ["白酒", "led", "ⅱ型a"]


def test_process_step_names(spark):
    given = ["原料清洗", "发酵乳", "发酵设备", "灌装包装设备", "包装工艺", "工艺品", "白酒"]
    assert values(spark, given, X.looks_like_process_step) == [True, False, False, False, True, False, False]


def test_three_valued_flag(spark):
    assert values(spark, [None, " ", "1", "TRUE", "y", "no", "0"], X.three_valued_flag) == [None, None, True, True, True, False, False]


def test_delivery_id(spark):
    given = ["food_001_002", "food_1002_3", "food_7", "x_1"]
    make = lambda c: X.delivery_id(c, F.lit("food"), F.lit("F"), strict=False)
    assert values(spark, given, make) == ["F001002", "F1002003", "F000007", None]


def test_grams(spark):
    got = values(spark, ["abca", "ab", "a", ""], lambda c: F.array_sort(X.grams(c)))
    assert got == [["ab", "abc", "bc", "bca", "ca"], ["ab"], [], []]


def test_clamp_and_quality(spark):
    assert values(spark, ["2", "-1", "x", None, "0.4"], X.clamp_confidence) == [1.0, 0.0, 0.75, 0.75, 0.4]
    none = F.array().cast("array<string>")
    passed = lambda c: X.quality_passed(F.lit("Pass"), c, none, none)
    assert values(spark, ["80", "79", "high", None], passed) == [True, False, False, False]


def test_url_scheme(spark):
    assert values(spark, ["https://a", "HTTP://b", "ftp://c", "nothing", None], X.has_http_scheme) == [True, True, False, False, False]


def test_taxonomy_paths_fold_equal_levels(spark):
    white = ("白酒Ⅲ", "食品饮料", "白酒Ⅱ", "白酒Ⅲ")
    source = spark.createDataFrame([white, white, ("调味发酵品Ⅲ", "食品饮料", "调味发酵品Ⅱ", "调味发酵品Ⅲ")], "indunamesw string, indunamesw1 string, indunamesw2 string, indunamesw3 string")
    table = {r["indunamesw_path"]: r for r in taxonomy_paths(source).collect()}
    assert set(table) == {"食品饮料 > 白酒", "食品饮料 > 调味发酵品"}
    row = table["食品饮料 > 白酒"]
    assert (row["level"], row["indunamesw2"], row["indunamesw3"], row["occurrence_count"]) == (2, "白酒", "", 2)
    assert (row["raw_leaf_names"], row["raw_paths"]) == ("白酒Ⅲ", "食品饮料 > 白酒Ⅱ > 白酒Ⅲ")


def test_selection_needs_paths_of_the_tree(spark):
    tree = spark.createDataFrame([("白酒", 2, "食品饮料 > 白酒"), ("餐饮", 3, "社会服务 > 酒店餐饮 > 餐饮")], "indunamesw string, level int, indunamesw_path string")
    chosen = spark.createDataFrame(
        [("t", 0, "食品饮料 > 白酒", "核心品类", "core"), ("t", 1, "食品饮料 > 虚构", "x", "core"), ("t", 2, "社会服务 > 酒店餐饮 > 餐饮", "", "Downstream"), ("t", 3, "食品饮料 > 白酒", "again", "support")],
        "industry_id string, pos int, path string, reason string, suggested_role string")
    valid = selected_taxonomy(chosen, tree)
    assert sorted((r["path"], r["name"], r["suggested_role"]) for r in valid.collect()) == [("社会服务 > 酒店餐饮 > 餐饮", "餐饮", "downstream"), ("食品饮料 > 白酒", "白酒", "core")]
    cover = taxonomy_role_coverage(valid).collect()[0]
    assert (cover["core"], cover["downstream"], cover["missing_roles"]) == (1, 1, "upstream")


def test_white_space_of_any_kind(spark):
    odd = ["\t1001　", " x y\x1f", "\xa0 ", "a b", None]
    assert values(spark, odd, X.strip) == ["1001", "x y", "", "a b", None]
    assert values(spark, odd, X.normalized_name) == ["1001", "xy", "", "ab", None]
    assert values(spark, ["Straße A", "ΟΔΟΣ Ⅱ"], X.match_label) == ["strassea", "οδοσ"]
    assert values(spark, ["yes\t", "　N", " "], X.three_valued_flag) == [True, False, None]


def test_verdicts_after_any_line_end(spark):
    from linkstrata.sources.responses import parse_verdicts

    a, b, c = (f"p_{d * 16}" for d in "abc")
    rows = spark.createDataFrame([("1", f"　{a}:A_TO_B\x0b{b} : no {c}: b_to_a　")], "batch_id string, raw_response string")
    wanted = spark.createDataFrame([("1", p) for p in (a, b, c)], "batch_id string, pair_id string")
    assert sorted(tuple(r) for r in parse_verdicts(rows, wanted).collect()) == [("1", a, "A_TO_B"), ("1", b, "NO"), ("1", c, "B_TO_A")]
