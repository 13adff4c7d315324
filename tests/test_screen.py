import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finscan.functions import fields as C
from finscan.functions.predicates import apply_filters
from finscan.operators.screen import ScanEngine
from finscan.plans.spec import Filter, ScanQuery, SortKey
from finscan.sources import views

DATA = "/root/testdata/sf0.001"
ROWS = [
    ("X:A", "alpha", 10.0, 1.0, "stock", "america", ["a", "b"], 5.0),
    ("X:B", "Beta", 20.0, None, "stock", "america", ["c"], None),
    ("X:C", "", None, -3.0, "fund", "america", None, 7.0),
    ("Y:D", None, 20.0, 2.0, "stock", "uk", [], 9.0),
    ("Y:E", "alphabet", 0.0, 0.0, None, None, ["a"], 0.0),
]
SCHEMA = "symbol string, name string, close double, change double, type string, market string, tags array<string>, market_cap_basic double"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def hits(table, *filters):
    return sorted(r.symbol for r in apply_filters(table, filters).collect())


def test_each_operation_leaves_nulls_out(table):
    assert hits(table, Filter("close", "greater", 10)) == ["X:B", "Y:D"]
    assert hits(table, Filter("close", "less", 10)) == ["Y:E"]
    assert hits(table, Filter("close", "egreater", 20)) == ["X:B", "Y:D"]
    assert hits(table, Filter("close", "eless", 10)) == ["X:A", "Y:E"]
    assert hits(table, Filter("close", "equal", 20)) == ["X:B", "Y:D"]
    assert hits(table, Filter("close", "nequal", 20)) == ["X:A", "Y:E"]
    assert hits(table, Filter("close", "in_range", [0, 10])) == ["X:A", "Y:E"]
    assert hits(table, Filter("close", "not_in_range", [0, 10])) == ["X:B", "Y:D"]
    assert hits(table, Filter("close", "above", {"field": "market_cap_basic"})) == ["X:A", "Y:D"]
    assert hits(table, Filter("close", "below", {"field": "market_cap_basic"})) == []
    assert hits(table, Filter("tags", "has", ["a"])) == ["X:A", "Y:E"]
    assert hits(table, Filter("tags", "has_none_of", ["a"])) == ["X:B", "Y:D"]
    assert hits(table, Filter("type", "has", ["fund"])) == ["X:C"]
    assert hits(table, Filter("type", "has_none_of", ["fund"])) == ["X:A", "X:B", "Y:D"]
    assert hits(table, Filter("name", "match", "ALPHA")) == ["X:A", "Y:E"]
    assert hits(table, Filter("name", "nempty")) == ["X:A", "X:B", "Y:E"]
    assert hits(table, Filter("close", "nempty")) == ["X:A", "X:B", "Y:D", "Y:E"]
    assert hits(table, Filter("close,change", "in_range", [1, 10])) == ["X:A", "Y:D"]
    assert hits(table, Filter("type", "in_range", ["fund", "bond"])) == ["X:C"]


OPS = {"greater": lambda a, b: a > b, "less": lambda a, b: a < b, "egreater": lambda a, b: a >= b, "eless": lambda a, b: a <= b, "equal": lambda a, b: a == b, "nequal": lambda a, b: a != b}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["close", "change", "market_cap_basic"]), st.sampled_from(sorted(OPS)), st.integers(-5, 25)), max_size=3))
def test_conjunctions_agree_with_three_valued_logic(table, parts):
    at = {"close": 2, "change": 3, "market_cap_basic": 7}
    want = sorted(r[0] for r in ROWS if all(r[at[c]] is not None and OPS[o](r[at[c]], v) for c, o, v in parts))
    assert hits(table, *(Filter(*p) for p in parts)) == want


def test_crossings(spark):
    close = [1.0, 3.0, 3.0, 1.0, 2.0, None, 4.0]
    rows = spark.createDataFrame([("S", i, c, 2.0) for i, c in enumerate(close)], "symbol string, bar int, close double, line double")
    found = lambda op: [r.bar for r in apply_filters(rows, (Filter("close", op, {"field": "line"}),), order="bar").orderBy("bar").collect()]
    assert found("crosses_above") == [1]
    assert found("crosses_below") == [3]
    assert found("crosses") == [1, 3]


def test_order_ranges_and_defaults(table):
    e = ScanEngine(table)
    ordered = [r.symbol for r in e.screen("global", sort_by="close").rows.collect()]
    assert ordered == ["X:B", "Y:D", "X:A", "Y:E", "X:C"]
    assert [r.symbol for r in e.screen("global", sort_by="close", sort_order="asc", limit=2, start=1).rows.collect()] == ["X:A", "X:B"]
    assert e.screen("america", columns=[]).rows.columns == ["symbol", *C.STOCK_DEFAULT]
    assert e.screen("america", columns=["close", "symbol", "close"]).rows.columns == ["symbol", "close"]
    r = e.screen("global", [{"left": "close", "operation": "greater", "right": 0}], limit=1)
    assert (r.total(), r.total_count()) == (1, 3)
    assert e.screen("uk", [Filter("close", "greater", 99)]).envelope() == {"status": "success", "data": [], "total": 0, "totalCount": 0}
    assert e.top_stocks("uk").rows.count() == 1
    assert e.symbol_markets("alpha").rows.count() == 2


def test_errors(table):
    e = ScanEngine(table)
    for call in (
        lambda: e.screen("atlantis"),
        lambda: e.screen("america", columns=["nonsense"]),
        lambda: e.screen("america", [Filter("nonsense", "greater", 1)]),
        lambda: Filter("close", "almost", 1),
        lambda: Filter("close", "in_range", 3),
        lambda: SortKey("close", "up"),
        lambda: ScanQuery((), start=5, end=2),
        lambda: e.movers("stocks-usa", "nonsense"),
        lambda: e.top_stocks("america", "nonsense"),
        lambda: e.symbol_markets("A", scanner="mars"),
        lambda: C.symbol_of("AAPL"),
        lambda: C.symbol_of(""),
    ):
        with pytest.raises(ValueError):
            call()
    assert C.symbol_of(" nyse:tsla ") == "NYSE:TSLA"
    assert e.movers("crypto", "nonsense").rows.count() == 5


def test_presets(table):
    e = ScanEngine(table)
    assert [r.symbol for r in e.movers("stocks-usa", "losers", ["change"]).rows.collect()] == ["X:C"]
    assert [r.symbol for r in e.movers("crypto", "penny-stocks", ["close"]).rows.collect()] == ["Y:E"]


def test_comparison_and_snapshots(table):
    e = ScanEngine(table)
    long = {(r.field, r.symbol): r.value for r in e.compare(["x:a", "Y:D", "Z:Z"], ["close", "EBITDA"]).collect()}
    assert long == {("close", "X:A"): 10.0, ("close", "Y:D"): 20.0, ("EBITDA", "X:A"): None, ("EBITDA", "Y:D"): None}
    wide = {r["field"]: (r["X:A"], r["Z:Z"]) for r in e.compare_wide(["X:A", "Z:Z"], ["close"]).collect()}
    assert wide == {"close": (10.0, None)}
    assert len(e.snapshot("X:A").columns) == 67
    assert len(e.fundamentals("X:A").columns) == 61
    assert e.overview("X:A", "technicals").columns[1:] == C.OVERVIEW["technical"] + C.OVERVIEW["volatility"]
    assert e.snapshot("Q:Q").count() == 0


def test_catalogue_sizes():
    assert (len(C.OVERVIEW_ALL), len(C.FUNDAMENTALS_ALL), len(C.INDICATORS), len(C.QUOTE_FIELDS), len(C.EARNINGS_CALENDAR)) == (66, 60, 81, 23, 22)
    assert len(set(C.INDICATORS)) == 81 and len(C.TIMEFRAMES) == 10 and len(C.LANGUAGES) == 21 and len(C.PROVIDERS) == 15
    assert not C.all_known([], C.AREAS) and C.all_known(["asia"], C.AREAS) and not C.all_known(["asia", "x"], C.AREAS)


def test_plans_push_down_and_take_the_top(spark):
    e = ScanEngine(views.instruments(spark, DATA))
    plan = e.screen("global", [Filter("close", "greater", 100)], ["close"], "close").rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(p_retailprice), GreaterThan(p_retailprice,100.0)" in plan
    assert "p_name" not in plan.split("ReadSchema")[1]


def test_registry_checks(spark, table):
    symbols = spark.createDataFrame([(" x:a ",), ("Q:Q",)], "symbol string")
    e = ScanEngine(table)
    assert [r.symbol for r in e.existing(symbols).collect()] == ["X:A"] and [r.symbol for r in e.missing(symbols).collect()] == ["Q:Q"]
    assert list(itertools.chain(*C.OVERVIEW.values())) == C.OVERVIEW_ALL
    assert table.where(F.col("symbol").isNull()).count() == 0
