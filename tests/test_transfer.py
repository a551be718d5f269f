"""Rows with and without transfer, and which plans engage."""

import itertools
import random

import duckdb
import pytest

from sluice.catalogue import SQL
from sluice.functions.settings import Settings
from sluice.plans.metrics import measure
from sluice.session import TransferSession
from sluice.sources.tables import register

SF = "/root/testdata/sf0.001"
POSITIVE = ["null_keys", "null_keys_star", "chain3", "chain4", "star4", "bushy5", "having_in_subquery", "agg_below_join"]
NEGATIVE = ["two_way_join", "cycle_triangle", "cycle4", "theta_only", "theta_plus_equi", "tpch_q5", "tpch_q6"]


@pytest.fixture(scope="module")
def session(spark):
    register(spark, SF)
    t = TransferSession(spark)
    with t.settings(minProbeBytes=0):
        yield t


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_plain_spark(session, name):
    got = session.sql(SQL[name])
    assert rows(got) == rows(session.spark.sql(SQL[name])), session.last_reason
    assert not session.last_reason or session.last_reason[0].islower(), session.last_reason


@pytest.mark.parametrize("name", POSITIVE)
@pytest.mark.parametrize("heuristic", ["join_order", "largest_root"])
def test_filters_appear(session, name, heuristic):
    with session.settings(heuristic=heuristic):
        text = session.explain_transfer(SQL[name], stats=False)  # whatever the redundancy test may drop
    assert "CREATE_FILTER" in text and "PROBE_FILTER" in text


@pytest.mark.parametrize("name", NEGATIVE)
def test_filters_do_not_appear(session, name):
    assert "CREATE_FILTER" not in session.explain_transfer(SQL[name])


@pytest.mark.parametrize("local", [0, 8 << 20])
@pytest.mark.parametrize("heuristic,mode,flip,kind", list(itertools.product(["join_order", "largest_root"], ["both", "forward_only"], [True, False], ["all", "bf_only", "minmax_only"])))
def test_every_setting_gives_the_same_sums(session, heuristic, mode, flip, kind, local):
    with session.settings(heuristic=heuristic, passMode=mode, flipRoots=flip, filterType=kind, localBuildBytes=local):
        for name in ("null_keys", "null_keys_star"):
            assert tuple(session.sql(SQL[name]).first()) == duckdb.sql(SQL[name]).fetchall()[0]
            assert session.last_profile()


@pytest.mark.parametrize("local", [0, 8 << 20])
def test_two_column_keys(session, local):
    """Pairs that match in each column alone but not together."""
    s = session.spark
    s.range(3000).selectExpr("id % 60 day", "id % 7 shop", "id price").createOrReplaceTempView("sales")
    s.range(400).selectExpr("id % 90 day", "id % 5 shop", "id seen").createOrReplaceTempView("visits")
    s.range(1, 90, 4).selectExpr("id day", "id * 3 open").createOrReplaceTempView("days")
    q = "select count(*), sum(price), sum(seen), sum(open) from sales join visits on sales.day = visits.day and sales.shop = visits.shop join days on sales.day = days.day"
    want = tuple(s.sql(q).first())
    assert want[0] > 0
    for heuristic, mode, t in itertools.product(["join_order", "largest_root"], ["both", "forward_only"], [5, 50]):
        with session.settings(heuristic=heuristic, passMode=mode, inListThreshold=t, localBuildBytes=local):
            assert tuple(session.sql(q).first()) == want and session.last_profile()


def test_redundant_pairs(session):
    """Whole dimensions whose keys hold all of the facts' build nothing; where some facts have no partner the filters stay."""
    s = session.spark
    s.range(70).selectExpr("id shop").createOrReplaceTempView("shops")
    s.range(30).selectExpr("id item").createOrReplaceTempView("items")
    s.range(70).where("id % 5 <> 1").selectExpr("id shop").createOrReplaceTempView("some_shops")
    s.range(30).where("id % 4 = 0").selectExpr("id item").createOrReplaceTempView("some_items")
    s.range(8400).selectExpr("id % 70 shop", "id % 30 item", "id v").createOrReplaceTempView("facts")
    whole = "select count(*) from facts join shops on facts.shop = shops.shop join items on facts.item = items.item"
    some = "select count(*) from facts join some_shops x on facts.shop = x.shop join some_items y on facts.item = y.item"
    want = s.sql(some).first()[0]
    for mode in ("both", "forward_only"):
        with session.settings(passMode=mode):
            assert session.sql(whole).first()[0] == 8400 and not session.last_profile()
            assert "redundant" in session.explain_transfer(whole)
            assert session.sql(some).first()[0] == want and session.last_profile()
            with session.settings(removeRedundantPairs=False):
                assert session.sql(whole).first()[0] == 8400 and session.last_profile()


@pytest.mark.parametrize("local", [0, 8 << 20])
def test_filter_kinds_at_the_threshold(session, local):
    q = "select count(*) from lineitem join orders on l_orderkey = o_orderkey join (select * from range({})) d on o_custkey = d.id"
    for n, kinds in ((1, {"="}), (50, {"min/max"}), (51, {"min/max", "bloom"})):
        with session.settings(passMode="forward_only", removeRedundantPairs=False, heuristic="largest_root", localBuildBytes=local):
            session.sql(q.format(n))
        first = next(e for e in session.last_profile() if e["build"] == "Range")
        assert set(first["filters"]) == kinds, first


def test_empty_build_stops_siblings(session):
    session.sql(SQL["filter_empty"]).collect()
    assert any("always false" in e["filters"] for e in session.last_profile())


def test_settings_are_checked(session):
    with session.settings(heuristic="none"), pytest.raises(ValueError):
        Settings.of(session.spark)


def test_small_relations_stay_alone_by_default(session):
    with session.settings(minProbeBytes=10 << 20):
        session.sql(SQL["chain3"])
        assert not session.last_profile() and session.last_reason


@pytest.mark.parametrize("seed", range(8))
def test_random_join_trees(session, seed):
    """Random acyclic join graphs with all join types and null keys: the rows of plain Spark, from local builds and from aggregated summaries."""
    rng, s = random.Random(seed), session.spark
    n = rng.randint(3, 6)
    for i in range(n):
        data = [(rng.choice([None, *range(12)]), rng.choice([None, *range(8)]), rng.randint(0, 99)) for _ in range(rng.choice([5, 20, 60]))]
        s.createDataFrame(data, f"a{i} int, b{i} int, v{i} int").createOrReplaceTempView(f"r{i}")
    sql = f"(select * from r0 where v0 < {rng.choice([30, 60, 100])})"
    shown = [0]
    for i in range(1, n):
        how, on = rng.choice(["join", "join", "join", "left join", "right join", "full join", "left semi join", "left anti join"]), rng.choice(shown)
        key = rng.choice("ab")
        sql = f"(select * from {sql} x{i} {how} (select * from r{i} where v{i} < {rng.choice([40, 100])}) y{i} on {key}{on} = {rng.choice('ab')}{i})"
        if "semi" not in how and "anti" not in how:
            shown.append(i)
    q = f"select * from {sql} z"
    want = rows(s.sql(q))
    for local, heuristic in itertools.product([0, 8 << 20], ["join_order", "largest_root"]):
        with session.settings(localBuildBytes=local, heuristic=heuristic, removeRedundantPairs=False):
            assert rows(session.sql(q)) == want and (not session.last_reason or session.last_reason[0].islower()), (q, session.last_reason)


def test_failing_jobs_come_through(session):
    """A job that fails while filters are built isn't taken for a plan without transfers."""
    s = session.spark
    s.range(40).selectExpr("id", "raise_error('broken') broken").createOrReplaceTempView("broken")
    q = "select count(*) from lineitem join orders on l_orderkey = o_orderkey join (select id from broken where broken is null) b on o_custkey = b.id"
    with pytest.raises(Exception, match="broken"):
        session.sql(q)


def test_unordered_limits_build_only_from_their_own_rows(session):
    q = SQL["limit_unordered"]
    with session.settings(localBuildBytes=0, removeRedundantPairs=False):
        session.sql(q)
        assert all(e["build"] != "orders" for e in session.last_profile())
    with session.settings(removeRedundantPairs=False):
        assert session.sql(q).first()[0] == 100


def test_explain_lists_what_runs(session):
    for name in ("chain4", "star4", "bushy5", "redundant_dense"):
        text = session.explain_transfer(SQL[name])
        session.sql(SQL[name])
        assert text.count("PROBE_FILTER") == len(session.last_profile())


def test_cost_rules(session):
    """With joins that shuffle, selective small builds reach a large probe side; nothing is built from it or without a predicate."""
    s = session.spark
    threshold = s.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with session.settings(minProbeBytes=64 << 20, minShuffledProbeBytes=10_000):
            assert rows(session.sql(SQL["chain4"])) == rows(s.sql(SQL["chain4"]))
            steps = [(e["build"], e["probe"]) for e in session.last_profile()]
            assert ("orders", "lineitem") in steps and all(b != "lineitem" for b, _ in steps) and session.last_jobs
            session.sql(SQL["redundant_dense"])
            assert not session.last_profile()
    finally:
        s.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_profile_counts_rows(session, capsys):
    with session.settings(profiling=True, removeRedundantPairs=False):
        session.sql(SQL["chain4"])
    e = next(e for e in session.last_profile() if e["probe"] == "lineitem")
    assert 0 <= e["rows_out"] <= e["rows_in"] and "rows in" in capsys.readouterr().out


def test_drawn_graphs(session):
    with session.settings(heuristic="largest_root"):
        assert "`- " in session.explain_transfer(SQL["chain4"], stats=False)
    assert "(root)" in session.explain_transfer(SQL["chain4"], stats=False)


def test_idle_predicates_and_composite_keys_are_redundant(session, tmp_path):
    """A predicate that holds for every row doesn't filter, and a key of two columns is proved by its pairs, not by each column alone."""
    s = session.spark
    s.range(60).selectExpr("id % 6 a", "id div 6 b", "id v").write.parquet(str(tmp_path / "pairs"))
    s.range(60).where("id % 7 <> 3").selectExpr("id % 6 a", "id div 6 b", "id v").write.parquet(str(tmp_path / "some"))
    s.range(9).selectExpr("id c", "id * 2 w").write.parquet(str(tmp_path / "other"))
    s.range(1800).selectExpr("id % 6 a", "(id div 6) % 10 b", "id % 9 c").write.parquet(str(tmp_path / "facts"))
    for t in ("pairs", "some", "other", "facts"):
        s.read.parquet(str(tmp_path / t)).createOrReplaceTempView(t + "_p")
    q = "select count(*), sum(v) from facts_p f join {} d on f.a = d.a and f.b = d.b join other_p o on f.c = o.c where o.w >= {} and o.c < 9"
    for table, least, redundant in (("pairs_p", 0, True), ("some_p", 0, False), ("pairs_p", 4, False)):
        sql = q.format(table, least)
        assert rows(session.sql(sql)) == rows(s.sql(sql))
        assert bool(session.last_profile()) != redundant, (table, least, session.profile_report())


def test_filters_reach_the_scan(session):
    """The range of the build's keys is among the filters that the scan pushes down."""
    with session.settings(removeRedundantPairs=False, localBuildBytes=0):
        plan = session.sql(SQL["filter_in"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey" in plan or "In(l_orderkey" in plan


def test_metrics_of_a_run(session):
    with session.settings(removeRedundantPairs=False):
        reduced, plain = measure(session.sql(SQL["chain4"])), measure(session.spark.sql(SQL["chain4"]))
    assert reduced["rows"] == plain["rows"] and 0 < reduced["join_rows"] <= plain["join_rows"] and plain["rows_scanned"] > 0 and plain["ms"]


def test_filters_are_not_written_out_in_plans(session):
    """A plan's text, which Spark makes and keeps for each execution, doesn't hold the bits of the filters; the filters still stop rows."""
    s = session.spark
    s.range(60_000).where("id % 3 = 1").selectExpr("id a").createOrReplaceTempView("few_a")
    s.range(60_000).where("id % 7 = 2").selectExpr("id b").createOrReplaceTempView("few_b")
    s.range(90_000).selectExpr("id % 60000 a", "(id * 11) % 60000 b", "id v").createOrReplaceTempView("many")
    q = "select count(*), sum(v) from many join few_a on many.a = few_a.a join few_b on many.b = few_b.b"
    with session.settings(removeRedundantPairs=False, localBuildBytes=0):
        df = session.sql(q)
    assert any("bloom" in e["filters"] for e in session.last_profile())
    assert rows(df) == rows(s.sql(q))
    execution = df._jdf.queryExecution()
    assert execution.optimizedPlan().toString().count("might_contain") >= 2 and len(execution.toString()) < 20_000


def test_large_filters_stay_in_the_jvm(session, monkeypatch):
    """A filter made at the exact count doesn't pass through Python."""
    from sluice.operators import summary

    s = session.spark
    keys = s.range(60_000).where("id % 3 = 1").selectExpr("id a")
    monkeypatch.setattr(summary, "MOST_BITS", 1)
    held = summary.create(keys, ["a"], ["bigint"], 480_000, Settings())
    assert held.bloom is not None and not isinstance(held.bloom, (bytes, bytearray))
    found, used = summary.probe(s.range(60_000).selectExpr("id b"), held, ["b"], Settings())
    assert "bloom" in used and 20_000 <= found.count() < 24_000 and found.where("b % 3 = 1").count() == 20_000
