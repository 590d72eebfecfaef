"""The physical plans keep their promises."""

import pytest
from pyspark.sql import functions as F

from catalog import entries
from reachmap.operators import contacts, options
from reachmap.plans import crawl as crawl_plan
from reachmap.sources import tables

DATA = "/root/testdata/sf0.01"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet").withColumn("final_url", F.col("url"))


def test_extraction_is_one_stage_without_python(pages):
    plan = plan_of(contacts.page_contacts(pages))
    assert not any(node in plan for node in ("Exchange ", "EvalPython", "MapInPandas", "MapInArrow", "Join "))


def test_contacts_of_sites_shuffle_once_after_a_partial_aggregate(pages):
    plan = plan_of(contacts.contacts_by_site(pages))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan


def test_text_is_computed_once(pages):
    plan = plan_of(contacts.page_candidates(pages).select("emails", "runs", "dialled"))
    assert plan.count("regexp_replace(html") == 1


def test_url_work_reads_no_html(pages):
    plan = plan_of(crawl_plan._narrow(pages))
    assert "html" not in plan.split("ReadSchema")[1]


def test_ranking_cuts_groups_before_the_shuffle(spark):
    candidates = spark.range(1000).select(
        (F.col("id") % 3).alias("site_id"), F.concat(F.lit("http://k.com/"), F.col("id").cast("string")).alias("url"),
        crawl_plan._place(F.lit(1), F.col("id").cast("int") - 500, F.lit(0)).alias("place"),
        F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("discovered"), F.lit(5).alias("max_pages"), F.lit(1).alias("max_depth"),
        F.lit(9).alias("max_links_per_page"), F.lit(False).alias("include_query"), F.lit(True).alias("focused_crawling"),
    )
    admitted = crawl_plan._admit(candidates, 5)
    plan = plan_of(admitted)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert admitted.where("admitted").count() == 3 * 4 and admitted.count() == 3 * 5


def test_place_keeps_order_and_score(spark):
    rows = spark.createDataFrame([(r, s, p) for r in (1, 2, 5001) for s in (-700, -1, 0, 1, 900) for p in (0, 7, 5000)], "r int, s int, p int")
    placed = rows.select("*", crawl_plan._place(F.col("r"), F.col("s"), F.col("p")).alias("place")).withColumn("back", crawl_plan._score_of(F.col("place")))
    found = placed.orderBy("place").collect()
    assert [(x.r, x.s, x.p) for x in found] == sorted((x.r, x.s, x.p) for x in found)
    assert all(x.back == x.s for x in found)


@pytest.mark.parametrize("name", ["url_resolve", "email_all", "phone_all", "site_contacts", "options_typed", "log_latest"])
def test_no_cross_joins(spark, name):
    plan = plan_of(entries.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_latest_rows_are_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(entries.log_latest(spark, DATA))


def test_key_sets_prune_by_semi_join_without_hints(spark, pages):
    from reachmap.sources import workspace

    plan = plan_of(workspace.keep_matching(pages, pages.select("page_id").limit(3), "page_id"))
    assert "LeftSemi" in plan and "rightHint" not in plan and "leftHint" not in plan


@pytest.mark.parametrize("part_size", [7, 100, 5000])
def test_lists_come_in_parts_of_the_sort_order(spark, part_size):
    rows = spark.range(1000).select(F.lit("s").alias("site_key"), F.lit("email").alias("kind"), F.concat(F.col("id").cast("string"), F.lit("@x.com")).alias("contact"))
    rows = rows.union(spark.range(9).selectExpr("'t'", "'phone'", "'+1' || id")).union(spark.range(250).selectExpr("'s'", "'phone'", "'+' || id"))
    for site in ("s", "t"):
        parts = sorted((r for r in contacts.contact_lists(rows, part_size=part_size).collect() if r.site_key == site), key=lambda r: r.part)
        wanted = [sorted(r.contact for r in rows.where(F.col("site_key") == site).where(F.col("kind") == kind).collect()) for kind in ("email", "phone")]
        assert [r.part for r in parts] == list(range(parts[0].parts))
        assert [[c for p in parts for c in p.emails], [c for p in parts for c in p.phones]] == wanted
        assert all(len(p.emails) <= part_size and len(p.phones) <= part_size for p in parts)


def test_waves_read_links_only(pages):
    assert "@[a-zA-Z0-9" not in plan_of(crawl_plan._facts(pages))
    assert "@[a-zA-Z0-9" in plan_of(contacts.page_candidates(pages))


def test_hot_page_copies_are_combined_before_the_shuffle(pages):
    plan = plan_of(crawl_plan._index(pages, [False]))
    assert "partial_min" in plan and "SortAggregate" not in plan


def test_scan_of_pages(spark, tmp_path, pages):
    pages.drop("final_url").write.json(str(tmp_path / "p"))
    back = tables.scan_pages(spark, str(tmp_path / "p"), "json")
    assert back.columns == ["page_id", "url", "final_url", "html"] and back.count() == pages.count()
    assert back.where("final_url != url").count() == 0
    pages.withColumn("reason", F.lit("http_404")).write.parquet(str(tmp_path / "r"))
    assert tables.scan_pages(spark, str(tmp_path / "r")).where("reason = 'http_404'").count() == pages.count()
    assert options.SETTINGS["max_pages"].default == "200"


def test_one_kind_of_contact_reads_nothing_for_the_other(spark):
    pages = spark.createDataFrame([(1, "http://a.ru/", "x@y.org 8 (800) 555-35-35")], "page_id long, final_url string, html string")
    found = contacts.page_contacts(pages)
    signs = {contacts.EMAIL: "@[a-z", contacts.PHONE: "33622"}  # of the patterns
    for kind, value in ((contacts.EMAIL, "x@y.org"), (contacts.PHONE, "+78005553535")):
        rows = contacts.contact_rows(found, [kind])
        assert [(r.kind, r.contact) for r in rows.collect()] == [(kind, value)]
        plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
        assert [k for k, sign in signs.items() if sign in plan] == [kind]
