"""Plans and joins that must hold on large tables: co-partitioned waves, two-level ranking, long lists, repeated runs."""

import re

import pytest
from pyspark.sql import functions as F

from reachmap.functions import emails
from reachmap.operators import contacts
from reachmap.plans import crawl
from reachmap.session import new_run_folder
from reachmap.sources import tables
from reachmap.sources.workspace import Workspace


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def branches(frame):
    """The lines of the physical plan above each scan of a written table, from the scan up to its join."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    depth = [len(re.match(r"^[ :+\-]*", line)[0]) for line in lines]
    out = {}
    for k, line in enumerate(lines):
        if "FileScan" in line:
            above, level = [], depth[k]
            for j in range(k - 1, -1, -1):
                if depth[j] < level:
                    level = depth[j]
                    above.append(lines[j])
                    if "Join" in lines[j]:
                        break
            out[line] = above
    return out


def test_waves_shuffle_only_the_frontier(spark, no_broadcast):
    work = Workspace(spark, "test-waves")
    facts = work.write_buckets(spark.range(1000).select(F.col("id").alias("page_id"), F.lit(True).alias("parsed"), F.lit("ok").alias("reason")), "facts", ["page_id"])
    index = work.write_buckets(
        spark.range(1000).select(F.lit(False).alias("include_query"), F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("page_id")), "index", ["include_query", "url"]
    )
    frontier = work.write(spark.range(0, 1000, 7).select(F.col("id").alias("page_id"), F.lit(False).alias("include_query"), F.concat(F.lit("u"), "id").alias("url")), "frontier")
    for joined, table in ((frontier.join(facts, "page_id"), "facts"), (crawl._fetch(frontier.drop("page_id"), index), "index")):
        found = branches(joined)
        assert len(found) == 2
        for scan, above in found.items():
            shuffled = any("Exchange" in line for line in above)
            assert shuffled == (f"/{table}" not in scan and f"_{table}_" not in scan), joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 143
    work.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("reachmap_")]


def test_candidates_of_one_site_are_ranked_in_many_tasks(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.lit(2)).otherwise(F.lit(1)).alias("site_id"), F.concat(F.lit("http://a.com/"), "id").alias("url"),
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("place"),
    )
    heads = crawl._heads(rows, 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows into one task
    per_task = heads.where("site_id = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) == 8 and sum(r["count"] for r in per_task) <= 64 * 40
    for site in (1, 2):
        order = ["place", "url"]
        first = rows.where(F.col("site_id") == site).orderBy(*order).limit(40).collect()
        assert heads.where(F.col("site_id") == site).orderBy(*order).limit(40).select(*rows.columns).collect() == first


def test_allowed_contacts_is_the_list_filter(spark):
    listed = {"a": ["@Example.com", " .b.org", "x.y.net"], "b": ["com"], "c": []}
    addresses = ["m@example.com", "m@sub.example.com", "m@notexample.com", "m@b.org", "m@z.b.org", "m@y.net", "m@q.x.y.net", "m@com"]
    rows = [(site, "email", a, n) for site in "abc" for n, a in enumerate(addresses)] + [("a", "phone", "+7", 1)]
    table = spark.createDataFrame(rows, "site_key string, kind string, contact string, n_pages int")
    allowed = spark.createDataFrame([(s, d) for s, ds in listed.items() for d in [*ds, *ds]] + [("a", " "), ("zz", "com")], "site_key string, suffix string")
    found = {tuple(r) for r in contacts.allowed_contacts(table, allowed).collect()}
    lists = spark.createDataFrame(list(listed.items()), "site_key string, domains array<string>")
    plain = table.join(lists, "site_key").where((F.col("kind") == "phone") | emails.domain_allowed("contact", emails.normalize_allowlist("domains")))
    assert found == {tuple(r) for r in plain.drop("domains").collect()} and 8 < len(found) < 24
    assert contacts.allowed_contacts(table, allowed).columns == table.columns
    assert contacts.allowed_contacts(table, allowed.limit(0)).count() == len(rows)


def test_sketches_merge(spark):
    rows = spark.range(6000).select(
        F.lit("s").alias("site_key"), F.when(F.col("id") % 3 == 0, F.lit("phone")).otherwise(F.lit("email")).alias("kind"), (F.col("id") % 3000).cast("string").alias("contact")
    )
    whole = contacts.contacts_estimated(contacts.contact_sketches(rows)).first()
    parts = contacts.contact_sketches(rows.limit(2500)).unionByName(contacts.contact_sketches(rows))
    merged = contacts.contacts_estimated(contacts.merge_sketches(parts)).first()
    assert whole == merged and abs(whole.n_emails - 2000) < 100 and abs(whole.n_phones - 1000) < 50


def test_results_survive_repeated_and_broken_runs(spark):
    def results(*sites, mark="x"):
        return spark.createDataFrame([(s, f"http://{s}.com", 0, 1, [f"{mark}@x.com"], []) for s in sites], "site_id long, url string, part int, parts int, emails array<string>, phones array<string>")

    def stored():
        return {(r.site_id, re.search(r'"(\w+)@', r.value)[1]) for r in tables.read_results(spark, folder).collect()}

    folder = new_run_folder(spark, "test-results")
    assert tables.read_results(spark, folder).count() == 0
    tables.stage_results(results(1, 2, mark="early"), folder)
    assert stored() == set()
    run = tables.commit_results(results(1, 2, 3), folder)
    assert stored() == {(1, "x"), (2, "x"), (3, "x")}
    tables.commit_run(spark, folder, run)  # a commit may be repeated
    tables.commit_results(results(2, 4, mark="new"), folder)
    assert stored() == {(1, "x"), (2, "new"), (3, "x"), (4, "new")}
    fails = results(1, 2, mark="broken").withColumn("url", F.when(F.col("site_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("url")))
    with pytest.raises(Exception, match="lost"):
        tables.commit_results(fails, folder)
    assert stored() == {(1, "x"), (2, "new"), (3, "x"), (4, "new")}
    tables.commit_results(results(1, 2, mark="again"), folder)
    tables.commit_results(results(1, 2, mark="again"), folder)
    assert stored() == {(1, "again"), (2, "again"), (3, "x"), (4, "new")} and tables.read_results(spark, folder).count() == 4
