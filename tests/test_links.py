"""Links of chunks, where they are needed."""

from pyspark.sql import functions as F

from lodestone.operators import links
from lodestone.plans import knowledge
from lodestone.sources import tables

SF = "/root/testdata/sf0.001"


def test_ids_are_read_without_links(spark):
    plan = knowledge.id_index(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in plan and "l_partkey" not in plan and "collect_set" not in plan
    plan = knowledge.resolve_citations(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set(db_id") == 1 and "collect_set(endpoint_id" not in plan


def test_some_pages_have_the_links_that_all_have(spark):
    pages = tables.entity_pages(spark, SF)
    some = pages.where("key % 7 = 0 OR doc_type LIKE '%hub'")
    rows = lambda df: {(r.node_id, tuple(r.db_ids or ["-"]), tuple(r.used_by or ["-"])) for r in df.select("node_id", "db_ids", "used_by").collect()}
    got, every = rows(tables.entity_links(spark, SF, some, some=True)), rows(tables.entity_chunks(spark, SF))
    assert got == {r for r in every if r[0] in {x[0] for x in got}} and len(got) == some.count() > 100
    assert any(r[1] != ("-",) for r in got) and any(r[2] != ("-",) for r in got)


def test_an_id_named_twice_cites_once(spark):
    chunks = tables.entity_pages(spark, SF)
    hits = tables.entity_chunks(spark, SF).where("doc_type = 'endpoint'").limit(20).withColumn("item_id", F.col("endpoint_id"))
    cited = lambda index: sorted(map(tuple, links.citations(hits, index, "item_id").collect()))
    assert cited(links.owned(chunks).unionByName(links.owned(chunks))) == cited(links.id_index(chunks)) != []
