"""Queries read what is costly to make once."""

import pytest

from litlake.plans import catalogue, flows, reports  # noqa: F401  reports adds its queries to the catalogue
from litlake.sources import star

SF = "/root/testdata/sf0.001"


def counted(spark, make):
    """``make`` whose rows are counted as often as they are made."""
    seen = spark.sparkContext.accumulator(0)

    def told(*args):
        rows = make(*args)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return rows.mapInArrow(count, rows.schema)

    return told, seen


@pytest.mark.parametrize("name", ["paper_payloads", "paper_entries", "domain_papers_local_norm", "download_summary", "title_search", "metadata_lookups", "download_states"])
def test_articles_are_made_once(spark, monkeypatch, name):
    told, seen = counted(spark, star.articles)
    monkeypatch.setattr(star, "articles", told)
    assert catalogue.QUERIES[name](spark, SF).count() > 0
    assert seen.value == star.table(spark, SF, "orders").count()


def test_a_domain_is_in_no_window_as_a_whole(spark):
    plan = catalogue.QUERIES["domain_papers_local_norm"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Window [max(" not in plan


def test_a_crawl_makes_its_pages_once(spark, monkeypatch):
    told, seen = counted(spark, flows._web)
    pages = flows._web(spark, SF).count()
    monkeypatch.setattr(flows, "_web", told)
    assert flows.crawl_order(spark, SF).count() > pages
    assert seen.value == pages
