from datetime import datetime

import pytest

from pyspark.sql import functions as F

from wharfside.operators import frontier as fr
from wharfside.plans import crawl

NOW = datetime(2026, 3, 1)


def _one_item_a_step(monkeypatch):
    """Steps that only close one item, so that many of them are quick."""

    def step(state, responses, now, cfg, registry_pages=None, only=None):
        leased, after = fr.dequeue(state["frontier"], cfg.items_a_step, F.lit(now))
        return state | {"frontier": after.sparkSession.createDataFrame(fr.complete(after, leased, F.lit(now)).collect(), fr.SCHEMA)}

    monkeypatch.setattr(crawl, "step", step)


def _frontier(spark, status, n, until=None):
    rows = [(i, "catalog_fetch", f"https://a.test/{i}", status, 0, 0, until) for i in range(n)]
    some = spark.createDataFrame(rows, "id bigint, kind string, url string, status string, attempts int, priority int, leased_until timestamp")
    names = [c.split(" ") for c in fr.SCHEMA.split(", ")]
    return some.select(*[(F.col(c) if c in some.columns else F.lit(None)).cast(t).alias(c) for c, t in names])


@pytest.mark.slow
def test_more_steps_than_the_old_limit(spark, monkeypatch):
    _one_item_a_step(monkeypatch)
    state = crawl.crawl({"frontier": _frontier(spark, "pending", 102)}, None, NOW, crawl.Config(items_a_step=1))
    assert fr.counts(state["frontier"]).first().asDict() == {"pending": 0, "in_flight": 0}


def test_step_limit_raises_and_can_go_on(spark, monkeypatch):
    _one_item_a_step(monkeypatch)
    with pytest.raises(crawl.Unfinished) as e:
        crawl.crawl({"frontier": _frontier(spark, "pending", 3)}, None, NOW, crawl.Config(items_a_step=1), most_steps=2)
    assert (e.value.pending, e.value.in_flight) == (1, 0)
    state = crawl.crawl(e.value.state, None, NOW, crawl.Config(items_a_step=1), most_steps=1)
    assert fr.counts(state["frontier"]).first().pending == 0


def test_leases_of_others(spark, monkeypatch):
    _one_item_a_step(monkeypatch)
    over = crawl.crawl({"frontier": _frontier(spark, "in_flight", 2, datetime(2026, 2, 1))}, None, NOW, crawl.Config())
    assert fr.counts(over["frontier"]).first().in_flight == 0
    with pytest.raises(crawl.Unfinished):
        crawl.crawl({"frontier": _frontier(spark, "in_flight", 2, datetime(2026, 4, 1))}, None, NOW, crawl.Config())
    with pytest.raises(crawl.Unfinished):
        crawl.crawl({"frontier": _frontier(spark, "pending", 2)}, None, NOW, crawl.Config(items_a_step=0))
