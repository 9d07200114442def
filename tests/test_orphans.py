import pytest

from martlight.operators import quality
from martlight.schema import SCHEMAS
from martlight.sources.star import Star


@pytest.fixture
def no_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_orphans_with_hot_missing_and_repeated_keys(spark, no_broadcasts):
    def rows(name, **columns):
        names = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        n = len(next(iter(columns.values())))
        return spark.createDataFrame([tuple(columns[c][k] if c in columns else None for c in names) for k in range(n)], SCHEMAS[name])

    frames = {
        "regions": rows("regions", region_id=[1, 1, None]),
        "categories": rows("categories", category_id=[3]),
        "customers": rows("customers", customer_id=[5, 5]),
        "products": rows("products", product_id=[7, 8], category_id=[3, 4]),
        "orders": rows("orders", order_id=[1, 1, 2, None], customer_id=[5, 6, 6, None], region_id=[1, 1, 1, 2]),
        "order_items": rows("order_items", order_id=[1, 1, 9, None], product_id=[7, 9, 9, 9]),
    }
    found = quality.orphans(Star(frames.__getitem__))
    assert [r["orphan_rows"] for r in found.collect()] == [2, 3, 3, 1, 1]
    # Nothing is sent by key before it is counted: below each exchange on keys stands a partial count.
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [below for above, below in zip(plan, plan[1:]) if "Exchange hashpartitioning" in above]
    assert sent and all("partial_" in below for below in sent)
