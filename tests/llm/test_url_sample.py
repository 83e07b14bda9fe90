"""The training URLs are the same however often each was crawled."""

from tessera.llm.url_filter import rule_labels


def pages(spark, distinct, times):
    return spark.range(distinct * times).selectExpr(f"concat('https://h', id % {distinct}, IF(id % 2 = 0, '.com/a', '.net/es/'), id % {distinct}) AS url")


def test_sample_counts_distinct_urls(spark):
    once = rule_labels(pages(spark, 400, 1), most=100)
    assert len(set(once[0])) == len(once[0]) == 100
    assert rule_labels(pages(spark, 400, 100), most=100) == once
    assert rule_labels(pages(spark, 150, 300), most=100) == rule_labels(pages(spark, 150, 1), most=100)
    assert len(rule_labels(pages(spark, 60, 300), most=100)[0]) == 60


def test_sample_is_the_smallest_hashes_at_every_size(spark):
    every = pages(spark, 400, 1).selectExpr("url", "xxhash64(url) AS h").orderBy("h").collect()
    for most in (3, 10, 100, 199, 200, 250, 400):
        assert rule_labels(pages(spark, 400, 3), most=most)[0] == [r.url for r in every[:most]]
