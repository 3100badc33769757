from codaria.llm import toxicity


def test_sample_of_the_fit(spark):
    n = 3600
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic")
    rows, shares = toxicity.sample(docs, labels)
    assert (rows.count(), rows.filter("toxic").count(), toxicity.ToxicityConfig().rounds) == (2400, 800, 60)
    assert abs(sum(shares) - 1) < 1e-9 and abs(shares[1] - 1 / 3) < 0.05
    short = toxicity.sample(docs, labels, toxicity.ToxicityConfig(train_bytes=200))[0]
    assert 0 < short.filter("toxic").selectExpr("sum(octet_length(text))").first()[0] <= 200
