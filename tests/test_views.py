from cadenza.plans import views


def test_partitions_of_words_grow_with_turns(spark, sf_dir, monkeypatch):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    monkeypatch.setattr(views, "PART_TURNS", 10)
    assert views.words(spark, sf_dir).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-turns // 10))
