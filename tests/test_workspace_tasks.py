from loomgraph.plans import table_workspace


def test_files_are_dealt_out_by_their_keys(spark, monkeypatch):
    """F5 to F12: a small table of suppliers is one part, but its files are made and parsed by as many tasks as they need."""
    sf = "/root/testdata/sf0.001"
    want = [sorted(map(tuple, table_workspace.files(spark, sf, web).collect())) for web in (False, True)]
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").count()
    monkeypatch.setattr(table_workspace, "KEYS", 2)
    for web, rows in zip((False, True), want):
        files = table_workspace.files(spark, sf, web)
        sizes = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) >= suppliers // 2 and sorted(map(tuple, files.collect())) == rows
