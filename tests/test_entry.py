import __spark_entry__ as entry


def test_entry_runs_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "context"]
    rows = df.collect()
    assert len(rows) > 0
    assert all(r["context"].startswith("Passage: ") for r in rows)


def test_registry_names_are_unique_and_callable():
    qs = entry.queries()
    assert len(qs) >= 50
    assert all(callable(f) for f in qs.values())
