"""Driver contract: entry smoke test and registry consistency."""

import __spark_entry__ as E


def test_entry_schema(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["val_id", "train_id", "rank", "sim", "train_relevancia",
                                                   "val_relevancia"]
    rows = df.collect()
    assert rows
    assert all(0.3 < r["sim"] <= 1.0 and 1 <= r["rank"] <= 10 for r in rows)


def test_oracles_are_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_oracle_text_needs_no_spark_files(monkeypatch):
    """The SQL is built from constants alone: no jar, file or JVM lookup."""
    import builtins
    import zipfile

    from gazrank import constants
    E.oracle_sql()  # imports done

    def refuse(*a, **k):
        raise AssertionError("oracle_sql() opened a file")

    monkeypatch.setattr(builtins, "open", refuse)
    monkeypatch.setattr(zipfile, "ZipFile", refuse)
    assert len(E.oracle_sql()) >= 98
    assert len(set(constants.portuguese_stopwords())) == len(constants.PORTUGUESE_STOPWORDS) == 204
