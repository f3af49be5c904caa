"""Places where an operator once did less than its whole job."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_symbol_spam_is_rejected_with_pooled_labels(spark, tmp_path):
    """The registered risk and chance prove cutoffs on 2,500 labelled documents of three languages together."""
    import corpus_pipeline as pipeline
    import duckdb
    from siloml.llm.oracle import ORACLE
    from siloml.llm.queries import op7_quality

    def text(i, spam):
        return " ".join(f"w{i * 61 % 997}{k}" for k in range(60)) + " #" * spam

    langs = ["en"] * 1400 + ["de"] * 600 + ["fr"] * 500
    rows = [(i, text(i, 0), lang, "a", 0) for i, lang in enumerate(langs)]
    spam = [(5000 + i, text(i, 30), ("en", "de", "fr")[i % 3], "a", 0) for i in range(30)]
    spark.createDataFrame([(i, 1) for i in range(len(rows))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows + spam, SCHEMA)
    assert sorted(r.doc_id for r in pipeline.quality_rules(spark, docs, str(tmp_path)).collect()) == list(range(len(rows)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.kept for r in op7_quality(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    told = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({ORACLE['op7_quality']})").fetchall()}
    assert found == told == {i: i < len(rows) for i in found}


def test_hex_keys_glued_to_names():
    import time

    from siloml.llm.secrets import secret_spans

    rng = random.Random(3)
    for name in ("", "AUTH=", "KEY=", "v1/", "SIGNING_KEY=", "id-"):
        whole = 0
        for _ in range(300):
            key = "".join(rng.choice("0123456789ABCDEF") for _ in range(40))
            start = 4 + len(name)
            whole += any(s <= start and e >= start + 40 for s, _, e in secret_spans(f"use {name}{key} now"))
        assert whole >= 298, (name, whole)
    for clean in ("id=123e4567-e89b-12d3-a456-426614174000", "hash=sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
                  "order-20240101123456789012", "build_2024-12-01/2024-12-31-0000"):
        assert not [s for s in secret_spans(f"see {clean} here") if s[1] == "entropy"], clean
    began = time.time()
    assert not secret_spans("x" * 10_000 + "+") and not secret_spans("xy" * 5_000 + "_=")
    assert time.time() - began < 2
