"""The pipeline's stages on a small corpus, and its queries' SQL."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    plain = lambda n: ["".join(rng.choice(["ba", "ko", "mi", "re", "tu", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    rows, labels = [], []
    for i in range(200):
        words = plain(60)
        if i % 5 == 0:
            words[3] = words[40] = rng.choice(["zwixxer", "grumpfh"])
        rows.append((i, " ".join(words) + ("\nShared footer" if i % 7 == 0 else ""), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s1", 0) for i in range(1, 40, 6)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, corpus):
    import corpus_pipeline as p

    d, rows = corpus
    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "tokens"]
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, d).cache()
        if name != "tokens":
            assert docs.columns == p.COLUMNS
        kept.append(docs.collect())
    toxic = {i for i, *_ in rows if i < 200 and i % 5 == 0}
    clean = {i for i, *_ in rows} - toxic
    first = {r.doc_id for r in kept[0]}
    assert len(first & toxic) <= 2 and len(clean - first) <= 2
    assert not any("Shared footer" in (r.text or "").split("\n") for r in kept[1])
    third = {r.doc_id for r in kept[2]}
    assert not any(i in third and 1000 + i in third for i in range(1, 40, 6))
    assert third <= {r.doc_id for r in kept[1]} and {r.doc_id for r in kept[3]} <= third
    assert max(Counter(r.doc_id for r in kept[3]).values()) <= 2
    assert len(kept[4]) == len(kept[3])
    assert Counter(r.doc_id for r in p.run(spark, d).collect()) == Counter(r.doc_id for r in kept[4])


def test_line_dedup_keeps_every_document(spark):
    import corpus_pipeline as p

    rows = [(i, "the same\nlicense", "en", "s0", 16) for i in range(10)] + [(10, "the same\nown line", "en", "s1", 17), (11, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.line_dedup(spark, docs, "").collect()}
    assert got == dict.fromkeys(range(10), ("", 0)) | {10: ("own line", 8), 11: ("", 0)}


def test_tokens_decode_to_the_text(spark, monkeypatch):
    import corpus_pipeline as p

    rows = [(1, "Grüße,  \tworld\n", "de", "s0", 0), (2, None, None, None, None), (3, "", "en", "s0", 0), (None, "日本 🙂 e\u0301 \x00", "ja", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.decoded_sha256 for r in p.tokens(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((text or "").encode()).hexdigest() for i, text, *_ in rows}
    wrong, encode = F.expr("if(doc_id = 1, concat(decoded, '.'), decoded)"), p.encode_texts
    monkeypatch.setattr(p, "encode_texts", lambda *a, **k: encode(*a, **k).withColumn("decoded", wrong))
    with pytest.raises(Exception, match="differs from the text of doc_id 1"):
        p.tokens(spark, docs, "").collect()


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", ["op2_line_runs", "op4_partenum", "op5_cap_filters", "op9_chat_template", "mix_targets", "base_rules"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from callweave.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = c.execute(ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert Counter(tuple(r[k] for k in columns) for r in QUERIES[name](spark, str(DATA)).collect()) == Counter(cursor.fetchall())
