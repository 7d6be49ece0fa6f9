"""The pipeline stage by stage against brute force, and the SQL of the operators that have it."""

import hashlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from gyrolens.llm import mixing, quality, queries, sql

from .test_operators import ENCODING, SF, brute_links, lines_removed


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if not (p := quality.Page(r[1] or "")).base_failed and not any(rule(p) for rule in quality.RULES.values())]
    rows = [(i, t, r[2]) for r, (i, t) in zip(rows, lines_removed(rows))]
    _, root = brute_links(rows)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    stage = docs
    for _, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns
    assert sorted(tuple(r) for r in stage.select("doc_id", "text", "source").collect()) == sorted(rows)
    out = corpus_pipeline.run(spark, SF).collect()
    texts = dict(r[:2] for r in rows)
    times = Counter(r.doc_id for r in out)
    size = lambda t: len(quality.WORDS.findall(t))
    budget = sum(size(t) for t in texts.values())
    assert 0 < sum(size(texts[i]) * n for i, n in times.items()) <= budget and max(times.values()) <= mixing.MAX_REPEATS
    for r in out:
        ids = ENCODING.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_stages_with_nulls_ties_repeated_rows_and_clashing_columns(spark):
    """Each stage against brute force; columns have the names that stages use inside."""
    prose = lambda seed, n=40: "\n".join(" ".join(f"w{(seed * 97 + i * j) % 5000}" for i in range(1, 9)) for j in range(1, n // 8 + 1))
    menu = "All rights reserved."
    rows = [(i, f"{prose(i)}\n{menu}", "en", f"s{i % 9}" if i else None, 0, "q", "k") for i in range(30)]
    rows += [rows[3], rows[3], (None, prose(77), "en", None, 0, "q", "k"), (40, None, None, "s1", 0, None, None), (41, "", "en", "s1", 0, "q", "k"), (3, prose(88), "en", "s1", 0, "q", "k"), (42, rows[5][1], "en", "s2", 0, "q", "k")]
    columns = ["doc_id", "text", "lang", "source", "n_chars", "__quality", "__key"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __quality string, __key string")
    found = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        found.append([tuple(r) for r in docs.collect()])
        docs = spark.createDataFrame(found[-1], docs.schema)
    judged = [r for r in rows if r[1]]
    assert sorted(map(repr, found[0])) == sorted(map(repr, judged))
    cleaned = [(*r[:1], r[1].replace("\n" + menu, ""), *r[2:4], len(r[1]) - len(menu) - 1 if menu in r[1] else r[4], *r[5:]) for r in judged]
    assert sorted(map(repr, found[1])) == sorted(map(repr, cleaned))
    kept = sorted({repr(r) for r in cleaned if r[0] != 42})
    assert sorted(map(repr, found[2])) == kept
    assert {repr(r) for r in found[3]} <= set(kept) and max(Counter(map(repr, found[3])).values()) <= mixing.MAX_REPEATS
    assert 0 < sum(len(r[1].split()) for r in found[3]) <= sum(len(r[1].split()) for r in found[2])
    encoded = corpus_pipeline.bpe_encoding(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in encoded) == Counter(r[0] for r in found[3])


def test_the_mix_keeps_its_order(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    got = [r.doc_id for r in corpus_pipeline.source_mix(spark, docs, SF).collect()]
    _, mix = mixing.mix_sources(docs.selectExpr("concat(doc_id, ':', xxhash64(text), ':', xxhash64(1, text)) AS k", "source", "text"), id_col="k")
    want = [int(r.doc_id.split(":")[0]) for r in sorted(mix.collect(), key=lambda r: tuple(r.place))]
    assert got == want and len(got) > 100


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(sql.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
