"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import gzip
import hashlib
import math
import os
import random
import zlib
from collections import Counter
from datetime import UTC, datetime

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gyrolens.llm import ann, bpe, langid, license_scan, line_dedup, mixing, ngram_join, quality, queries, token_counts, warc

SF = "/root/testdata/sf0.001"
RANKS = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path(queries.RANKS)))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, size long, keeper string"


def table(spark, rows):
    """rows: (doc_id, text, source); extra columns have names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "k") for i, t, s in rows], DOCS)


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab're 1\n\t!é日　\x1ć#")), max_size=80), st.integers(1, 9))
def test_tree_equals_library(text, leaf):
    tree = bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, leaf, 1)
    ids = tree.encode(text).tolist()
    assert ids == ENCODING.encode_ordinary(text) and tree.decode(ids) == text.encode()


def test_long_texts_without_seams():
    tree = bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, 64)
    for text in ("a" * 5000, " " * 5000 + "x", words(1, 3000), "\n" * 999 + "'re" * 999):
        assert tree.encode(text).tolist() == ENCODING.encode_ordinary(text)


def test_very_long_texts():
    tree, r = bpe.TreeBpe(RANKS, public_tokenizers.PATTERN), random.Random(5)
    spaces = " " * 2_000_000 + "x"  # the library's stack doesn't hold these
    ids = tree.encode(spaces).tolist()
    assert tree.decode(ids) == spaces.encode() and ids[-1] == ENCODING.encode_ordinary(" x")[-1]
    assert ids[:-1] == tree.core.encode_single_piece(b" " * 1_999_999)
    for text in ("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(300_000)), "".join(r.choice("abcdé1'") for _ in range(200_000)), " " * 200_000 + "x " * 20_000 + "\n" * 50_000):
        assert tree.encode(text).tolist() == ENCODING.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abthe're1 \n日é")), max_size=300), st.booleans())
def test_runs_without_seams(text, dense):
    tree = bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, 8, 1, run_chars=3, leaf_bytes=1)
    text = text.replace(" ", "") if dense else text
    assert tree.encode(text).tolist() == ENCODING.encode_ordinary(text)


def test_digests(spark):
    rows = [(1, "Hello  world's", "a"), (2, None, "a"), (3, "", None), (3, "", None), (4, words(2, 5000), "b")]
    got = sorted(map(tuple, queries.encode_digests(table(spark, rows)).collect()))
    want = []
    for i, t, _ in rows:
        ids = ENCODING.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert queries.encode_digests(table(spark, [])).count() == 0


# 2


def lines_removed(rows, min_sites=line_dedup.MIN_SITES):
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n") if t is not None else ():
            sites.setdefault(x.strip(" "), set()).add(s)
    gone = {x for x, s in sites.items() if len(x) >= line_dedup.MIN_CHARS and len(s) >= min_sites}
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone)) for i, t, _ in rows]


def test_line_dedup(spark):
    shared, near = "a line that many sites share with others", "a line that seven sites share with others"
    rows = [(i, f"own {i}\n{shared}  \n{near if i < 7 else 'z'}\nshort\n ", f"s{i}" if i else None) for i in range(12)]
    rows += [(20, shared, "s1"), (20, shared, "s1"), (21, None, "s2"), (22, "", "s3"), (None, near + "\n" + near, "s2")]
    out = line_dedup.dedup_lines(table(spark, rows))
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(lines_removed(rows), key=key)
    assert out.columns[: len(DOCS.split(","))] == [x.split()[0] for x in DOCS.split(", ")]
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_line_dedup_of_long_texts_short_lines_and_columns_of_any_name(spark):
    menu, n = "All rights reserved.", 30_000
    rows = [(i, f"own {i}\n{menu}", f"s{i}", 70 + i, "mine") for i in range(9)] + [(9, "\n".join([menu] * n + [f"line {k}" for k in range(n)]), "s0", 79, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __d0 long, __gone string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, n_lines_col="lines").collect()}
    assert {i: r.text for i, r in got.items() if i < 9} == {i: f"own {i}" for i in range(9)}
    assert {(r["__d0"] - i, r["__gone"]) for i, r in got.items()} == {(70, "mine")}
    assert got[9].text == "\n".join(f"line {k}" for k in range(n)) and (got[9].lines, got[9]["__n_removed"]) == (2 * n, n)


# 3


def test_mixing(spark):
    rows = [(i, words(i, 1 + i % 40), f"s{i % 5}" if i % 6 else None) for i in range(600)] + [(600, None, "s1"), (601, "", "zero"), (7, words(7, 8), "s2"), (7, words(7, 8), "s2"), (None, "x y", "s0")]
    documents, mix = mixing.mix_sources(table(spark, rows))
    got = documents.collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert len(got) == len(rows) and all(r.source_size == sizes[r.source] for r in got)
    left, open_, want = sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9)), {}
    while open_:  # share by weight, stop at caps, share again
        per = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * per >= 3 * sizes[s]] if open_ else []
        for s in full:
            want[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            open_.pop(s)
        if not full:
            want |= {s: w * per for s, w in open_.items()}
            break
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    assert all(abs(taken[s] - target[s]) <= 80 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values()) and mix.agg(F.sum("size")).first()[0] == sum(taken.values())
    again, _ = mixing.mix_sources(table(spark, rows[::-1]))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))
    assert mixing.mix_sources(table(spark, []))[0].count() == 0
    assert {r.taken for r in mixing.mix_sources(table(spark, [(1, None, "a"), (2, "", None)]))[0].collect()} == {0}


def test_the_cut_is_found_in_ranges_of_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(500)], "doc_id long, text string, source string")
    plain = sorted(map(repr, mixing.mix_sources(df)[0].collect()))
    monkeypatch.setattr(mixing, "CUT_ROWS", 7)
    assert sorted(map(repr, mixing.mix_sources(df)[0].collect())) == plain


def test_mixing_leaves_out_a_giant_document(spark):
    rows = [(i, words(i, 10), "a") for i in range(10)] + [(10, words(10, 300), "b")]
    documents, mix = mixing.mix_sources(table(spark, rows))
    taken = {r.doc_id: r.taken for r in documents.collect()}
    assert taken == {i: 30 for i in range(10)} | {10: 0}
    assert mix.agg(F.sum("size")).first()[0] == sum(taken.values()) <= 400


# 4


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op4_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = table(spark, [(1, "the cat and the dog", "a"), (2, None, "a"), (3, "12 34 !", "a"), (4, "", "a"), (None, "the", "b"), (5, "xyzzy", "a")])
    model = langid.train(docs)
    got = {r.doc_id: r.prediction for r in langid.predict(docs, model).collect()}
    assert {i: p.lang for i, p in got.items()} == {1: "en", 2: "und", 3: "und", 4: "und", None: "en", 5: "en"} and got[2].score == 0
    nothing = langid.train(docs.where("false"))
    assert {r.prediction.lang for r in langid.predict(docs, nothing).collect()} == {"und"}
    two = langid.Model(pa.table({"n": [0, 0, 3, 3, 1], "gram": ["le", "the", "the", "^le", "z"], "lang": ["fr", "en", "en", "fr", "fr"], "c": [9, 9, 9, 9, 1]}))
    assert two.rows_of("the") == [two.tables[0]["the"]] and two.rows_of("lex") == [two.tables[3]["^le"]] and two.rows_of("qz") == [two.tables[1]["z"]] and two.rows_of("q") == [0]


def slow_prediction(labelled, text):
    """The method, word by word, from counts of the labelled texts."""
    counts = {}
    for t, lang in labelled:
        for w in langid.words_of(t):
            for n in range(langid.MAX_N + 1):
                for g in [w] if n == 0 else langid.grams_of(w, n):
                    counts.setdefault(n, {}).setdefault(g, Counter())[lang] += 1
    langs = sorted({lang for t, lang in labelled if langid.words_of(t)})
    log = lambda n, g, lang: math.log((counts[n][g][lang] + langid.SMOOTHING) / sum(c[lang] + langid.SMOOTHING for c in counts[n].values()))
    sums, ws = dict.fromkeys(langs, 0.0), langid.words_of(text)
    for w in ws:
        n, known = next(((n, k) for n in (0, 5, 4, 3, 2, 1) if (k := [g for g in ([w] if n == 0 else langid.grams_of(w, n)) if g in counts.get(n, {})])), (0, []))
        for lang in langs:
            sums[lang] += sum(log(n, g, lang) for g in known) / len(known) if known else 0
    if not ws or not langs:
        return "und", 0.0
    best = max(langs, key=lambda x: sums[x])
    return best, 1 / sum(math.exp((sums[x] - sums[best]) / len(ws)) for x in langs)


def test_language_equals_slow_prediction(spark):
    r = random.Random(4)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 7))) for _ in range(n))
    labelled = [(make("abcde", 12), "x") for _ in range(12)] + [(make("defgh", 12), "y") for _ in range(9)] + [(make("ghija", 9), "z") for _ in range(9)]
    asked = [make("abcdefghijk", r.randrange(1, 9)) for _ in range(60)] + [labelled[0][0], "kkk", "½ 12", "", make("abcde", 40_000), "same"] + ["same"] * 2
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(labelled)], "doc_id long, text string, lang string, n long")
    model = langid.train(docs)
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    for row in langid.predict(rows, model).collect():
        lang, score = slow_prediction(labelled, row.text)
        assert row.lang == "kept" and (row.prediction.lang == lang or abs(score - 1 / 3) < 1e-9) and abs(row.prediction.score - score) < 1e-9
    tied = langid.train(spark.createDataFrame([(1, "ab", "q"), (2, "ab", "p")], "doc_id long, text string, lang string"))
    assert tied.predict(["ab"]) == [("p", 0.5)]


def test_rare_languages_are_learned(spark):
    rows = [(i, words(i, 5), "en") for i in range(2000)] + [(3000 + i, f"qa{i} qo", "xx") for i in range(3)] + [(None, "zu zo", "yy")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    uniform = docs.where(place < int((1 << 32) * 50 / len(rows)))
    assert {r.lang for r in uniform.collect()} == {"en"}
    model = langid.train(docs, max_train_rows=50)
    assert model.langs == ["en", "xx", "yy"] and model.predict(["qa1 qo", "zu"])[0][0] == "xx"
    limits = langid.sample_limits({"a": (10, 5), "b": (10_000, 7), "c": (10_000, 1 << 31)}, 110)
    assert limits == {"a": 1 << 32, "b": (1 << 32) * 50 // 10_000, "c": (1 << 31) + 1}


# 5


def slow_repeats(ws, size=8):
    windows = [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)]
    counts = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(size)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.sampled_from("abc"), max_size=30))
def test_repeated_words(a, b):
    ws = a + b + a
    assert quality.repeated_words(ws) == slow_repeats(ws)


def test_order_never_changes_the_verdict(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, None, None), (-1, "", "s"), (-2, "x " * 3000, "s"), (-3, "# a " * 30, "s")]
    docs = table(spark, rows)
    names = list(quality.RULES)
    got = quality.apply_rules(docs).select("doc_id", "quality.kept").collect()
    back = quality.apply_rules(docs, names[::-1]).select("doc_id", "quality.kept").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, back)) and len(got) == len(rows)
    brute = {i: not (p := quality.Page(t or "")).base_failed and not any(rule(p) for rule in quality.RULES.values()) for i, t, _ in rows}
    assert {r.doc_id: r.kept for r in got} == brute
    assert sorted(quality.plan(docs)) == sorted(names) and sorted(quality.plan(docs.where("false"))) == sorted(names)
    assert quality.apply_rules(docs.where("false")).count() == 0


def test_cascade_counts_what_earlier_rules_let_pass():
    """b rejects most, but nothing that a, the cheaper one, lets pass; c rejects a text that is left."""
    probes = [[(1, True), (4, True), (2, False)]] * 5 + [[(1, False), (4, False), (2, False)]] * 4 + [[(1, False), (4, False), (2, True)]]
    costs = quality.cascade(probes, ["a", "b", "c"])
    assert [c.rule for c in costs] == ["a", "c", "b"] and [c.rejected for c in costs] == [0.5, 0.2, 0.0]


def test_letters_are_letters():
    signs = "½ ² ① Ⅷ ৪ ٣ 7 _ !"
    assert not langid.words_of(signs) and langid.words_of("Été, 日本ß x²½y") == ["été", "日本ß", "x", "y"]
    judge = lambda w: quality.RULES["words_without_letters"](quality.Page(f"{w} " * 20))
    assert [judge(w) for w in ("½", "Ⅷ²", "٣", "½a", "日²", "-é-")] == [True, True, True, False, False, False]


# 6


def test_warc_round_trip(spark, tmp_path):
    long = "<p>\r\n\r\nWARC/1.1\r\n é" * 40
    rows = [(5, "http://www.Example.com/b?y=2&x=1#f", long), (3, "https://example.com/b", long), (9, None, long), (1, "http://a.org/", "tiny"), (2, "http://a.org/", "tiny"), (7, "http://a.org/x", None), (8, "bad\r\nurl", ""), (3, "https://example.com/b", long), (None, "http://a.org/n", long)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.warc_index(pages, str(tmp_path / "w"), records_a_file=2, merge_rows=3).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        twin = raw == long.encode() and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if twin else "response", 3 if twin else None))
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))
    order = [warc._order(tuple(r)) for r in got]
    assert order == sorted(order)
    assert warc.warc_index(pages.where("false"), str(tmp_path / "e")).count() == 0


def test_warc_of_any_id_and_time_zone(spark, tmp_path):
    ids = [0, -1, 10**12, 10**15, -9 * 10**18, 2**63 - 1, None]
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", "<p>" * 200_000, None) for i in ids], "page_id long, url string, html string, seen timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    for name in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", name)
        found.append({r.page_id: (r.captured, r.record_type, r.refers_to) for r in warc.warc_index(pages, str(tmp_path / name.replace("/", "")), merge_rows=2).collect()})
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert found[0] == found[1] and found[0][0][0] == warc.FIRST_SECOND and found[0].keys() == set(ids)
    assert all(k[1:] == (("response", None) if i == -9 * 10**18 else ("revisit", -9 * 10**18)) for i, k in found[0].items())
    old = pages.limit(1).selectExpr("page_id", "url", "html", "timestamp'1931-02-03 04:05:06Z' AS seen")
    assert [r.captured for r in warc.warc_index(old, str(tmp_path / "old"), time_col="seen").collect()] == [int(datetime(1931, 2, 3, 4, 5, 6, tzinfo=UTC).timestamp())]


def test_offsets_are_where_records_begin(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string")
    for r in warc.warc_index(pages, str(tmp_path / "w")).collect():
        with open(tmp_path / "w" / r.archive, "rb") as f:
            f.seek(r.offset)
            headers, payload = warc.parse_record(zlib.decompressobj(31).decompress(f.read()))
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and bytes(payload).decode() == f"page {r.page_id} " * 50
        assert gzip.decompress((tmp_path / "w" / r.archive).read_bytes()).startswith(warc.VERSION.encode())


@given(st.lists(st.lists(st.integers(0, 9)), max_size=7))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted((x, i) for x in r) for i, r in enumerate(runs)], key=lambda r: r)) == sorted((x, i) for i, r in enumerate(runs) for x in r)


# 7


def brute_nearest(rows, is_query, k=10):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = {}
    for q in filter(is_query, ok):
        found = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out[q] = found[:k]
    return out


def test_neighbours(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) + 4 * (i % 3) for _ in range(8)]) for i in range(900)] + [(i, [1.0] * 8) for i in range(900, 1000)]
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [None] * 8), (None, [1.0] * 8), (2400, [float("inf")] * 8), (2500, [1.0, 2.0]), (2501, [1.0, 3.0]), (2600, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, shard int")
    got = {}
    for x in ann.nearest(df.union(df.where("vec_id = 100")), F.col("vec_id") % 100 == 0, shard_rows=300).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute_nearest(rows, lambda i: i % 100 == 0)
    assert got.keys() == {q for q, w in want.items() if w}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len(found) == len(want[q])
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert [f[1] for f in got[900]] == list(range(901, 911))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("name", ["plain", "outlier", "offset", "wide", "clusters"])
def test_recall_of_a_graph(name):
    r = np.random.default_rng(0)
    x = r.normal(size=(2500, 384 if name == "wide" else 64))
    if name == "outlier":
        x[5, 3] = 1e30
    if name == "offset":
        x = 1000 + 0.01 * x
    if name == "clusters":
        x = 1000 * r.normal(size=(30, 64))[r.integers(0, 30, len(x))] + 0.01 * x
    graph, asked = ann.Graph(x).build(), np.arange(0, len(x), 25)
    ids, _ = graph.search(graph.about(x[asked]), ann.SEARCH_BEAM)
    hit = 0
    for q, near in zip(asked, ids):
        distance = lambda at: np.sqrt(((x[at] - x[q]) ** 2).sum(axis=1))  # noqa: B023, E731
        others, near = np.delete(np.arange(len(x)), q), near[(near >= 0) & (near != q)]
        hit += len({*others[np.argsort(distance(others), kind="stable")[:10]]} & {*near[np.argsort(distance(near), kind="stable")[:10]]})
    assert hit >= 0.95 * 10 * len(asked)


def test_shards_grow_more_slowly_than_rows():
    assert [ann.shards_for(n, 64 * n, 8192, 1 << 28) for n in (0, 8192, 100_000, 1_000_000)] == [1, 1, 4, 12]
    assert ann.shards_for(10, 10 << 20, 8192, 1 << 20) == 80


# 8


def slow_pieces(vocabulary, word):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + 300), i, -1) if word[i:j] in vocabulary), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


@settings(max_examples=400, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=9), st.binary(max_size=14).map(lambda b: bytes(x % 3 for x in b)))
def test_longest_match(vocabulary, word):
    assert token_counts.LongestMatch(vocabulary).count(word) == slow_pieces(vocabulary, word)


def test_token_counts(spark):
    rows = [(1, "Hello world's", "a"), (2, None, "a"), (3, "", "a"), (4, "x" * 9000, "a"), (4, "x" * 9000, "a")]
    count = token_counts.token_counter(spark, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: (r.c.n_words, r.c.n_tokens) for r in table(spark, rows).select("doc_id", count(F.col("text")).alias("c")).collect()}
    assert got[2] == got[3] == (0, 0) and got[1][0] == 3 and got[4] == (1, slow_pieces(RANKS, b"x" * 9000))
    assert got[1][1] == sum(slow_pieces(RANKS, w) for w in (b"Hello", b" world", b"'s"))


# 9


def test_licenses(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    prose = words(3, 80)
    files = [(1, "a/LICENSE", apache), (2, "a/x/y/f.py", prose), (3, "a/x/COPYING.txt", mit), (4, "a/g.py", prose + "\n" + mit), (5, "b/h.py", prose), (6, None, prose), (7, "f.py", None), (8, "a/x/z.py", ""), (9, "a/x/y/f.py", prose)]
    df = spark.createDataFrame([(*f, 0.5, "d") for f in files], "doc_id long, path string, text string, score double, __dir string")
    got = {r.doc_id: (r.license, r.license_dir) for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: ("Apache-2.0", None), 2: ("MIT", "a/x"), 3: ("MIT", None), 4: ("MIT", None), 5: (None, None), 6: (None, None), 7: (None, None), 8: ("MIT", "a/x"), 9: ("MIT", "a/x")}
    assert license_scan.scan_licenses(df.where("false")).count() == 0


def test_cosine_matches_brute_force():
    frequencies, n = {"the": 90, "license": 5, "under": 40}, 100
    scanner = license_scan.Scanner(frequencies, n, min_cosine=0.3)
    idf = lambda w: np.log((1 + n) / (1 + frequencies.get(w, 0))) + 1
    vector = lambda t: {w: k * idf(w) for w, k in Counter(license_scan.tokens(t)).items()}
    for line in ("Released under an MIT License", "the the the cat", "foo license under the apache version 2", "x y z", "licensed under the GNU General Public License v2"):
        a = vector(line)
        # Words of no template weigh as words of no file.
        a = {w: (x if w in scanner.ids else Counter(license_scan.tokens(line))[w] * idf("")) for w, x in a.items()}
        cosines = []
        for _, t in license_scan.TEMPLATES:
            b = vector(t)
            cosines.append(sum(x * b.get(w, 0) for w, x in a.items()) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
        best, found = max(cosines), scanner.best(line)
        assert (found is None) == (best < 0.3) and (found is None or abs(found[0] - best) < 1e-9)


def test_common_words_outside_the_templates_weigh_little(spark):
    """Scores by brute force with true frequencies; with the weight of words of no file the first file's was too small."""
    texts = ["Released under les the des MIT License.", "Released under zyx the qwv MIT License.", *["les des mots the under"] * 60, *["autre texte license released"] * 60]
    df = spark.createDataFrame([(i, f"d{i}/f.py", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.own, r.score) for r in license_scan.scan_licenses(df).collect()}
    count = Counter(w for t in texts for w in set(license_scan.tokens(t)))
    scanner = license_scan.Scanner(count, len(texts))
    assert got[0][0] == "MIT" and all(own is None for i, (own, _) in got.items() if i > 1)
    for i in (0, 1):
        ws = texts[i].split()
        want = max((b for k in (5, 6, 7) for at in range(8 - k) if (b := scanner.best(" ".join(ws[at : at + k])))), default=None)
        assert (got[i][0] is None) == (want is None) and (want is None or abs(got[i][1] - want[0]) < 1e-9)
    old = license_scan.Scanner({w: n for w, n in count.items() if w in scanner.ids}, len(texts))
    assert old.best(texts[0]) is None


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version."""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def test_wrapped_headers_and_licence_files(spark):
    comment = lambda text: "\n".join("# " + x for x in text.split("\n"))
    texts = [
        ("LICENSE", MIT, "MIT"), ("f.py", comment(MIT), "MIT"), ("LICENSE", BSD.format(""), "BSD-2-Clause"), ("LICENSE", BSD.format(THIRD), "BSD-3-Clause"),
        ("f.py", comment(GPL.format(":", "", ",", 3)), "GPL-3.0"), ("f.c", GPL.format(";", "", ";", 2), "GPL-2.0"), ("f.c", words(8, 60) + "\n" + GPL.format(":", "Affero ", ",", 3) + "\n" + words(9, 60), "AGPL-3.0"),
        ("f.c", GPL.format(";", "Lesser ", ";", "2.1"), "LGPL-2.1"), ("f.c", GPL.format(":", "Lesser ", ",", 3), "LGPL-3.0"),
        ("f.c", "Licensed under\nthe Apache License,\nVersion 2.0.", "Apache-2.0"), ("f.c", words(5, 300), None),
    ]
    df = spark.createDataFrame([(i, f"d{i}/{name}", t) for i, (name, t, _) in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(texts)}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_whole_licence_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0"}
    names |= {"LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    names = {f: want for f, want in names.items() if os.path.exists(f"/usr/share/common-licenses/{f}")}
    rows = [(f"{f}/LICENSE", open(f"/usr/share/common-licenses/{f}", errors="replace").read()) for f in names] + [("MIT/LICENSE", MIT)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("concat('prose/', doc_id) AS path", "text")
    df = spark.createDataFrame(rows, "path string, text string").union(docs).withColumn("doc_id", F.monotonically_increasing_id())
    got = {r.path: r.own for r in license_scan.scan_licenses(df).collect()}
    assert {f: got[f"{f}/LICENSE"] for f in [*names, "MIT"]} == names | {"MIT": "MIT"}


def test_inheritance_by_brute_force(spark):
    """Random trees; ties of several licence files of one folder; a file's own notice, null paths and a very long text."""
    r = random.Random(11)
    notices = {"MIT": "Released under the MIT License.", "ISC": "Licensed under the ISC License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    folder = lambda: "/".join(r.choice("ab") for _ in range(r.randrange(5)))
    files = []
    for i in range(300):
        d = folder()
        name, text = r.choice([(f"f{i}.py", words(i, 20)), (f"f{i}.py", words(i, 20)), (f"LICENSE.{i}", notices[r.choice(list(notices))] if r.random() < 0.2 else words(i, 20)), (f"g{i}.c", notices["ISC"])])
        files.append((i, f"{d}/{name}" if d else name, text))
    files += [(300, None, "no path"), (301, "a/b/long.txt", words(1, 150_000) + "\n" + notices["MIT"] + "\n" + words(2, 150_000))]
    got = {x.doc_id: (x.own, x.license, x.license_dir) for x in license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    own = {i: next((k for k, v in notices.items() if v in t), None) for i, _, t in files}
    held = {}
    for i, path, _ in sorted(files, key=lambda f: (f[1] or "").rpartition("/")[2]):
        if path and own[i] and "LICENSE" in path:
            held.setdefault(path.rpartition("/")[0], own[i])  # equal cosines: the first name in order
    for i, path, _ in files:
        d = None if path is None else path.rpartition("/")[0]
        above = [] if d is None else [d, *(d[:k] for k in range(len(d) - 1, -1, -1) if d[k] == "/"), ""]
        near = next((x for x in above if x in held), None)
        want = (own[i], own[i], None) if own[i] else (None, held.get(near) if near is not None else None, near)
        assert got[i] == want, (i, path, got[i], want)


def test_creative_commons_family_and_notices_of_the_table(spark):
    texts = [(t, name) for name, t in license_scan.TEMPLATES if name.startswith("CC-BY")]
    assert {"CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"} <= {name for _, name in texts}
    # The distinct notices of the documents table that name a licence.
    texts += [("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")]
    prose = [(words(i, 40), None) for i in range(400)]
    df = spark.createDataFrame([(i, f"MIT/{i}/f.py", f"{words(i, 30)}\n{t}") for i, (t, _) in enumerate(texts + prose)] + [(-1, "MIT/LICENSE", "Released under the MIT License.")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.own, r.license) for r in license_scan.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(texts))] == [(want, want) for _, want in texts]
    assert all(got[i] == (None, "MIT") for i in range(len(texts), len(texts + prose)))


# 10


def brute_links(rows, percent=80):
    sets = [set(ngram_join.grams(t).tolist()) for _, t, _ in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in link[i])]) for i in range(n)]
    return link, root


def planted(seed=1):
    r, rows = random.Random(seed), []
    for i in range(30):
        rows.append((10 * i, words(100 + i, 60), "s"))
    for i in range(60):  # near copies: a few words changed
        ws = words(100 + i % 6, 60).split()
        for _ in range(r.randrange(3)):
            ws[r.randrange(60)] = f"new{r.random()}"
        rows.append((1000 + i, " ".join(ws), "s"))
    return rows + [(2000, words(100, 60), "s"), (2000, words(100, 60), "s"), (2001, words(100, 60).upper() + "!", "s"), (2002, None, "s"), (2003, "", "s"), (2004, "two words", "s"), (2005, "Two, words", "s"), (2006, "?!", "s"), (None, words(101, 60), "s"), (3000, words(9, 20000), "s"), (3001, words(9, 20000) + " end", "s")]


@pytest.mark.parametrize("block_grams", [300, 1 << 19])
def test_ngram_join(spark, block_grams):
    rows = planted()
    got = ngram_join.near_duplicates(table(spark, rows), block_grams=block_grams).collect()
    link, root = brute_links(rows)
    ids = [r[0] for r in rows]
    members = {}
    for i, x in enumerate(root):
        members.setdefault(x, []).append(ids[i])
    want = [(ids[i], ids[i] if not ngram_join.grams(rows[i][1]).size else min((m for m in members[root[i]] if m is not None), default=None), len(link[i])) for i in range(len(rows))]
    assert sorted(map(repr, ((r.doc_id, r.class_id, r.n_links) for r in got))) == sorted(map(repr, want))
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0


def test_keep_one(spark):
    rows = planted()
    kept = ngram_join.keep_one(table(spark, rows))
    _, root = brute_links(rows)
    assert kept.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert kept.count() == len(set(root))


def test_prefixes_shorten_by_the_measured_recall(spark):
    """Links near the threshold shorten prefixes, links of very similar texts alone don't; recall against brute force."""
    depth, trees = ngram_join.MAX_DEPTH, ngram_join.TREES
    chosen, lost, linked = {}, 0, 0
    for name, changes in (("alike", 1), ("apart", 14)):
        r, rows = random.Random(changes), []
        for i in range(240):
            ws = words(1000 + i // 2, 700).split()
            for _ in range(changes * (i % 2)):
                ws[r.randrange(700)] = f"new{r.random()}"
            rows.append((i, " ".join(ws), "s"))
        signed = ngram_join.signatures(table(spark, rows), "doc_id", "text", trees, depth)
        nodes = signed.select("node", "size", "signature")
        links = ngram_join.forest_links(nodes, trees, depth, ngram_join.MIN_DEPTH)
        recall = ngram_join.recall_by_band(links, nodes, 80, trees, depth, ngram_join.MIN_DEPTH)
        chosen[name] = ngram_join.choose_depth(recall, ngram_join.TARGET_RECALL)
        want, _ = brute_links(rows)
        got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(table(spark, rows)).collect()}
        linked += sum(map(len, want))
        lost += sum(len(w) - got[i] for i, w in enumerate(want))
    assert chosen["alike"] > chosen["apart"] >= ngram_join.MIN_DEPTH
    assert linked > 300 and lost <= 0.001 * linked
    assert ngram_join.choose_depth({8: [], 7: []}, 0.9) == 8 and ngram_join.choose_depth({8: [0.5], 7: [0.8]}, 0.9) == 7


@given(st.lists(st.tuples(st.integers(0, 1), st.lists(st.integers(0, 1), min_size=4, max_size=4)), min_size=1, max_size=30), st.integers(1, 7))
def test_stretches_connect_all_that_share_a_prefix(rows, batch):
    rows = sorted((t, *v) for t, v in rows)
    stretches, links = ngram_join._Stretches(4, 2), []
    for i in range(0, len(rows), batch):
        part = np.array(rows[i : i + batch])
        links += zip(*(x.tolist() for x in stretches.links(part[:, 0], part[:, 1:], np.arange(i, i + len(part)))))
    assert len(links) < len(rows)
    for depth in (2, 3, 4):
        root = list(range(len(rows)))
        for a, b, d in sorted(links):
            if d >= depth:
                root[a] = root[b]
        assert [rows[root[i]][: depth + 1] for i in range(len(rows))] == [r[: depth + 1] for r in rows]
        assert all((root[i] == root[j]) == (rows[i][: depth + 1] == rows[j][: depth + 1]) for i in range(len(rows)) for j in range(i))


def test_keep_one_leaves_columns_of_any_name(spark):
    rows = [(1, "a b c", 7, "x"), (2, "a b c", 8, "y"), (3, "", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __d0 long, __g string")
    assert sorted(map(tuple, ngram_join.keep_one(df).collect())) == [rows[0], rows[2]]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
