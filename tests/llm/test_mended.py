"""Inputs that corpus operators once lost, dropped or failed on."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cindermap.llm import html, mixing, rules, topk

P = "<p>" + "word " * 60 + "</p>"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def main_text(page):
    blocks = html.blocks_of(page)
    best = html.best_path(blocks)
    return html.text_at(blocks, html._climbed(best)) if best else ""


def test_a_form_around_the_page_is_read():
    assert main_text(f'<body><form id="aspnetForm"><h1>T</h1>{P}</form></body>').startswith("T\nword")
    assert main_text(f"<body><form><div>{P}</div></form></body>").startswith("word")
    assert "Mail" not in main_text(f"<body><article><h1>T</h1>{P}<form>Mail <input></form></article></body>")


def test_titles_in_boxes_called_header_stay():
    page = f'<body><div class="post"><div class="post-header"><h1>Title</h1></div><div class="post-body">{P}</div></div></body>'
    assert main_text(page).startswith("Title\nword")
    masthead = f'<body><div class="header"><h1>Site</h1></div><div class="post"><h1>Title</h1>{P}</div></body>'
    assert main_text(masthead).startswith("Title\nword")


def test_names_hide_no_part_of_a_sentence():
    page = '<body><article><p>We met at a <span class="social">social</span> club, see the <a class="related">related work</a> of 2.</p>' + P + '<span class="ad">Buy</span></article></body>'
    text = main_text(page)
    assert text.startswith("We met at a social club, see the related work of 2.\n") and "Buy" not in text


def test_pages_without_body_tag_are_read():
    assert main_text("<p>Hello <b>there</b></p><p>again</p>") == "Hello there\nagain"


@pytest.mark.parametrize("piece", ["<a ", "<div>text", "<font>x ", '<a "', "<a href='x", "< ", "<svg/><p>t", "<p>t</a>", "<div class=x>", "</p>", "<!-- ", "<li>x</ul>"])
def test_hostile_pages_take_linear_time(piece):
    def seconds(size):
        page = piece * (size // len(piece))
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    small, large = seconds(100_000), seconds(400_000)
    assert large < 40 and large < 12 * max(small, 0.05)


def test_deep_nesting_loses_no_text():
    page = "<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></body>"
    texts = [text for _, text, _ in html.blocks_of(page)]
    assert texts == ["deep", "after"]


def test_sample_limit_is_above_zero_at_any_size():
    assert rules.sample_limit(1_000, 2_000) == 1 << 63
    for rows in (10**10, 10**13):
        assert rules.sample_limit(rows, 2_000) / 2**63 == pytest.approx(2_000 / rows)
    assert rules.sample_limit(0, 2_000) == 1 << 63


def test_nulls_and_copies_do_not_fill_the_sample(spark, monkeypatch):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("one text for all of them")).alias("text"))
    seen = spark.sparkContext.accumulator(0)

    def count(m):
        seen.add(1)
        return m.text is None

    rules.estimate(docs, [rules.Rule("counts", count)], sample_rows=500)
    assert 300 < seen.value < 700


def test_categories_of_weight_zero_take_nothing(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en" if i % 2 else "de", "s", 7) for i in range(40)], DOCS)
    weights = {"lang": mixing.weight_of("lang", {"de": 0}), "source": mixing.weight_of("source", {})}
    taken = mixing.mix(docs, ["lang", "source"], weights, 50, 1, 3)
    assert {r["lang"]: r["count"] for r in taken.groupBy("lang").count().collect()} == {"en": 20}
    none = mixing.mix(docs, ["lang", "source"], {"lang": mixing.weight_of("lang", {}, 0), "source": weights["source"]}, 50, 1, 3)
    assert none.count() == 0
    with pytest.raises(ValueError):
        mixing.weight_of("lang", {"de": -1})


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text), (7, text), (8, text), (7, "quite another text of seven words here"), (None, None), (None, None), (1, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(7, text), (7, rows[4][1]), (None, None), (None, None), (1, "")], key=repr)


def test_mixture_tells_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(i // 4, f"a b c {i}", "en", "src0", 9) for i in range(40)], DOCS)
    kept = corpus_pipeline.mixture(spark, docs, "")
    assert kept.count() == 32 and kept.distinct().count() == 32


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_top_k_searches_each_length_by_itself(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 9.0]), (2, [2.0, 1.0]), (3, [1.0]), (20, [3.0]), (4, [2.0]), (40, []), (5, []), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, 2, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 64 * 128), (0, 2, 1, 64 * 32), (20, 1, 4, 192 * 128), (20, 2, 3, 192 * 64), (40, 1, 5, 0), (40, 2, 6, 0)]
    assert topk.top_k(df.limit(0), 2, F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df, 2, F.col("vec_id") < 0).count() == 0
    assert topk.top_k(df.filter("size(embedding) = 0"), 2, F.col("vec_id") == 40).count() == 2
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e308]), (1, [1.0])], df.schema), 1, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("scale", [1, 10**9])
def test_lists_are_read_until_outsiders_cannot_qualify(scale):
    rng = np.random.default_rng(4)
    c = np.floor(64 * rng.exponential(size=(3000, 6)) ** 4) * scale  # few rows have large components
    q = np.floor(64 * np.abs(rng.normal(size=(40, 6))))
    kind = topk._exact(q, c)
    lists, own = topk.Lists(topk._typed(c, kind)), np.zeros((40, 3000), bool)
    own[:, :5] = True
    seen, whole = {}, np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T
    for at, rows, scores, read in topk.best_in_block(topk._typed(q, kind), lists, 10, own):
        best = sorted(((-int(s), int(r)) for r, s in zip(rows, scores)))[:10]
        assert [-s for s, _ in best] == sorted((int(v) for v in whole[at][5:]), reverse=True)[:10]
        assert all(int(s) == whole[at][r] for r, s in zip(rows, scores))
        seen[at] = read
    assert len(seen) == 40 and sum(read < 3000 for read in seen.values()) > 5
    # a bar that no row reaches ends a query at once
    high = np.full(40, float(whole.max()) + 1)
    assert {(len(rows), read) for _, rows, _, read in topk.best_in_block(topk._typed(np.abs(q) * 0 + 1, kind), lists, 10, own, high)} <= {(0, r) for r in range(3001)}


def test_bars_go_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "QUERY_BYTES", 400)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, 6, F.col("vec_id") % 5 == 0, report=True)
    assert got.agg(F.min("read_share") > 0, F.max("read_share") <= 1).first()[:] == (True, True)
    whole = np.floor(64 * x)
    want = []
    for i in range(0, 120, 5):
        best = sorted((-int(whole[i] @ whole[j]), j) for j in range(120) if j != i)[:6]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r)[:4] for r in got.collect()) == want
