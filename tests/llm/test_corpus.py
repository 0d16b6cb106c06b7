"""Corpus operators against brute force, exact round trips and SQL."""

import os
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import compare
import corpus_pipeline
from cindermap.llm import html, jaccard, licenses, lines, mixing, packing, rules, sharding, token_file, tokens, topk
from cindermap.llm.sql import SQL

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, `key` string"


def docs_of(spark, pairs):
    """Documents with extra columns whose names clash with what operators use."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), 7, "x") for i, t in pairs], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "a b c d"), (5, "a b c d"), (6, "é ü\n\nß"), (7, "long " * 30000)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    ok, note = compare.compare(spark, compare.connection(SMALL), name, SMALL)
    assert ok, note


def test_edges_do_not_crash(spark):
    for pairs in (EDGES, []):
        docs, n = docs_of(spark, pairs), len(pairs)
        assert sharding.shard_by_bytes(docs, 3).count() == n
        assert lines.dedup_lines(docs).columns == docs.columns and lines.dedup_lines(docs).count() == n
        assert jaccard.similar(docs).count() == n
        assert licenses.scan(docs, licenses.known_licenses(spark)).count() == n
        assert rules.quality(docs, report=True).count() == n
        assert mixing.mix(docs, ["lang", "source"], {c: mixing.weight_of(c, {}) for c in ("lang", "source")}, 100, 1, 1).count() == sum(bool((t or "").split()) for _, t in pairs)


def test_shards_are_contiguous_and_balanced(spark):
    rng = random.Random(1)
    docs = docs_of(spark, [(i, "x" * rng.randrange(200)) for i in range(500)])
    got = sorted(sharding.shard_by_bytes(docs, 7).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 208
    for s in range(7):
        assert [r["slot"] for r in got if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))


def brute_components(pairs, size, num, den):
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    members = {}
    for i, (doc, _) in enumerate(pairs):
        members.setdefault(find(i), []).append(doc)
    return sorted((doc, len(s), min(members[find(i)])) for i, ((doc, _), s) in enumerate(zip(pairs, sets)))


@pytest.mark.parametrize("size,num,den", [(3, 9, 10), (5, 8, 10)])
def test_similar_is_exact(spark, size, num, den):
    rng = random.Random(size)
    texts = [words(rng, rng.randrange(1, 150)) for _ in range(60)] + ["", None, "one two", "ONE two", "one"]
    for base in range(3):  # chains and crowds of near copies around the threshold
        w = words(rng, 120).split()
        for _ in range(40):
            copy = list(w)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                w = copy
    order = list(range(len(texts)))
    rng.shuffle(order)
    pairs = [(i, texts[o]) for i, o in enumerate(order)]
    assert sorted(tuple(r) for r in jaccard.similar(docs_of(spark, pairs), size, num, den).collect()) == brute_components(pairs, size, num, den)


@pytest.mark.parametrize("name,leading", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_word_encoder_equals_whole_texts(name, leading):
    whole, encode, rng = Tokenizer.from_file(public_tokenizers.path(name)), tokens.encoder(public_tokenizers.path(name), leading), random.Random(2)
    whole.encode_special_tokens = True
    letters = " \n\t.,'ab Z9éÉßΣ́< | \x1cé "
    texts = ["", "don't  stop", "<|endoftext|> x", " lead", "trail ", "a\n\nb"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name,leading", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_as_the_library_reads_them(name, leading):
    path, rng = public_tokenizers.path(name), random.Random(3)
    whole, encode = Tokenizer.from_file(path), tokens.encoder(path, leading, special_as_text=False)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    parts = [*added, *map(str.upper, added), "x", " y", "\n", "  ", "É", "<|", "|>", "endoftext", "don't"]
    texts = ["x <|endoftext|> y", *added] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_hold_the_ids_of_added_tokens(spark):
    path, text = public_tokenizers.path("byte_bpe_50k.json"), "x <|endoftext|> y"
    got = packing.token_pieces(docs_of(spark, [(1, text)]), path, 64, 0).collect()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got] == [[*ids, 0]]


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs, whole = docs_of(spark, EDGES), Tokenizer.from_file(path)
    files = token_file.write_token_files(docs, str(tmp_path / "f"), path, 2, False)
    got = sorted(token_file.read_token_files(files, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    texts, place = dict(EDGES), 0
    for r in got:
        ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert r["start"] == place and np.frombuffer(r["ids"], "<u4").tolist() == ids
        place += len(ids)
    assert [r["doc_id"] for r in token_file.read_token_files(files, str(tmp_path / "f"), [6]).collect()] == [6]


def test_damaged_frame_is_noticed(tmp_path):
    import io

    import pyarrow as pa

    out = io.BytesIO()
    writer = token_file.Writer(out)
    writer.add(5, b"\1\0\0\0" * 50)
    writer.add(9, b"\2\0\0\0")
    writer.close()
    whole = out.getvalue()
    assert token_file.Reader(pa.BufferReader(whole)).document(1) == b"\2\0\0\0"
    entry = whole.rindex(token_file.checksum(b"\2\0\0\0").to_bytes(4, "little"))
    with pytest.raises(ValueError, match="damaged"):
        token_file.Reader(pa.BufferReader(whole[:entry] + b"\0\0\0\0" + whole[entry + 4 :])).document(1)


def test_packing_is_whole_and_tight(spark):
    path, window = public_tokenizers.path("byte_bpe_50k.json"), 64
    rng = random.Random(4)
    pairs = [(i, words(rng, rng.randrange(0, 90))) for i in range(150)] + [(200, None), (201, "z " * 3000)]
    got = packing.pack_documents(docs_of(spark, pairs), path, window, 0).collect()
    whole, by_doc, by_sequence = Tokenizer.from_file(path), {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in pairs:
        parts = sorted(by_doc[doc], key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in parts)
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert {r["doc_tokens"] for r in parts} == {len(ids) // 4}
    for parts in by_sequence.values():
        place = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= window
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= total / window * 1.03 + 1


def test_fullest_is_the_best_filling():
    rng = random.Random(5)
    for _ in range(200):
        window = rng.randrange(5, 40)
        counts = {rng.randrange(1, window + 1): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        sums = {max(counts)}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c - (n == max(counts)) + 1) if s + n * k <= window}
        chosen = packing.fullest(counts, window)
        assert sum(n * k for n, k in chosen.items()) == max(sums) and all(k <= counts[n] for n, k in chosen.items())


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [1.0]), (None, [0.0] * 8)]
    rows += [(i, rows[0][1]) for i in range(310, 340)]  # ties
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, F.col("vec_id") % 20 == 0).collect()
    whole = {i: np.floor(64 * np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_html_text(spark):
    page = '<html><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div><div class="post-{n}"><h1>T{n} &amp; x</h1><p>First\n  para &eacute;<p>Second <b>bold</b><script>if(a<b){{}}</script><form>Send</form><div class="ad">Buy</div></div><section class="comments"><p>{long}</section><aside>Side</aside><footer>Foot</footer>'
    rows = [(i, "http://h.example/1", page.format(n=i, long="I say " * 50)) for i in range(3)] + [(9, None, None), (10, "x", ""), (11, "//h.example", "plain &lt;text")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["text"] for i in range(3)] == [f"T{i} & x\nFirst para é\nSecond bold" for i in range(3)]
    assert got[9]["text"] == got[10]["text"] == "" and got[9]["n_chars"] == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_do_not_drop_the_article():
    def read(page):
        blocks = html.blocks_of(page)
        return html.text_at(blocks, html.best_path(blocks)[0])

    text = "Word after word. " * 20
    long, plain = f"<p>{text}</p>", text.strip()
    assert read(f'<article><header class="entry-header"><h1>Title</h1></header>{long}</article>') == f"Title\n{plain}"
    assert read(f'<div class="layout has-sidebar"><article><h1>Title</h1>{long}</article><div class="sidebar">Side</div></div>') == f"Title\n{plain}"
    assert read(f'<div class="layout has-sidebar"><div class="text"><h1>Title</h1>{long}</div></div>') == f"Title\n{plain}"
    assert read(f'<article>{long}<section id="discussion"><h2 id="search">Search</h2><p>End</p></section><div class="share">Share</div></article>') == f"{plain}\nSearch\nEnd"
    assert read(f'<div class="post comments-open"><h1>Title</h1>{long}</div>') == f"Title\n{plain}"
    assert read(f'<div class="post">{long}<section id="discussion"><p>End</p></section></div>') == f"{plain}\nEnd"
    assert read(f'<article><p>Start<svg viewBox="0 0 1 1"/> on</p><math/>{long}</article>') == f"Start on\n{plain}"
    assert read(f'<article>{long}</article><div class="related"><article>Other</article></div><div class="cookie-notice">{long * 5}</div>') == plain


def test_container_climbs_to_the_title(spark):
    long = "word after word. " * 180
    shapes = {
        "div": '<div id="page"><div class="logo">Name</div><div class="post"><h1>Title {n}</h1><p>Lead {n}</p><div class="wrap"><div class="body"><p>{long}{n}</p></div></div></div></div>',
        "article": '<article><h1>Title {n}</h1><p>Lead {n}</p><div><div class="body"><p>{long}{n}</p></div></div></article><p>Around</p>',
        "list": '<div class="post"><h2>Title {n}</h2><p>Lead {n}</p><ul><li>{long}{n}</ul></div>',
    }
    rows = [(f"{name} {n}", f"http://{name}.example/{n}", "<body>" + page.format(n=n, long=long)) for name, page in shapes.items() for n in range(3)]
    rows.append(("one 0", "http://one.example/", "<body>" + shapes["list"].format(n=0, long=long)))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {i: f"Title {i[-1]}\nLead {i[-1]}\n{long}{i[-1]}" for i, _, _ in rows}


def test_line_windows_that_overlap(spark):
    docs = docs_of(spark, [(1, "a\n" * 5 + "z"), (2, "x\na\n\n a \na\ny"), (3, "p\nq\nr\ns"), (4, "p\nq\nr\ns")])
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: "a\na\na\nz", 2: "x\n\ny", 3: "p\nq\nr\ns", 4: ""}


def test_line_ends_do_not_hide_a_passage(spark):
    docs = docs_of(spark, [(1, "p\nq\nr\ns"), (2, "x\r\np\r\n\r\nq\t\r\nr\r\ny\r"), (3, "a\r\n\r\n\r\n\r\nb"), (4, "c\r\n\r\n\r\n\r\nd")])
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: "p\nq\nr\ns", 2: "x\r\n\r\ny\r", 3: "a\r\n\r\n\r\n\r\nb", 4: "c\r\n\r\n\r\n\r\nd"}


def test_license_spellings(spark):
    mit = dict((n, t) for n, t in licenses.KNOWN if len(t) > 500)["MIT"]
    docs = docs_of(spark, [(1, "Copyright (c) 2020 X\n" + mit.upper().replace("LICENSE", "Licence")), (2, "text\nreleased under the  MIT licence!\nmore"), (3, "released under the MIT licence or not")])
    got = {r["doc_id"]: (r["whole_license"], r["licenses"]) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "MIT") and got[3] == (None, "")


def whole_texts():
    return licenses.whole_texts()


def rewrapped(text, width):
    """The paragraphs of a text that state no copyright, with lines of at most ``width`` characters."""
    paragraphs = [p for p in re.split(r"\n\s*\n", text) if not re.search(r"(?i)copyright +(\(c\)|[\[<©0-9])", p)]
    return "\n\n".join("\n".join(textwrap.wrap(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)) for p in paragraphs)


def test_licenses_in_any_layout(spark):
    pairs = [(name, rewrapped(text, width), rewrapped(text, 10**6)) for name, text in whole_texts() for width in (20, 33, 60, 65, 70, 72, 76, 78, 80, 100)]
    df = spark.createDataFrame(pairs, "name string, wrapped string, flat string")
    got = df.select("name", (licenses.joined(licenses.canonical("wrapped")) == licenses.joined(licenses.canonical("flat"))).alias("same")).collect()
    assert len(got) == len(pairs) and not [r["name"] for r in got if not r["same"]]
    isc = dict((n, t) for n, t in licenses.KNOWN if len(t) > 500)["ISC"]
    usual = "Copyright (c) 2020, X\n\n" + isc.replace("above copyright notice", "above\ncopyright notice")
    stated = ["Copyright 2020 X", "Copyright (C) X", "copyright by X", "Copyright Jane Doe", "Copyright The Project Authors", "(c) X 2020", "© X", "All rights reserved."]
    docs = docs_of(spark, [(0, usual)] + [(i, f"{line}\n{isc}") for i, line in enumerate(stated, 1)])
    assert {r["whole_license"] for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()} == {"ISC"}


def test_whole_licenses_are_found(spark):
    texts = licenses.whole_texts()
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "MIT", "ISC"} <= {n for n, _ in texts}
    docs = docs_of(spark, [(2 * i, t) for i, (_, t) in enumerate(texts)] + [(2 * i + 1, f"Project\n\nCopyright (c) 2020 X\n\n{t}\n\nMore of it.") for i, (_, t) in enumerate(texts)])
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    for i, (name, _) in enumerate(texts):
        assert got[2 * i]["whole_license"] == name and got[2 * i + 1]["whole_license"] is None, name
        assert name in got[2 * i]["licenses"].split(",") and name in got[2 * i + 1]["licenses"].split(","), name
    mit = dict((n, t) for n, t in licenses.KNOWN if len(t) > 500)["MIT"]
    cut = licenses.scan(docs_of(spark, [(1, mit.rsplit("\n\n", 1)[0])]), licenses.known_licenses(spark)).collect()[0]
    assert (cut["whole_license"], cut["licenses"]) == (None, "")


def test_cascade_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    verdicts = [sorted(map(tuple, rules.judge(docs, order).collect())) for order in (rules.RULES, rules.RULES[::-1])]
    assert verdicts[0] == verdicts[1]
    costly, cheap = rules.Rule("costly", lambda m: True), rules.Rule("cheap", lambda m: True)
    assert rules.ordered([(costly, 2.0, 0.5), (cheap, 1.0, 0.5)]) == (cheap, costly)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SMALL)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if not any(x.rejects(rules.Measures(r["text"])) for x in rules.RULES)}
    clean = stages["line dedup"](spark, kept, SMALL)
    assert clean.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    pairs = [(r["doc_id"], r["text"]) for r in clean.collect()]
    single = stages["n-gram Jaccard join"](spark, clean, SMALL)
    assert {r["doc_id"] for r in single.collect()} == {d for d, n, c in brute_components(pairs, 5, 8, 10) if n == 0 or d == c}
    mixed = stages["mixing sources to target weights"](spark, single, SMALL)
    assert mixed.columns == docs.columns and mixed.count() == mixed.select("doc_id").distinct().count() <= single.count()
    out = stages["packing"](spark, mixed, SMALL).collect()
    encode = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    whole = {r["doc_id"]: encode(r["text"]) + b"\0\0\0\0" for r in mixed.collect()}
    assert sum(r["length"] for r in out) == sum(len(t) // 4 for t in whole.values())
    assert all(r["ids_crc32"] == zlib.crc32(whole[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in out)
    assert os.path.isdir(SMALL)
