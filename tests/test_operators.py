from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import repair, splitting
from textloom.operators import article, book, graph, packing, sampling
from textloom.plans.catalog import registered
from textloom.plans.packing import sample_files
from textloom.sources import files, html

PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">home</a></nav>
<article class="post"><h1>Title</h1><p>First <b>bold</b><p>Second<ul><li>one<li>two</ul><h2>Sub</h2><p>First <b>bold</b></p></article><footer>f</footer></body></html>"""


def test_blocks_of_a_loose_page():
    found = html.block_rows(PAGE)
    assert [(t, x) for _, t, x, _, _ in found] == [("h1", "Title"), ("p", "First bold"), ("p", "Second"), ("li", "one"), ("li", "two"), ("h2", "Sub")]
    assert found[3][3] == "Title" and found[5][3] == "Title" and found[3][4]


def test_nodes_sum_up_texts_and_links():
    nodes = html.parse_nodes(PAGE)
    body = next(n for n in nodes if n["tag"] == "body")
    assert body["link_count"] == 1 and body["link_len"] == 4
    assert body["text_len"] - body["noise_len"] == body["readable"]
    assert next(n for n in nodes if n["tag"] == "article")["paragraphs"] == 3
    assert html.parse_nodes("") == []


def test_article_root_is_the_article(spark):
    page = "<body><div class='nav'>" + "<a href='#'>link text here</a>" * 30 + "</div><article>" + "<p>A sentence of plain prose, with words.</p>" * 30 + "</article></body>"
    rows = spark.createDataFrame([(1, page), (2, "<body><p>tiny</p></body>"), (3, None)], "page_id long, html string")
    roots = {r["page_id"]: r["tag"] for r in article.article_roots(html.nodes(rows)).collect()}
    assert roots == {1: "article", 2: "body"}


def test_files_of_every_format():
    by = {path: files.file_segments(path, data) for path, data in sample_files()}
    text = lambda p: [r[5] for r in by[p]]
    assert text("a/plain.txt") == ["CHAPTER ONE", "Some text.", "More text."]
    assert by["a/plain.txt"][1][4] == "CHAPTER ONE" and by["a/plain.txt"][0][3] == "heading"
    assert text("a/wide.txt") == ["para"]
    assert text("a/page.html") == ["Head", "Body text."]
    assert text("a/word.docx") == ["Opening", "First & second"]
    assert text("a/book.epub") == ["The Book", "Early text.", "Second", "Later text."]  # the spine's order
    assert by["a/evil.docx"][0][6] == "unsafe path in archive"
    assert by["a/bad.txt"][0][6] and by["a/none.xyz"][0][6]


def test_splits_keep_every_character():
    rng = random.Random(1)
    for n in (0, 10, 5000, 20000):
        text = "".join(rng.choice("abc. \n!?é") for _ in range(n))
        pieces = splitting.split_keeping_separators(text, 400)
        assert "".join(s + t for t, s in pieces) == text
        assert all(len(t) <= 400 for t, _ in pieces)
        for split in (splitting.split_at_stops, splitting.split_for_import):
            assert Counter("".join(split(text)).replace(" ", "").replace("\n", "")) == Counter(text.replace(" ", "").replace("\n", ""))


def test_numbers():
    assert [splitting.chinese_number(x) for x in ("十", "三百二十一", "两万零五", "九千")] == [10, 321, 20005, 9000]
    assert splitting.english_numbers("two hundred and five men and one million") == [205, 1000000]
    assert splitting.english_numbers("nothing and more") == []


def test_json_repair():
    assert repair.repaired('x {"a": [1, {"b": "c') == '{"a":[1,{"b":"c"}]}'
    assert repair.repaired("no json") is None and repair.repaired(None) is None
    assert repair.leaves('{"a":["x",{"b-c":"y"}],"n":1}') == [("$.a[0]", "x"), ("$.a[1]['b-c']", "y")]
    assert repair.with_path('{"a":["x",{"b-c":"y"}]}', "$.a[1]['b-c']", "z") == '{"a":["x",{"b-c":"z"}]}'


def test_chunks_end_at_headings(spark):
    rows = [(1, i, "h2" if i in (4, 12) else "p", "w" * 400) for i in range(16)]
    blocks = spark.createDataFrame(rows, "page long, position long, tag string, text string")
    out = {r["position"]: r["chunk"] for r in packing.chunk(blocks, ["page"], ["position"], "text", "tag", target=360, look=5).collect()}
    # 120 tokens a block: at block 3 the target is passed and the heading at 4 is near, so the chunk runs up to it
    assert [out[i] for i in range(5)] == [1, 1, 1, 1, 1]
    assert out[5] == 2 and out[12] != out[13]


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(1, 50)) for g in range(20) for i in range(rng.randrange(1, 40))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, n long")
    once = packing.pack(df.coalesce(1), ["g"], ["i"], "n", 100, 6)
    many = packing.pack(df.repartition(7), ["g"], ["i"], "n", 100, 6)
    assert once.exceptAll(many).count() == 0
    assert once.groupBy("g", "batch").agg(F.sum("n").alias("s"), F.count("n").alias("c")).where("c > 6 or (s > 100 and c > 1)").count() == 0


def test_components_of_long_chains(spark):
    rows = [(f"n{i:03d}", [f"a{i}", f"A{i + 1}"]) for i in range(40)] + [("z", ["only"])]
    found = graph.shared_name_components(spark.createDataFrame(rows, "node string, names array<string>"))
    assert {r["component"] for r in found.collect() if r["node"] != "z"} == {"n000"}


def test_diverse_and_sides(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "b"]), (1, 3, ["c"]), (2, 1, ["x"])], "g long, o long, t array<string>")
    assert sorted((r["g"], r["o"]) for r in sampling.diverse(rows, "g", "o", "t", 5).collect()) == [(1, 1), (1, 3), (2, 1)]
    sides = sampling.stable_sides(spark.range(500), "id", 3)
    assert 150 < sides.where("swapped").count() < 350


def test_packing_reads_a_hot_group_as_a_stream(spark):
    """Batches of a group that spans many Arrow frames, and of null groups, as a plain loop gives them."""
    rng = random.Random(9)
    rows = [(1 if i % 3 else (None if i % 2 else i), i, rng.randrange(1, 60)) for i in range(4000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.i: r.batch for r in packing.pack(spark.createDataFrame(rows, "g long, i long, n long"), ["g"], ["i"], "n", 100, 6).collect()}
        picks = spark.createDataFrame([(g, i, [str(n % 7), str(n % 3), str(n % 2)]) for g, i, n in rows], "g long, o long, t array<string>")
        kept = sorted((r.g is not None, r.g or 0, r.o) for r in sampling.diverse(picks, "g", "o", "t", 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, sets = {}, {}
    state: dict = {}
    for g, i, n in rows:
        batch, held, total = state.get(g, (0, 0, 0))
        if held == 0 or held >= 6 or total + n > 100:
            batch, held, total = batch + 1, 0, 0
        state[g] = batch, held + 1, total + n
        want[i] = batch
        own = {str(n % 7), str(n % 3), str(n % 2)}
        chosen = sets.setdefault(g, [])
        if len(chosen) < 5 and all(len(own & k) < 0.85 * len(own | k) for _, k in chosen):
            chosen.append((i, own))
    assert got == want
    assert kept == sorted((g is not None, g or 0, i) for g, chosen in sets.items() for i, _ in chosen)


def test_pieces_leave_in_bounded_batches():
    schema = pa.schema([("id", pa.int64()), ("pieces", pa.int32()), ("piece", pa.int32()), ("separator", pa.string()), ("text", pa.string())])
    texts = ["word " * 400_000, None, "", "short", "word " * 400_000]
    frames = iter([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["id", "text"])])
    sizes, joined = [], {}
    for batch in splitting.cut_rows(frames, splitting.split_keeping_separators, schema):
        sizes.append(sum(map(len, batch.column("text").to_pylist())))
        for r in batch.to_pylist():
            joined[r["id"]] = joined.get(r["id"], "") + r["separator"] + r["text"]
    assert max(sizes) <= splitting.BATCH_CHARS + splitting.EXACT_SIZE and len(sizes) > 3
    assert joined == {i: t for i, t in enumerate(texts) if t}


def test_words_of_a_sentence_are_made_once(spark):
    plan = registered()["flagship_repeated_passages"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # in both sides of the join of passages
    assert plan.count("[^\\p{L}\\p{N}]+") == 2


def test_repeated_passages_are_counted_by_digests(spark, monkeypatch):
    rng = random.Random(3)
    said = [f"passage number {x} stands here" for x in "zyxwvutsrqponmlk"]
    rows = [(i, rng.choice(["a", "b", None]), " ".join(f"{p.capitalize()}." for p in rng.choices(said, k=4))) for i in range(40)] + [(50, "a", "Only once in all of them. Short one."), (51, None, None), (52, "a", "zz. passage number Z   stands here!\nPassage number z stands here?")]
    rows += [(60, "a", "One segment with two chapters."), (60, "b", "One segment with two chapters.")]
    where = {}
    for segment, chapter, text in rows:
        for p in [*said, "one segment with two chapters"]:
            if text and p in " ".join(text.lower().replace("\n", " ").split()):
                where.setdefault(p, set()).add((segment, chapter))
    ordered = sorted(((p, w) for p, w in where.items() if len(w) > 1), key=lambda x: (-len(x[1]), -len({c for _, c in x[1]} - {None}), x[0]))
    want = [(p, len(w), len({c for _, c in w} - {None}), min(w)[0], max(i for i, _ in w), ",".join(str(i) for i in sorted(i for i, _ in w)[:3])) for p, w in ((p, sorted(w, key=lambda x: x[0])) for p, w in ordered)]
    frame = spark.createDataFrame(rows, "segment long, chapter string, text string")
    written, saved = [], book.ledger.saved
    monkeypatch.setattr(book.ledger, "saved", lambda rows: written.append(rows.columns) or saved(rows))
    for top, sent in ((5, 1 << 17), (16, 0), (100, 1 << 17), (100, 0)):
        monkeypatch.setattr(book, "SENT_ROWS", sent)
        got = sorted(map(tuple, book.repeated_passages(frame, top, 3).collect()), key=lambda r: (-r[1], -r[2], r[0]))
        assert got == want[:top]
    assert written[0] == ["k1", "k2", "segment", "chapter"]
    assert book.repeated_passages(frame.where("segment = 50")).count() == 0
