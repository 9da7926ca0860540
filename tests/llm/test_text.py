"""Tokens, packing, HTML and WARC."""

import base64
import hashlib
import time
import zlib

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from weftgraph.llm import htmltext, packing, pretokens, tokencount, warc
from weftgraph.llm.shared import shared_dir

ODD = ["", None, "I'M İstanbul ΣΑΣ don't 12½", "x<|endoftext|>y <|ENDOFTEXT|>", "é́ aaaaaaaaaaaaaaa", "日本語 テキスト", "ﬁ ŉ Ǆ \x1c\x85 a", "a" * 3000, "  \n\t "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencount.vocabulary())


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_merging_gives_the_librarys_ids(library):
    model = pretokens.ArrayBpe(tokencount.vocabulary())
    texts = [t or "" for t in ODD]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.ids(texts)] == want
    assert pretokens.ArrayBpe(tokencount.vocabulary()).counts(ODD) == [len(x) for x in want]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "日本語人大学中国", "ab", "aéñ"])
def test_long_runs_of_letters_merge_as_in_the_library(library, letters):
    rng = np.random.default_rng(len(letters))
    texts = ["".join(rng.choice(list(letters), n)) for n in (127, 128, 129, 500, 20_000)]
    texts += [f"{texts[3]} a word {texts[2]}, {texts[3][::-1]}", " ".join(x[:200] for x in texts)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = pretokens.ArrayBpe(tokencount.vocabulary()).ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_both_orders_of_merging_agree(library, seed):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("aab eé日\n1x"), rng.integers(0, 60))) for _ in range(300)]
    by_rank = pretokens.ArrayBpe(tokencount.vocabulary())
    by_rank.LONG = 0
    assert by_rank.ids(texts) == pretokens.ArrayBpe(tokencount.vocabulary()).ids(texts)
    assert by_rank.counts([]) == [] and by_rank.ids(["", None]) == [b"", b""]


def test_one_text_of_200_000_letters(library):
    text = "".join(np.random.default_rng(9).choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    began = time.process_time()
    (n,) = pretokens.ArrayBpe(tokencount.vocabulary()).counts([text])
    assert n == len(library.encode(text, add_special_tokens=False).ids)
    assert time.process_time() - began < 20  # quadratic: minutes


def test_given_documents_are_counted_as_by_the_library(spark, library, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = tokencount.op5_token_counts(spark, sf_dir).toPandas().set_index("doc_id")
    want = [len(e.ids) for e in library.encode_batch(docs["text"].fillna("").tolist(), add_special_tokens=False)]
    assert got.loc[docs["doc_id"], "n_tokens"].tolist() == want
    assert got.loc[docs["doc_id"], "over_limit"].tolist() == [n > 2048 for n in want]


def test_token_counts_of_odd_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "one two", "x"), (2, ODD[2], "x")]
    got = tokencount.token_counts(table(spark, rows, "doc_id long, text string, n_tokens string")).toPandas()
    assert len(got) == len(rows)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    assert sorted(got["n_tokens"]) == want
    assert tokencount.token_counts(table(spark, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_a_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip((rng.lognormal(5, 1.5, 3000)).astype(int), 1, 1000)
    if seed == 3:
        lengths[:] = 700  # ties only
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.packed(histogram, 1000, groups=16)
    fill, ranks = {}, {}
    for size, first_rank, many, first, offset in plan.rows:
        ranks.setdefault(size, []).append((first_rank, many))
        for j in range(many):
            fill.setdefault(first + j, []).append((offset, size))
    for size, n in histogram.items():
        at = 0
        for first_rank, many in sorted(ranks[size]):
            assert first_rank == at
            at += many
        assert at == n
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1000
    bound = len(lengths) if seed == 3 else -(-int(lengths.sum()) // 1000)
    assert plan.sequences <= bound * 1.01 + 2
    assert packing.packed({}).sequences == 0


def test_given_documents_are_packed_whole(spark, library, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = packing.op10_pack(spark, sf_dir).toPandas()
    want = set()
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want |= {(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)


def test_packed_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two"), (3, ODD[3]), (90, "word " * 9000)]
    got = packing.pack(table(spark, [(*r, 1) for r in rows], "doc_id long, text string, offset int")).toPandas()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows if k is not None}
    for r in got[got["doc_id"].notna()].itertuples():
        own = ids[int(r.doc_id)][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert got["length"].sum() == sum(map(len, ids.values())) + len(ids[3]) + len(library.encode("one two", add_special_tokens=False).ids) + 1
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert (x["offset"] == np.r_[0, x["length"].cumsum()[:-1]]).all() and x["length"].sum() <= 4096
    assert packing.pack(table(spark, [], "doc_id long, text string")).count() == 0


def test_main_text_of_pages(spark):
    pages = [
        (1, "u", "<nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four &lt;x&gt;\n five</p><aside>no</aside></article><div class='comments'>no</div><script>var a='<p>'</script><footer>no</footer>"),
        (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<article>only</article>"),
        (4, "u", "<div class=\"ad\" title=\">\">x</div><main>kept<!-- not > this --></main>"),
        (5, "u", "<p>unclosed <i>text"), (6, "u", "<article><p class=ad>no<p>yes</article>"), (7, "u", "a < b and c"),
    ]
    got = htmltext.extract(table(spark, [(*p, 9) for p in pages], "page_id long, url string, html string, n_chars int")).toPandas()
    texts = {None if pd.isna(i) else int(i): t for i, t in zip(got["page_id"], got["text"])}
    assert texts == {1: "A & B One two three Four <x> five", 2: "", 3: "", None: "only", 4: "kept", 5: "unclosed text", 6: "yes", 7: "a < b and c"}
    assert len(got) == len(pages) and (got["n_chars"] == got["text"].str.len()).all()
    assert htmltext.extract(table(spark, [], "page_id long, url string, html string")).count() == 0


def test_names_mark_by_whole_words(spark):
    nodes = htmltext.trained(spark)
    text = lambda h: htmltext.main_text(h, lambda f: htmltext.keeps(nodes, f))
    assert text("<body class='no-sidebar'><article><p>All of it.</p></article></body>") == "All of it."
    assert text("<article><div class='overflow-hidden'>In.</div><p class='share-price'>Nine.</p></article>") == "In. Nine."
    assert text("<div class='page-with-sidebar'><article><h1 class='entry-header'>Title</h1><p>Text.</p></article></div>") == "Title Text."
    assert text("<article><p>Kept.</p><div hidden>not seen</div><div class='comment-list'><p>I read it.</p></div><div class='sidebar left'>no</div></article>") == "Kept."


def test_neighbours_decide_without_a_marked_article(spark):
    nodes = htmltext.trained(spark)
    used = {htmltext.FEATURES[n[0]] for n in nodes if len(n) > 1}
    assert {"words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density"} <= used
    text = lambda h: htmltext.main_text(h, lambda f: htmltext.keeps(nodes, f))
    long, links = "<p>" + "word " * 45 + "</p>", "<ul>" + "<li><a href=x>one two three</a></li>" * 3 + "</ul>"
    assert text(f"{long}<p>a short line</p>{long}").count("a short line") == 1
    assert "a short line" not in text(f"{long}<p>a short line</p>{links}")
    assert "Seen too" not in text(f"{long}<h2>Seen too</h2>{links}") and "Next part" in text(f"{long}<h2>Next part</h2>{long}")


def test_given_pages_hold_their_articles(spark, sf_dir):
    """Against another way of reading: the article element alone, by regular expressions."""
    import html
    import re

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = htmltext.op1_extract(spark, sf_dir).toPandas().set_index("page_id")["text"]
    seen = 0
    for r in pages.itertuples():
        inside = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        if inside:
            seen += 1
            plain = re.sub(r"</?[bi]>", "", re.sub(r"<!--.*?-->", "", inside[1], flags=re.S))
            assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())
    assert seen > 0.9 * len(pages)


def test_very_long_pages(spark):
    body = "<p>" + "word &amp; " * 300_000 + "</p>"
    got = htmltext.extract(table(spark, [(1, "u", f"<nav>x</nav><article>{body}</article>")], "page_id long, url string, html string")).first()
    assert got["n_chars"] == len("word & " * 300_000) - 1 and got["text"].endswith("word &")


def test_the_tree_fits_its_table(spark):
    nodes = htmltext.trained(spark)
    assert all(htmltext.keeps(nodes, r[:-1]) == bool(r[-1]) for r in htmltext.labelled_rows())


def test_archives_round_trip(spark):
    page = "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response</p>"
    pages = [(1, "http://a/\r\nx y", page), (2, None, page), (3, "u", "other"), (4, "u", None), (5, "u", ""), (None, "u", page), (2, None, page), (6, "u", "z" * 100_000)]
    got = warc.archived(table(spark, [(*p, "k") for p in pages], "page_id long, url string, html string, salt string")).toPandas()
    assert len(got) == len(pages)
    for r in got.itertuples():
        digest = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): len((h or "").encode()) for i, _, h in pages if i == (None if pd.isna(r.page_id) else r.page_id)}
        assert digest[r.payload_digest] == r.payload_bytes
    kinds = sorted((None if pd.isna(i) else int(i), k, None if pd.isna(r) else int(r)) for i, k, r in zip(got["page_id"], got["record_type"], got["refers_to"]) if not pd.isna(i))
    assert kinds == [(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "revisit", 5), (5, "response", None), (6, "response", None)]
    assert set(got.loc[got["page_id"].isna(), "record_type"]) == {"response"}
    assert page in set(got["payload"])
    assert warc.archived(table(spark, [], "page_id long, url string, html string")).count() == 0


def test_record_headers(spark):
    """Every record has its own identifier; a revisit names its response's, its address and date."""
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (2, "http://a/2", "same"), (None, "http://a/0", "same"), (3, "http://a/3", "other")]
    path = shared_dir(spark)
    warc.write_archives(warc.resolved(table(spark, pages, "page_id long, url string, html string")), path)
    found = [h for f in spark.read.format("binaryFile").load(path).collect() for h, _ in warc.records_of(bytes(f["content"]))]
    ids = {h["warc-record-id"]: h for h in found}
    assert len(ids) == len(pages) and all(x.startswith("<urn:uuid:") and len(x) == 47 for x in ids)
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert len(revisits) == 2
    for h in revisits:
        to = ids[h["warc-refers-to"]]
        assert (to["warc-type"], to["warc-target-uri"], to["warc-date"]) == ("response", h["warc-refers-to-target-uri"], h["warc-refers-to-date"])


def test_files_are_bounded_by_bytes(spark):
    many = spark.range(1000).select("id", F.lit("u").alias("url"), F.repeat(F.lit("x"), 100_000).alias("html"))
    assert warc.records_a_file(many) * 100_000 < warc.FILE_BYTES < warc.records_a_file(many) * 400_000
    assert warc.records_a_file(many.limit(0)) == warc.RECORDS_A_FILE


def test_small_payloads_are_never_revisited(spark):
    got = warc.archived(table(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string"), least_bytes=3)
    assert {(r.page_id, r.record_type) for r in got.collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


TEXT = "This paragraph of the article has a good number of words and says what there is to say about it."
NAMES = [
    "<article><p>{0}</p><section id='discussion'><h2>Discussion</h2><p>{0}</p></section></article>",
    "<article><p>{0}</p><div class='ad-hoc-networks'><h2>Discussion</h2><p>{0}</p></div></article>",
    "<article><p>{0}</p><h2>Discussion</h2><p class='social'>{0}</p></article>",
    "<main class='search'><p>{0}</p><h2>Discussion</h2><p>{0}</p></main>",
    "<article><p>{0}</p><section id='related-work'><h2>Discussion</h2><p>{0}</p></section></article>",
    "<article><p>{0}</p><h2 id='search'>Discussion</h2><p>{0}</p></article>",
    "<div id='newsletter-42'><article><p>{0}</p><h2>Discussion</h2><p>{0}</p></article></div>",
    "<form><div><article><p>{0}</p><h2>Discussion</h2><p>{0}</p></article></div></form>",
]


def test_names_do_not_decide_inside_an_article(spark):
    tree = htmltext.trained(spark)
    for page in NAMES:
        assert htmltext.main_text(page.format(TEXT), lambda f: htmltext.keeps(tree, f)) == f"{TEXT} Discussion {TEXT}", page
    for page in ("<article><p>{0}</p></article><section id='comments'><article><p>{0}</p></article></section>", "<article><p>{0}</p><section id='comments'><p>{0}</p></section></article>", "<article><p>{0}</p></article><div class='related'><article><p>{0}</p></article></div>", "<nav><article>{0}</article></nav><article><p>{0}</p></article>", "<article><p>{0}</p><div class='search'>{0}</div></article>"):
        assert htmltext.main_text(page.format(TEXT), lambda f: htmltext.keeps(tree, f)) == TEXT, page


@pytest.mark.parametrize("junk", ["<a " * 350_000, "<div></i></section>" * 50_000, "<b></i>" * 150_000, "<b>" * 100_000 + "<li></li>" * 70_000, "<script>" + "</script " * 110_000, "<h1>" * 50_000 + "<li></li>" * 50_000, '<a ="' * 200_000, "<!" * 500_000, "<p><button>" + "<b>" * 100_000 + "<li></li>" * 70_000, "<!--" * 250_000, "&" * 1_000_000, "<a" + " " * 1_000_000])
def test_junk_takes_time_that_grows_with_it_alone(junk):
    import time

    began = time.thread_time()
    htmltext.blocks_of(junk)
    assert time.thread_time() - began < 4
