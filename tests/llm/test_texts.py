"""Extraction, token counts and the encoder against other ways to the same results."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from spanguard.llm import bpe, token_counts
from spanguard.llm.html import extract, main_text

PATH = public_tokenizers.path(bpe.MULTI)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as rows:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rows)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.PrefixBPE.load(PATH)


def some_texts():
    rnd = random.Random(5)
    pools = ["abcdefghij ", "the of and in zu der qu é ", "0123456789 .,", "äöüß éèç ñ", " \n\t\r", "日本語中文한국어", "🙂🙃👍🏽é", "<|endoftext|>", "=-_*#"]
    out = ["", " ", "a", "'s't're", "<|endoftext|>", "=" * 3000, " " * 500 + "x", "ab" * 2000, "  x", "a\x00b"]
    for _ in range(300):
        out.append("".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(1, 120))))
    return out


def test_encoding_agrees_with_the_library(library, own):
    for text in some_texts():
        assert own.encode(text) == library.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()


def test_appending_and_editing_give_what_a_new_start_gives(own):
    rnd = random.Random(9)
    for text in some_texts()[-120:]:
        data = text.encode()
        cut = rnd.randrange(len(data) + 1)
        last = own.prefixes(data, own.prefixes(data[:cut]))
        assert last == own.prefixes(data)
        a = rnd.randrange(len(data) + 1)
        b = rnd.randrange(a, len(data) + 1)
        new = bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(4)))
        edited, tokens = own.edited(data, last, a, b, new)
        assert edited == data[:a] + new + data[b:]
        assert tokens == own.prefixes(edited)
        assert own.decode(own.walk(tokens)) == edited


def test_editing_works_near_the_edit_only(own, monkeypatch):
    data = b"the words of a long text and more of it " * 300
    last, steps = own.prefixes(data), []
    step = bpe.PrefixBPE.prefixes
    monkeypatch.setattr(bpe.PrefixBPE, "prefixes", lambda self, *a: (steps.append(1), step(self, *a)))
    own.edited(data, last, 6000, 6001, b"xy")
    assert len(steps) < 600


DOCS = "doc_id bigint, text string, ids string, n_tokens int"


def test_encoded_documents(spark, library):
    texts = [None, "", "a b  c", "same", "same", "é🙂", "x" * 50000, "w " * 40000]
    df = spark.createDataFrame([(i if i else None, t, "clash", 1) for i, t in enumerate(texts)], DOCS)
    done = bpe.digests(bpe.decode_ids(bpe.encode_texts(df, PATH), PATH))
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in done.collect())
    want = []
    for t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(bpe.decode_ids(bpe.encode_texts(df.limit(0), PATH), PATH)).collect() == []


def test_length_table_and_limits(spark):
    path = public_tokenizers.path(token_counts.RANKS)
    bare = bpe.PrefixBPE.load(path)
    texts = [None, "", "a", "a", "b c d", "z " * 700, "word " * 2500, "a b c"]
    sizes = sorted(len(bare.encode(t or "")) for t in texts)
    lengths = token_counts.encoded_lengths(spark.createDataFrame([(t,) for t in texts], "text string"), path)
    rows = {r["n_tokens"]: r for r in token_counts.length_table(lengths).collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert r["n_docs"] == sizes.count(n)
        assert r["docs_from"] == sum(s >= n for s in sizes) and r["tokens_from"] == sum(s for s in sizes if s >= n)
        assert r["docs_to"] == sum(s <= n for s in sizes) and r["truncated"] == sum(min(s, n) for s in sizes)
    limits = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 1000, 1023, 1024, 2047, 5000, 10**6)], "limit bigint")
    for r in token_counts.at_limits(lengths, limits).collect():
        n = r["limit"]
        assert (r["n_docs"], r["longer"], r["kept_tokens"], r["cut_tokens"]) == (
            len(sizes), sum(s > n for s in sizes), sum(min(s, n) for s in sizes), sum(max(0, s - n) for s in sizes)), n
    table = token_counts.length_table(lengths)
    for share in (0.01, 0.25, 0.5, 0.9, 1.0):
        assert token_counts.quantile(table, share) == next(s for i, s in enumerate(sizes, 1) if i >= share * len(sizes))
    nothing = lengths.limit(0)
    assert token_counts.length_table(nothing).collect() == [] and token_counts.quantile(token_counts.length_table(nothing), 0.5) is None
    assert token_counts.at_limits(nothing, limits).first()["n_docs"] == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li></ul></nav><!-- c --><div class="ad">Buy this now.</div><header>Site</header>
<article><header><h1>Head &amp; line</h1></header><p><b>First  part<br>goes
on.<p>Second &lt;b&gt; &eacute;.</p><div class="newsletter-signup">Join us</div><aside>Also read</aside><p>Last.</p>
<section id="comments"><p>Nice one, thanks a lot.</p></section></article>
<div role="complementary">Side bar text</div><form><p>Name</p></form><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\n\nFirst part goes on.\n\nSecond <b> é.\n\nLast."


def test_main_text_without_a_mark_takes_the_stretch_with_most_text():
    page = ("<div class=menu><a href=x>A</a></div><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>More</a></div>"
            "<h2>Title</h2><p>" + "Some words here. " * 20 + "</p><p>Short.</p><p>" + "Others there. " * 10 + "</p>"
            "<div><a href=4>x</a></div><div><a href=5>y</a></div><div><a href=6>z</a></div><p>Imprint</p>")
    lines = main_text(page).split("\n\n")
    assert "Title" in lines and "Short." in lines and "Imprint" not in lines and "News" not in lines


BODY = "Some words here that go on for a while. " * 10


@pytest.mark.parametrize("page, text", [
    ("<article><h2 id='side-effects'>Side effects</h2><p id=search>Found.</p><section id='search-methods'><p>Methods.</p></section></article>", "Side effects\n\nFound.\n\nMethods."),
    (f"<div class='content has-sidebar'><h1>Head</h1><p>{BODY}</p></div>", "Head\n\n" + BODY.strip()),
    (f"<div class='sidebar-right'><p>{BODY}</p><div class='sidebar'><p>About us.</p></div></div>", BODY.strip()),
    (f"<p>{BODY}</p><section class=search><p>{BODY}</p></section><div class=search>Find it</div>", BODY.strip() + "\n\n" + BODY.strip()),
    (f"<p>{BODY}</p><div class=related><p><a href=x>{BODY}</a></p></div>", BODY.strip()),
    (f"<p>{BODY}</p><section class='comments-area'><p>{BODY * 3}</p></section>", BODY.strip()),
    (f"<p>{BODY}</p><div class=ad>Buy this now.<p>{BODY}</p>", BODY.strip() + "\n\n" + BODY.strip()),
    (f"<article><p>{BODY}</p><section class=ad>Buy this now.<p>One.</p></article><p>After.</p>", BODY.strip() + "\n\nOne."),
    (f"<p>{BODY}</p><div class=ad><div>Buy</div><div>this</div></div><p>Now.</p>", BODY.strip() + "\n\nNow."),
    (f"<p>{BODY}</p><ul class=tags><li>a<ul><li>b</ul></li>c</ul><p>Text <span class=ad>Buy <span>it</span> now</span></p>", BODY.strip() + "\n\nText"),
    (f"<article><article>In.</article><div class=ad>Buy</article><p>{BODY}</p>", "In."),
    (f"<div class='ad'><p>Buy.</p><div class=widget><p>{BODY}</p></div>", BODY.strip()),
    (f"<head><title>t</title><meta name=x><body><p>{BODY}</p>", BODY.strip()), (f"<div class=menu>M<div>x</div></div><p>{BODY}<p class=share>Share<p>Go on.", BODY.strip() + "\n\nGo on.")])
def test_names_of_parts_are_taken_as_a_whole(page, text):
    assert main_text(page) == text


def test_an_article_without_a_mark_may_be_interrupted():
    parts = ["Some words here. " * n + "The end." for n in (9, 20, 4)]
    adverts, links = "<div class=ad>Buy</div>" * 3, "".join(f"<div><a href={i}>Link {i}</a></div>" for i in range(4))
    page = f"<p>{parts[0]}</p>{adverts}<p>{parts[1]}</p>{links}<p>{parts[2]}</p>{links}<p>Imprint</p>"
    assert main_text(page) == "\n\n".join(parts)
    page = f"<p>{parts[0]}</p>{links}<div>More: {'<a href=x>another page of this site</a>' * 9} and so on, and so on, and so on, and on.</div>"
    assert main_text(page) == parts[0]
    assert main_text(f"<p>One short.</p>{adverts}<p>Two short.</p>") == "One short.\n\nTwo short."


def test_the_line_windows_decide_inside_a_mark():
    links = "".join(f"<div><a href={i}>Link {i}</a></div>" for i in range(5))
    page = f"<p>Outside.</p><article><h2><a href=x>Linked head</a></h2><p>First part.</p>{links}<p>Last.</p></article><p>After.</p>"
    assert main_text(page) == "Linked head\n\nFirst part.\n\nLast."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<nav>x<article><p>y</p></article>", "y"),
    ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"), ("<script>x", ""), ("<p title='a>b'>c</p>", "c"), ("<p title=it's>c</p>", "c"),
    ("<div hidden>a</div><p>b</p>", "b"), ("<p>a&nbsp;b</p>", "a b"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a b")])
def test_main_text_of_odd_pages(page, text):
    assert main_text(page) == text


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None), (2, "v", "<p>" + "w " * 100000 + "</p>", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(len(r["text"]) for r in got.collect()) == [0, len(main_text(PAGE)), len(main_text(PAGE)), 199999]
    assert extract(df.limit(0)).collect() == []
    assert got.where(F.col("page_id").isNull()).first()["text"] == ""


TEXT = "The whole body of the page is here, in a few words. " * 6


@pytest.mark.parametrize("page,text", [
    ("<main><article><p>The text.</p></article><article class=comment><p>A reader says so.</p></article></main>", "The text."),
    ("<main><article><p>The text.</p></article><div class=comments><article><p>A reader.</p></article></div><p>The end.</p></main>", "The text.\n\nThe end."),
    ("<article><p>One.</p><article class='comment-body'><p>A reader.</p></article><p>Two.</p></article><p>Imprint.</p>", "One.\n\nTwo."),
    (f"<body><form action=x><nav><a href=a>A</a></nav><p>{TEXT}</p><input></form></body>", TEXT.strip()),
    ("<article><p>The text.</p><form><label>Your name</label></form></article>", "The text."),
    ("<article><p>The text.</p><ul>" + "<li><a href=x>Linked.</a></li>" * 5 + "</ul></article>", "The text." + "\n\nLinked." * 5),
    ("<main><ul>" + "<li><a href=x>Menu</a></li>" * 5 + "</ul><p>The text.</p></main>", "The text."),
    ("<article><p title='a > b' data-x=\"<p>x</p>\">The text.</p></article>", "The text."),
    ("<article><p title='open>The text.</p></article>", "The text."),
])
def test_main_text_of_comments_forms_and_links(page, text):
    assert main_text(page) == text


@given(st.lists(st.sampled_from(["The first of it.", "And so on, for a while.", "é &amp; ü", "A last word <b>here</b>."]), min_size=1, max_size=6),
       st.lists(st.sampled_from(["<nav><a href=a>Home</a></nav>", "<aside>Adverts</aside>", "<footer>Imprint</footer>", "<script>x</script>",
                                 "<div class=cookie-banner>Cookies</div>", "<form><input><label>Name</label></form>"]), min_size=2, max_size=6))
def test_main_text_of_pages_built_from_known_blocks(blocks, around):
    half = len(around) // 2
    page = "".join(around[:half]) + "<article>" + "".join(f"<p>{x}</p>" for x in blocks) + "</article>" + "".join(around[half:])
    assert main_text(page) == "\n\n".join(x.replace("&amp;", "&").replace("<b>", "").replace("</b>", "") for x in blocks)


@pytest.mark.parametrize("piece", ["<a b ", "<a '\">", "<script/>", "<!x ", '<a "x', "<a x='"])
def test_tags_without_an_end_take_linear_time(piece):
    began = time.monotonic()
    main_text(piece * 100_000)
    assert time.monotonic() - began < 20  # a quadratic search takes hours
