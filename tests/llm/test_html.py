"""Main text of marked, unmarked and broken pages."""

import random

import numpy as np

from tracelake.llm import html as html_
from tracelake.llm.html import all_blocks, blocks, extract_text, main_blocks, suffix_groups


def text(page):
    return "\n\n".join(blocks(page)[0])


def test_marked_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><a>menu</a></nav><!-- <article>no</article> --><div class="ad">buy</div>
    <article class=post><header><h1>A &amp; B&nbsp;&#67;</h1></header><p>One  <b>two</b>
    three<br>four<p class='x'>Five<script>if (a<b) {"</script>six <img alt="no > tag"> seven</p><div id="comments"><article><p>me too</p></article></div><aside>side</aside><ul><li>l1<li>l2</ul><form>f<p>g</p></form></article><p>outside</p><footer>&copy;</footer></body></html>"""
    assert text(page) == "A & B C\n\nOne two three four\n\nFivesix seven\n\nl1\n\nl2"


def test_broken_pages():
    assert text("") == text("   ") == text("<p>") == text("<!-- open") == ""
    assert text("a < b &lt;c&gt; &bogus; &amp") == "a < b <c> &bogus; &"
    assert text("<p>one<p class=ad>two<p>three") == "one\n\nthree"
    assert text("<article><p>cut of") == "cut of" and text("<article>x<script>never closed <p>y") == "x"
    assert text("<p>end</p><a href=\"un") == "end" and text("<DIV>Up</DIV><P HIDDEN=''>no</P>") == "Up"
    assert text("<p title='a>b'>q</p>") == "q" and text("<nav><nav>x</nav>y</nav><p>z</p>") == "z"


def test_host_suffix_array(spark):
    menu, own = "Home About Contact Privacy Terms Help Search Login More", "this page alone holds words number {0} {0}a {0}b {0}c"
    rows = [(i, "http://h.example/" + str(i), f"<body><div>{menu}</div><p>{own.format(i)}</p><div>Subscribe now</div></body>") for i in range(5)]
    rows += [(9, "http://other.example/", f"<body><div>{menu}</div></body>"), (10, None, None), (11, "x", ""), (12, "http://h.example/m", f"<div>{menu}</div><main><p>{menu}</p></main>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert all(got[i].text == own.format(i) and got[i].n_chars == len(got[i].text) for i in range(5))
    assert got[9].text == menu and got[10].text == got[11].text == "" and got[12].text == menu
    assert extract_text(df).count() == len(rows) and extract_text(df.limit(0)).count() == 0


def test_boilerplate_in_articles(spark):
    note = "Members read this and every other story of ours without any delay"
    own = "story {0} has its own words {0}a {0}b {0}c and ends here"
    rows = [(i, "http://h.example/" + str(i), f"<article><p>{own.format(i)}</p><div class=x>{note}</div><p>{i} says: {note} {i}</p></article>") for i in range(4)]
    want = {i: f"{own.format(i)}\n\n{i} says: {note} {i}" for i in range(4)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for held in (1 << 19, 0):  # broadcast and joined
        assert {r.page_id: r.text for r in extract_text(df, held=held).collect()} == want


def test_names_and_frames_keep_articles():
    assert text('<div class="post no-sidebar"><article><p>kept</p></article></div><div class="sidebar-box">gone</div>') == "kept"
    assert text('<article><p>one</p><p class="share-price">two</p><p class="share-buttons">x</p><div id="post-comments-3">y</div></article>') == "one\n\ntwo"
    assert text('<form action="/"><input><main><p>all in a form</p></main></form>') == "all in a form"
    assert text("<form><p>a page without an article</p></form>") == "a page without an article"
    assert text('<div class="related"><article>teaser</article></div><article>story</article><section class="comments"><article>me too</article></section>') == "story"
    assert text('<div class="widget" role="complementary"><div class="widget">in</div></div><p>rest</p>') == "rest"


def test_suffix_groups_equal_brute_force():
    r = random.Random(2)
    for window in (1, 2, 3, 5, 8):
        blocks_ = [[r.choice("ab") for _ in range(r.randint(1, 14))] for _ in range(40)]
        tokens = np.array([ord(x) for b in blocks_ for x in b], np.uint64)
        block = np.repeat(np.arange(len(blocks_)), [len(b) for b in blocks_])
        start, group = suffix_groups(tokens, block, window)
        want = {}
        at = 0
        for b in blocks_:
            for i in range(max(1, len(b) - window + 1)):
                want[at + i] = tuple(b[i : i + window])
            at += len(b)
        assert start.tolist() == sorted(want)
        names = [want[s] for s in start.tolist()]
        assert len(set(zip(names, group.tolist()))) == len(set(names)) == len(set(group.tolist()))
        assert [n for _, n in sorted(zip(group.tolist(), names))] == sorted(names)


def test_boilerplate_counts_equal_brute_force(spark, monkeypatch):
    """Chunks of any size, copies across chunks, broadcast or joined: the windows on half of a host's distinct pages."""
    r = random.Random(7)
    lines = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.randint(2, 12))) for _ in range(12)]
    rows = []
    for i in range(90):
        body = [r.choice(lines[: r.choice([2, 12])]) for _ in range(r.randint(0, 4))] + [f"own {i} {i}x {i}y {i}z" if i % 4 else "one more copy"]
        r.shuffle(body)
        rows.append((i, f"http://h{i % 3}.example/{i}", "".join(f"<p>{x}</p>" for x in body) + f"<nav>{lines[len(body)]}</nav>"))
    hosts = {}
    for _, url, page in rows:
        found = all_blocks(page)
        main = tuple(main_blocks(found)[0])
        hosts.setdefault(url[7:9], {})[main] = {w for t, _ in found for w in windows(t)}
    boiler = {h: {w for s in pages.values() for w in s if sum(w in x for x in pages.values()) >= max(2, -(-len(pages) // 2))} for h, pages in hosts.items()}
    want = {}
    for i, url, page in rows:
        main, kept = main_blocks(all_blocks(page))[0], []
        for t in main:
            x = t.split(" ")
            gone = set()
            for k in range(max(1, len(x) - 7)):
                if tuple(x[k : k + 8]) in boiler[url[7:9]]:
                    gone.update(range(k, min(k + 8, len(x))))
            if rest := " ".join(y for k, y in enumerate(x) if k not in gone):
                kept.append(rest)
        want[i] = "\n\n".join(kept or main)
    assert any(boiler.values()) and any(want[i] != "\n\n".join(main_blocks(all_blocks(p))[0]) for i, _, p in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for chunk, held in ((1 << 21, 1 << 20), (50, 1 << 20), (50, 0)):
        monkeypatch.setattr(html_, "CHUNK", chunk)
        assert {x.page_id: x.text for x in extract_text(df, held=held).collect()} == want


def windows(text_):
    x = text_.split(" ")
    return {tuple(x[k : k + 8]) for k in range(max(1, len(x) - 7))}


def test_long_page(spark):
    page = "<article>" + "".join(f"<p>word{i} and more &amp; more</p>" for i in range(40000)) + "</article>"
    r = extract_text(spark.createDataFrame([(1, "http://a/", page)], "page_id long, url string, html string")).first()
    assert r.n_chars == len(r.text) == sum(len(f"word{i} and more & more") for i in range(40000)) + 2 * 39999


def test_share_of_distinct_pages(spark):
    copy = "<p>one article that stands under three ids of the very same host</p>"
    phrase = "and that is what they said at the time"
    rows = [(i, f"http://copies.example/{i}", copy + f"<!-- {i} -->") for i in range(3)]
    rows += [(10 + i, f"http://hot.example/{i}", f"<p>{i}x {i}y {phrase if i < 3 else i} {i}z</p>") for i in range(9)]
    rows += [(20 + i, f"http://two.example/{i}", f"<div>Home About Contact</div><p>page {i}</p>") for i in range(2)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == copy[3:-4] for i in range(3))
    assert all(got[10 + i] == f"{i}x {i}y {phrase if i < 3 else i} {i}z" for i in range(9))
    assert all(got[20 + i] == f"page {i}" for i in range(2))
