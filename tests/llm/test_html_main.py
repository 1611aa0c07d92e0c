import random

import pytest

from tidemark.llm import dom, html_main


@pytest.fixture(scope="module")
def model():
    return html_main.fitted()


def main_of(source, model):
    return html_main.main_blocks([dom.parse(source)], model)[0]


def test_held_out_accuracy(model):
    rng = random.Random(12345)
    right = blocks = wrong = 0
    for _ in range(150):
        source, main = dom.made_page(rng)
        want = [" ".join(x.split()) for x in main]
        got = main_of(source, model)
        right += got == want
        blocks += len(want)
        wrong += len(set(got) ^ set(want))
    assert right >= 0.9 * 150 and wrong < 0.05 * blocks


def test_a_page_with_everything(model):
    source = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
    <header class="site-header"><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul></nav></header>
    <div class="cookie-notice">We use cookies on this site. <button>Fine</button></div><div class="wrapper">
    <article><h1>The title &amp; more</h1><p>First&nbsp;paragraph of
       the text, <b>which</b> goes on &#233; for a while, with commas.</p><div class="ad">Buy now, it is cheap!</div>
    <p><b>An unclosed one.<br><p>Second paragraph, &lt;b&gt; is kept as it stands, and it is long enough too.</p><ul><li>One item</li><li>Two items</li></ul></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside>
    <section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I liked this article very much, thank you.</p></div></section>
    <form class="newsletter"><label>Mail</label><input><p>Get our letter every week.</p></form></div>
    <footer>&copy; 2024 Somebody</footer><!-- <p>hidden</p> --></body></html>"""
    assert main_of(source, model) == [
        "The title & more", "First paragraph of the text, which goes on é for a while, with commas.", "An unclosed one.",
        "Second paragraph, <b> is kept as it stands, and it is long enough too.", "One item", "Two items",
    ]


def test_decoding_never_contradicts_an_ancestor(model):
    rng = random.Random(7)
    for _ in range(40):
        page = dom.parse(dom.made_page(rng)[0])
        import numpy as np

        r = np.random.default_rng(rng.randrange(10**6))
        kept = html_main.decode(page, r.normal(0, 3, len(page.nodes)), r.normal(0, 3, len(page.nodes)))
        for i, n in enumerate(page.nodes):
            if kept[i]:  # the ancestors that are in form one unbroken chain from here upwards
                chain, k = [], i
                while k >= 0:
                    chain.append(bool(kept[k]))
                    k = page.nodes[k].parent
                assert chain == sorted(chain, reverse=True)


def test_odd_markup_does_not_break_the_parser():
    for source in ("", "<", "a < b", "<p", "<p class=", '<p class="x', "</p></div>", "<!--", "<script>", "<a b='>'>x</a>", "<p>&#0;&bogus;&amp", "<td><p>x</table>y", "\0", "<div " * 50):
        page = dom.parse(source)
        assert page.nodes[0].end == len(page.nodes)
    assert html_main.blocks(dom.parse("<p>a<p>b<br>c<div>d</div>e")) == ["a", "b c", "d", "e"]
    assert html_main.blocks(dom.parse("a < b")) == ["a < b"]
    deep = dom.parse("<div>" * 5000 + "x")
    assert html_main.blocks(deep) == ["x"]


def test_rows(spark, model):
    source = "<html><body><nav><a href='/'>Home</a></nav><article><p>Some text that is long enough to be the main text of it.</p></article></body></html>"
    long = "<html><body><article>" + "<p>Words in a paragraph, and more words.</p>" * 20_000 + "</article></body></html>"
    pages = spark.createDataFrame([(1, "u", source, 3), (1, "u", source, 3), (2, None, None, 3), (None, "v", "", 3), (4, "w", long, 3)], "page_id long, url string, html string, n_blocks int")
    got = html_main.extract(pages, model=model).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 5 and got[0].asDict().keys() == {"page_id", "url", "main_text", "n_blocks"}
    assert by[1]["main_text"] == "Some text that is long enough to be the main text of it."
    assert by[2]["main_text"] == by[None]["main_text"] == "" and by[4]["n_blocks"] == 20_000
    assert html_main.extract(pages.filter("page_id < 0"), model=model).collect() == []


def test_white_space_between_inline_elements_ends_no_block():
    assert html_main.blocks(dom.parse("<p><b>foo one</b>\n<i>bar two</i> end</p>")) == ["foo one bar two end"]
    assert html_main.blocks(dom.parse("<p>a</p>\n<p>\n</p><p>b\n\nc</p>")) == ["a", "b c"]


@pytest.mark.parametrize("source, want", [
    ("Just a text file that somebody served as a page, with no markup in it at all.", ["Just a text file that somebody served as a page, with no markup in it at all."]),
    ("A line of plain text, and then\nanother one, which goes on<br>after a break. The end.", ["A line of plain text, and then another one, which goes on after a break. The end."]),
    ("One <b>bold</b> word in text without an element around it, and nothing else here.", ["One bold word in text without an element around it, and nothing else here."]),
    ("", []), (" \n ", []),
])
def test_text_without_an_element(model, source, want):
    assert main_of(source, model) == want


def test_every_attribute_token_counts():
    names = [f"{a}{b}" for a in "abcdef" for b in "klmnopq"]
    assert dom.parse(f'<div class="{" ".join(names)}">x</div>').nodes[1].tokens == tuple(names)


@pytest.mark.parametrize("source", [
    "<div>" * 30_000 + "</b>" * 30_000, "<b>" * 30_000 + "</i>" * 30_000, "<table><td>" + "<i>" * 30_000 + "<b></td>" + "</b>" * 30_000, "<i>" * 30_000 + "<p>x" * 30_000,
    "<a href=\"x>" * 30_001, "<a " * 60_000, "<a " * 30_000 + '"x" ' * 30_000 + "'", "<a '\">" * 30_000, "<!" * 60_000, "<script </script " * 20_000, "<a " * 30_000 + "\">" * 30_000, "<!--" * 60_000,
])
def test_crafted_pages_take_time_in_proportion(source):
    import time

    began = time.process_time()
    dom.parse(source)
    assert time.process_time() - began < 4


def test_ends_of_tags():
    for source, want in (("<a b='>'>x", ["x"]), ('<a b=">x</a>y', ["x", "y"]), ("<a b='\">' c=\"'>\">x", ["x"]), ("<a b=\"1\" c='>x", ["x"]), ("<a", ["<a"]), ("a <b", ["a <b"]), ("<p>a</p", ["a</p"])):
        assert html_main.blocks(dom.parse(source.replace("x", "<hr>x<hr>"))) == want, source


#: Pages written by hand, each with the blocks of its main text; none comes from made_page().
BY_HAND = [
    ("""<html><body><div id="top"><a href="/">The Daily</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div><div id="wrap"><div class="story"><h1>Bridge closed for repairs</h1><p class="byline">By J. Doe</p>
    <p>The old bridge over the river will stay closed until the spring, the city said on Monday, after cracks were found in two of its piers.</p><p>Traffic is led over the ring road. Buses run every ten minutes.</p></div>
    <div class="related"><h3>More stories</h3><ul><li><a href="/1">School opens</a></li><li><a href="/2">Rain ahead</a></li></ul></div></div><div id="footer">Copyright The Daily. <a href="/imprint">Imprint</a></div></body></html>""",
     ["Bridge closed for repairs", "By J. Doe", "The old bridge over the river will stay closed until the spring, the city said on Monday, after cracks were found in two of its piers.", "Traffic is led over the ring road. Buses run every ten minutes."]),
    ("""<body class="blog"><header><p>My garden blog</p></header><main><article class="post hentry"><h2>Planting beans</h2><div class="entry-content"><p>Beans want warm soil, so wait for May.</p><ol><li>Dig a furrow of three inches.</li><li>Lay a bean every hand's width.</li></ol>
    <blockquote>Never sow them wet, my grandfather used to say.</blockquote></div></article><div id="comments"><h4>2 replies</h4><div class="reply"><cite>Kim</cite><p>Mine came up last week already, thanks for the hints!</p></div><div class="reply"><cite>Lou</cite><p>What about slugs?</p></div></div>
    <form id="respond"><p>Leave a reply</p><textarea></textarea><button>Send</button></form></main><aside><h3>About me</h3><p>I dig and write.</p></aside><footer>Powered by soil</footer></body>""",
     ["Planting beans", "Beans want warm soil, so wait for May.", "Dig a furrow of three inches.", "Lay a bean every hand's width.", "Never sow them wet, my grandfather used to say."]),
    ("""<html><body><div class="cookie-banner"><p>We value your privacy and use cookies to improve this site.</p><button>Accept all</button></div><nav class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li><li><a href="#f">Faults</a></li></ul></nav>
    <section class="content"><h1>The frob tool</h1><p>Frob reads a table and writes it back in order. It needs no set-up.</p><h2>Use</h2><pre>frob --sort name table.csv</pre><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>--sort</td><td>column to sort by</td></tr></table><p>All options can be given twice; the last one counts.</p></section>
    <footer><a href="/a">About</a> <a href="/c">Contact</a></footer></body></html>""",
     ["The frob tool", "Frob reads a table and writes it back in order. It needs no set-up.", "Use", "frob --sort name table.csv", "Option", "Meaning", "--sort", "column to sort by", "All options can be given twice; the last one counts."]),
    ("""<html><head><title>x</title></head><body><table class="layout"><tr><td class="menu"><a href="/1">Home</a><br><a href="/2">Photos</a><br><a href="/3">Guestbook</a></td><td class="text"><h1>Our trip to the lake</h1><p>We left early in the morning, when the road was still empty, and reached the lake before noon.</p>
    <p>The water was cold, but the children did not mind. In the evening we made a fire, and somebody had brought a guitar.</p></td></tr></table></body></html>""",
     ["Our trip to the lake", "We left early in the morning, when the road was still empty, and reached the lake before noon.", "The water was cold, but the children did not mind. In the evening we made a fire, and somebody had brought a guitar."]),
    ("""<body><div class="masthead"><h1>Recipes</h1></div><div class="ad-slot">Sponsored: knives that never dull!</div><div class="post-body"><h2>Bread</h2><p>Mix flour, water, salt and yeast, and leave the dough for a night.</p><div class="promo">Try our newsletter, it is free!</div><p>Bake it in a hot oven until the crust is dark, which takes about forty minutes.</p></div>
    <div class="share-buttons"><a href="#">Tweet</a> <a href="#">Mail</a></div><div class="footer">All recipes tested twice</div></body>""",
     ["Bread", "Mix flour, water, salt and yeast, and leave the dough for a night.", "Bake it in a hot oven until the crust is dark, which takes about forty minutes."]),
    ("""<html><body><h1>Minutes of the meeting</h1><p>Present were nine members; the chair opened at eight.</p><p>The budget was read and accepted without a vote against it.</p><p>Next meeting: first Tuesday of the month.</p></body></html>""",
     ["Minutes of the meeting", "Present were nine members; the chair opened at eight.", "The budget was read and accepted without a vote against it.", "Next meeting: first Tuesday of the month."]),
]


def test_accuracy_on_pages_written_by_hand(model):
    from collections import Counter

    scores = []
    for source, want in BY_HAND:
        got, right = Counter(" ".join(main_of(source, model)).split()), Counter(" ".join(want).split())
        both = sum((got & right).values())
        scores.append(2 * both / (sum(got.values()) + sum(right.values())))
    print("F1 of words:", [round(s, 3) for s in scores])
    assert sum(scores) / len(scores) >= 0.9
