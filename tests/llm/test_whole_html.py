"""HTML extraction reads blocks, paths and pages whole."""

import numpy as np

from webcorpus.llm import html_extraction as html


def _same(a, b):
    return all(x.shape == y.shape and np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_every_word_and_every_tag_above_is_seen():
    start = "<p>" + "word " * 30
    one, other = (html.features(html.blocks_of(start + end)) for end in ("walking home", "sponsored offer"))
    assert not _same(one, other)
    deep = "<div><div><div><div><div><p>text"
    inside, outside = (html.features(html.blocks_of(f"<{tag}>{deep}")) for tag in ("article", "section"))
    assert not _same(inside, outside)
    more = html.features(html.blocks_of("<p>one two two"))
    assert not _same(more, html.features(html.blocks_of("<p>one two one two two")))


def test_words_late_in_a_block_decide():
    """Adverts that open like the article's prose are told from it by what they end with."""
    fill = " ".join(f"plain{k}" for k in range(30))
    page = f"<body><article><p>{fill} then they walked along quiet rivers.</p></article><div class='ad'><p>{fill} order now with huge discount today.</p></div>"
    turned = f"<body><div class='ad'><p>{fill} order now with huge discount today.</p></div><article><p>{fill} then they walked along quiet rivers.</p></article>"
    model = html.train([page, turned] * 60)
    for one, expected in ((page, [True, False]), (turned, [False, True])):
        logits, _, _ = model.read([html.features(html.blocks_of(one), True)])
        assert list(logits[0] > 0) == expected


def _texts(page):
    return [b.text for b in html.blocks_of(page)]


def test_omitted_end_tags():
    assert _texts("<html><head><title>t</title><body><p>one<p>two") == ["one", "two"]
    assert _texts("<head><meta charset=x><title>t</title><style>p{}</style><p>one") == ["one"]
    assert _texts("<head><title>t</title>bare text<p>one") == ["bare text", "one"]
    assert _texts("<html><head><link rel=x><a href=y>one</a>") == ["one"]
    for tag in ("form", "button", "select", "object"):
        assert _texts(f"<body><{tag}>label<p>one</p><p>two</p></body>") == ["one", "two"], tag
        assert _texts(f"<body><{tag}>label<p>gone</p></{tag}><p>two</p></body>") == ["two"], tag
        assert _texts(f"<body><div><{tag}>label</div><p>one</p>") == ["one"], tag
        if tag != "form":  # a block of its own, which ends the paragraph
            assert _texts(f"<body><p>one <span><{tag}>label</span> more</p>") == ["one", "more"], tag
    assert _texts("<body><select><option>a<option>b<select><option>c</select><p>one") == ["one"]
    assert _texts("<body><select><option>a<input><p>one") == ["one"]
    assert _texts("<body><button>a<button>b</button><p>one") == ["one"]
    assert _texts("<body><button>a<p>one<button>b</button><p>two") == ["one", "two"]


def _stated(page):
    return [html.stated(b) for b in html.blocks_of(page)]


def test_names_of_containers_rule_nothing_out():
    for wrapper in (
        "<article class='post tag-python'>", "<div id='content' class='no-sidebar'>", "<main class='has-comments'>", "<div class='search'><article>",
        "<body class='legal'><div class='sidebar share'><main>",
    ):
        assert _stated(f"{wrapper}<p>text</p>") == [1], wrapper
        assert _stated(f"{wrapper}<p>text</p><div class='ad big'><p>buy</p></div>") == [1, 0], wrapper
    assert _stated("<article class='comment'><p>text") == [-1]
    assert _stated("<div class='search'><div class='content'><p>text") == [-1]
    assert _stated("<article><p class='post-meta'>x</p><p class='notice'>y") == [1, 0]
    assert _stated("<div class='post-meta'>x</div><div class='tag-python'>y") == [-1, -1]
    assert _stated("<div class='comments'><div><p>text") == [0]
    assert _stated("<aside><article><p>text") == [0]


def test_without_labels_the_rules_decide():
    page = "<div><p>text</p></div><div class='menu'>Home</div>"
    assert html.train([page]) is None
    assert html._texts([page], None) == ["text"]


def test_wrapped_article_is_kept(spark):
    page = "<nav>Home</nav><div class='search'><article class='post tag-python'><p>Number {i} is here.</p></article></div><div class='ad'>Buy</div>"
    pages = spark.createDataFrame([(i, "u", page.replace("{i}", str(i))) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages).collect()} == {f"Number {i} is here." for i in range(40)}


def test_places_of_blocks():
    from webcorpus.llm.html_extraction import blocks_of, features

    blocks = blocks_of("".join(f"<p>word{i} word{i} other</p>" for i in range(51)))
    dense = features(blocks)[3]
    for i in (0, 10, 25, 49, 50):
        assert dense[i, 3] == np.float32(i / 51) and dense[i, 4] == np.float32(min(51 - i, 10) / 10)


def test_headline_of_an_article_and_blanks(spark):
    body = "<nav>Home</nav><header>Site</header><article><header><h1>Head&nbsp;line {i}</h1></header><p>&nbsp; Text&#8195;of {i}.&nbsp;</p><footer>by x</footer></article><footer>c</footer>"
    pages = spark.createDataFrame([(i, "u", body.replace("{i}", str(i))) for i in range(30)], "page_id long, url string, html string")
    for r in html.extract(pages).collect():
        assert r.text == f"Head line {r.page_id}\n\nText of {r.page_id}."


def test_a_very_long_page(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Sentence {i} of it.</p>" for i in range(20_000)) + "</article><footer>end</footer></body></html>"
    short = "<html><body><nav><a href=/>Home</a></nav><article><p>One.</p><p>Two.</p></article><footer>end</footer></body></html>"
    pages = spark.createDataFrame([(0, "u", page)] + [(i, "u", short) for i in range(1, 20)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert found[0] == "\n\n".join(f"Sentence {i} of it." for i in range(20_000)) and found[1] == "One.\n\nTwo."
