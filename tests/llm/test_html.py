"""Blocks, the tree, and whole pages."""

from notewarden.llm import html_blocks as H

FRAME = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy this now it is good</div>{}<div id="comments"><p>I liked this article very much indeed</p></div><form><label>Name</label><input></form><footer>&copy; me</footer></body></html>'


def text_of(page):
    return H.main_text(page, H.train_tree(H.LABELLED_BLOCKS))


def test_tree_fits_its_table():
    tree = H.train_tree(H.LABELLED_BLOCKS)
    assert all(H.classify(tree, row[:-1]) == bool(row[-1]) for row in H.LABELLED_BLOCKS)


def test_article():
    body = "<article><h1>A &amp; B</h1><p><b>First\n  line&nbsp;x.<br><p>Sec<i>ond</i> <a href=y>linked</a></p><p>Ok.</p><ul><li>one<li>two</ul><blockquote>q &lt;p&gt;</blockquote></article>"
    assert text_of(FRAME.replace("p{}", "p").replace("{}", body)) == "A & B\nFirst line x.\nSecond linked\nOk.\none\ntwo\nq <p>"


def test_other_layouts():
    assert text_of('<main><p>Hi.</p></main><div class="cookie-notice">We use cookies</div>') == "Hi."
    assert text_of('<header><p>Site name here</p></header><div class="sidebar"><p>Other news of the day</p></div><article>x</article>') == "x"
    long = "word " * 30
    assert text_of(f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><p>{long}</p><p>{long}</p></body>") == "\n".join([long.strip()] * 2)


def test_broken_pages():
    for page in ("", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<article><p>a", "a < b > c", '<article a="<p>">z'):
        text_of(page)
    assert text_of("<article><p>a") == "a" and text_of("<article><!-- <p>no</p> -->b<script>c</script>") == "b"


def test_open_head_and_open_unseen_elements():
    article = "<article><p>Text of it.</p></article>"
    for head in ("<head><title>T</title>", "<head><title>T", "<head><meta a=b><noscript><link>", "<head><title>T</title><noscript><img></noscript>", "<head><template><p>no</p></template>"):
        assert text_of(f"<html>{head}<body>{article}") == text_of(f"<html>{head}{article}") == "Text of it.", head
    assert text_of("<head><title>T</title></head><body>" + article) == "Text of it."
    assert H.blocks_of("<head><title>T</title>some words<p>more")[0][0] == "some words"
    for tag in ("noscript", "svg", "object", "iframe", "video", "math"):
        assert text_of(f"<body><{tag} a=b>{article}</body>") == text_of(f"<body><div><{tag}>no</div>{article}") == "Text of it.", tag
        assert text_of(f"<body><article><{tag}><p>no</p></{tag}><p>yes</p></article>") == "yes", tag


def test_names_do_not_drop_articles():
    for page in ('<div class="page has-sidebar"><article>{}</article></div>', '<article class="post comments-open">{}</article>', '<div class="with-ads no-comments"><main>{}</main></div>', '<div id="search"><article>{}</article></div>'):
        assert text_of(page.replace("{}", "<p>Text of it.</p>")) == "Text of it.", page
    assert text_of('<article><h2 id="search">Search</h2><p>a</p><section id="related-work"><h2>Related</h2><p>b</p></section></article>') == "Search\na\nRelated\nb"
    long = " ".join(["word"] * 150)
    for page in (f'<article><p>a</p><div class="notice"><p>{long}</p></div></article>', f'<div class="widget"><p>{long}</p><p>{long}</p></div>'):
        assert long in text_of(page), page
    frame = '<p>a</p><div class="share">Share this</div><div class="notice"><p><a href=b>{0}</a></p></div>'.format(long)
    assert text_of(f"<article>{frame}</article>") == "a"
    assert text_of(f'<article>a</article><ol class="comment-list"><li><article class="comment-body"><p>{long}</p></article></ol>') == "a"
    assert text_of(f'<main><p>a</p><div id="comments"><article><p>{long}</p></article></div></main>') == "a"
    assert text_of(f'<div class="site-header"><p>{long}</p></div><main>a</main><aside><article>{long}</article></aside>') == "a"


def test_operator(spark):
    rows = [(1, "u", None, "old"), (2, None, "<article><p>é  🙂</p></article>", None), (2, None, "<article><p>é  🙂</p></article>", None), (3, "u", "<article>" + "<p>long one</p>" * 20000, "")]
    out = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string"))
    assert out.columns == ["page_id", "url", "html", "text"]
    got = out.collect()
    assert [r.text for r in got][:3] == ["", "é 🙂", "é 🙂"] and got[3].text.count("\n") == 19999
    assert H.extract_text(out.limit(0)).collect() == []


def test_hostile_pages_take_time_in_proportion():
    import time

    tree = H.train_tree(H.LABELLED_BLOCKS)
    hostile = ["<script " * 60000, "<b>" * 60000 + "<div></div>" * 30000, '<a "' * 120000, '<a b="' * 80000, "<!-" * 150000, "<p>" * 150000, "<li><a>" * 70000, "<head><noscript>" * 30000, "<" * 500000, "<a b='\"" * 60000]
    for page in hostile:
        start = time.process_time()
        H.main_text(page, tree)
        assert time.process_time() - start < 5, page[:20]


def test_hidden_is_an_attribute():
    for attrs in ('title="The hidden truth"', 'class="w-4 hidden md:block"', 'data-x="aria-hidden=true"', "alt='a hidden b'", 'data-style="display:none"'):
        assert text_of(f"<article {attrs}><p>Text of it.</p></article>") == "Text of it.", attrs
    for attrs in ("hidden", 'hidden=""', 'style="color:red;display : none"', "aria-hidden=true", "HIDDEN"):
        assert text_of(f"<article><p>a</p><div {attrs}><p>no</p></div></article>") == "a", attrs


def test_form_around_the_page():
    page = '<body><form method="post"><nav><a href=a>Menu</a></nav>{}<form><label>Name</label></form></form></body>'
    assert text_of(page.replace("{}", "<article><p>Text of it.</p></article>")) == "Text of it."
    assert text_of("<article><p>a</p><form><p>Your name here please</p></form></article>") == "a"


def test_headlines_and_short_paragraphs_without_article():
    long = " ".join(["word"] * 40)
    assert text_of("<h1>Great news</h1><p>It rained today.</p>") == "Great news\nIt rained today."
    assert text_of(f"<nav><a href=a>Home</a></nav><h1>Great news</h1><p>{long}</p><p>Yes.</p><p>{long}</p>") == f"Great news\n{long}\nYes.\n{long}"


def test_final_names_whatever_their_length():
    long = " ".join(["word"] * 130)
    names = ("ad", "related", "sidebar", "cookie-notice", "comments", "c-sidebar__box", "adsbygoogle", "user-comments-v2", "sponsored-content", "newsletter-signup")
    for name in names:
        part = f'<div class="x {name}"><p>{long}</p></div>'
        assert text_of(f"<article><p>a</p>{part}</article>") == "a", name
        assert text_of(f"<p>{long} end</p>{part}<p>{long} end</p>") == f"{long} end\n{long} end", name
    assert text_of(f'<div id="content-sidebar-wrap"><p>{long}</p></div>') == long
    assert text_of('<div class="sidebar-layout sidebar"><main><p>Text of it.</p></main></div>') == "Text of it."
    assert text_of(f'<div class="comments"><article><p>{long}</p></article></div>') == ""


def test_odd_markup():
    assert text_of("<article><p>a < b > c</p><p>1<2</p></article>") == "a < b > c\n1<2"
    assert text_of('<article><a href="x>linked</a> and more</article>') == "linked and more"
    assert text_of("<article><!-->a<!-- x --><?php b ?>c</></article>") == "ac"
    assert text_of("<article><SCRIPT>if (a</b>) '</scripty>'</SCRIPT >t<textarea>no</textarea></article>") == "t"
