from collections import Counter

from pyspark.sql import functions as F

from staveframe.llm import html_text as ht

PAGE = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
<div id="main-content"><h2>Head &amp; line</h2><p>One <b>bo</b>ld&nbsp;text<br>more<p>Two<ul><li>a<li>b</ul><form><input>search</form><div class="commentList">bad</div></div>
<div><a href=x>Link one</a> <a href=y>Two</a></div><!-- <p>no</p> --><footer>f</footer></body>"""


def test_page():
    assert ht.Page(PAGE).main_text(set()) == "Head & line\nOne bold text more\nTwo\na\nb"
    assert ht.Page("text < 3 &lt; <b unclosed").main_text(set()) == "text < 3 < <b unclosed"
    assert ht.Page("").main_text(set()) == "" and ht.Page("<article><p>x</p><aside>no</aside></article><p>out</p>").main_text(set()) == "x"
    assert ht.Page("<p>" * 2000 + "deep" + "<div>" * 3000 + "x").main_text(set()) == "deep\nx"


def test_template(spark):
    shell = "<body><div>Welcome to our site</div><div class=x>{}</div><div>All rights are kept by us</div></body>"
    rows = [(k, "http://a.com/", shell.format(f"<p>Own text number {k}</p>")) for k in range(30)] + [(100, "http://b.com/", shell.format("<p>alone</p>")), (101, None, None), (102, "http://a.com/", ""), (103, "", "<p>y</p>")]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: (r.text, r.n_chars) for r in ht.extract(pages).collect()}
    assert all(got[k] == (f"Own text number {k}", len(f"Own text number {k}")) for k in range(30))
    assert got[100][0] == "Welcome to our site\nalone\nAll rights are kept by us"  # a single page has no template
    assert got[101] == ("", 0) and got[102] == ("", 0) and got[103] == ("y", 1)
    assert ht.extract(pages).count() == len(rows) + 1 and ht.extract(pages.limit(0)).count() == 0


def test_classes_are_nested(spark):
    shell = "<body><main>{}</main><div class=box><p>Constant one</p><p>Constant two</p></div></body>"
    pages = spark.createDataFrame([(k, "http://a.com/", shell.format("<p>x</p>" * (1 + k % 3) + f"<p>{k}</p>")) for k in range(20)], "page_id long, url string, html string")
    found = ht.templates(ht._pages(pages, "page_id", "url", "html")).collect()
    once = [r for r in found if len(r.tokens) >= 2]
    assert len(once) == 1 and once[0].pages == 20  # both constants are in one class
    inner = [r for r in found if r.within is not None]
    assert inner and all(r.within in {x.class_id for x in found} for r in inner)


def test_copied_articles_stay(spark):
    rows = [(k, "http://a.com/", f"<nav><a>n{k}</a></nav><article><p>The same article on many pages</p></article>") for k in range(12)] + [(50 + k, "http://a.com/", f"<nav><a>m{k}</a></nav><article><p>Own {k}</p></article>") for k in range(12)]
    got = {r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id < 50").collect()}
    assert got == {"The same article on many pages"}


def test_hosts_of_copies_keep_their_text(spark):
    frame = "<html><body><div class=top>Hello to all readers</div>{}<div class=low>Kept by us since long ago</div></body></html>"
    text = "".join(f"<p>Paragraph {k} of the one text that every page of this host has</p>" for k in range(4))
    own = "<p>Page {} alone has this text, which is about as long as any of the paragraphs</p>"
    rows = [(k, "http://all.com/", frame.format(f"<article>{text}</article><div>{k}</div>")) for k in range(20)]
    rows += [(100 + k, "http://plain.com/", frame.format(f"<div class=post>{text}</div>")) for k in range(20)]
    rows += [(200 + k, "http://most.com/", frame.format(f"<div class=post>{text if k < 18 else own.format(k)}</div>")) for k in range(20)]
    rows += [(300 + k, "http://marked.com/", frame.format(f"<article>{text if k < 19 else own.format(k)}</article>")) for k in range(20)]
    rows += [(400 + k, "http://line.com/", frame.format(f"<article>{own.format(k)}<p>Write to the editors</p></article>")) for k in range(20)]
    got = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    lines = [f"Paragraph {k} of the one text that every page of this host has" for k in range(4)]
    other = lambda k: f"Page {k} alone has this text, which is about as long as any of the paragraphs"
    assert all(got[k].split("\n") == lines for k in range(20))
    assert all(got[100 + k].split("\n") == ["Hello to all readers", *lines, "Kept by us since long ago"] for k in range(20))
    assert all(got[200 + k].split("\n") == (lines if k < 18 else [other(k)]) for k in range(20))
    assert all(got[300 + k].split("\n") == (lines if k < 19 else [other(k)]) for k in range(20))
    assert all(got[400 + k] == other(k) for k in range(20))


def test_names_of_wrappers_do_not_bar_articles():
    for wrapper in ('class="layout has-sidebar"', 'class="with-comments"', 'id="page" class="menu-open"', 'class="side left"', 'class="has-header"'):
        for kind in ("article", "main"):
            page = f"<body><div {wrapper}><{kind}><p>The article</p><div class=comments>bad</div></{kind}><div class=sidebar><article>Teaser</article></div><p>not</p></div><p>out</p></body>"
            assert ht.Page(page).main_text(set()) == "The article", (wrapper, kind)
    assert ht.Page("<article>Own</article><div class=related><article>Other article, and longer</article></div>").main_text(set()) == "Own"
    assert ht.Page("<nav class=x><article>no</article></nav><div class=comments><article class=comment>no</article></div><p>Text</p>").main_text(set()) == "Text"
    assert ht.Page("<p>Text without any article element</p><div class=page-with-sidebar><article>Short</article></div>").main_text(set()) == "Text without any article element\nShort"
    assert ht.Page("<div role=main class=has-sidebar><p>Text</p></div>").main_text(set()) == "Text"


def test_names_alone_decide_little():
    """Class words that only contain a listed word, or stand for the whole page, leave the text; formulas are text."""
    for page in ('<div class="content no-sidebar"><p>Text</p></div>', '<div class="post ad-free"><p>Text</p></div>', '<section class="discussion"><p>Text</p></section>', '<div id="side-effects"><p>Text</p></div>',
                 '<article><p class="share-price">Text</p></article>', "<form><div><p>Text</p></div></form>", "<article><math>Text</math></article>"):
        assert ht.Page(page).main_text() == "Text", page
    assert ht.Page("<article><p>Text <button>Press</button><span hidden>not</span> goes on</p><form>Mail</form></article>").main_text() == "Text goes on"


def test_pages_of_a_host_tell_its_article(spark):
    """Comments longer than a short article go, as the other pages say which element the article is; without them both stay."""
    text = "<article><p>{}</p></article><div class=zz>{}</div>"
    rows = [(k, "http://a.com/", text.format(f"Words of the article number {k} " * 20, f"answer {k}")) for k in range(20)]
    rows += [(20, "http://a.com/", text.format("Short", "long answer of a reader " * 90)), (21, "http://b.com/", text.format("Short", "long answer of a reader " * 90))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "gone", "articles", "others", "token", "page", "vector", "text")})
    got = {r.page_id: r.text for r in ht.extract(pages).collect()}
    assert got[20] == "Short" and got[21].startswith("Short\nlong answer") and "answer" not in got[3]
    none = ht.templates(ht._pages(pages, "page_id", "url", "html")).limit(0)
    alone = {r.page_id: r.text for r in ht.extract(pages, none).collect()}
    assert alone[20].startswith("Short\nlong answer") and alone[21] == got[21]  # what only other pages could tell


def test_other_class_words_give_the_same_text(spark):
    """With the class words of all elements exchanged, the texts of the tables' pages are the same."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    first, second = ({r.page_id: r.text for r in ht.extract(p).collect()} for p in (pages, pages.withColumn("html", F.regexp_replace("html", 'class="ad"', 'class="zebra"'))))
    assert first == second and sum(map(len, first.values())) > 100_000


def test_very_long_pages(spark):
    long = "<div>" * 20_000 + "<p>word</p>" * 50_000
    got = ht.extract(spark.createDataFrame([(1, "http://a.com", long), (1, "http://a.com", long)], "page_id long, url string, html string")).collect()
    assert [r.text.count("\n") for r in got] == [49_999] * 2


def test_template_alone_finds_the_text(spark):
    """Without any element names and class words the template gives the same texts; the pages alone don't."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer|aside|header|main|section)\\b", "<$1div"), ' class="[^"]*"', ""))
    template = ht.templates(ht._pages(bare, "page_id", "url", "html"))
    first, second, alone = ({r.page_id: r.text for r in x.collect()} for x in (ht.extract(pages), ht.extract(bare, template), ht.extract(bare, template.limit(0))))
    assert len(first) == pages.count() and first == second
    assert all(first[k] != alone[k] for k in first if first[k])


def test_varying_comments_go_without_hints(spark):
    shell = "<body><div>Welcome</div><div><div>{}</div><div>{}</div></div><div>Kept by us</div></body>"
    text = lambda k: "".join(f"<p>Paragraph {j} of page {k}, as long as others are</p>" for j in range(2 + k % 5))
    rows = [(k, "http://a.com/", shell.format(text(k), f"reader {k} says fine words")) for k in range(40)]
    # Boxes whose number differs are parts of the text, also where the first is most of it.
    rows += [(100 + k, "http://b.com/", f"<body><div>Welcome</div><div>{'<div>Long part of page %d, and so on</div>' % k * 3}" + "".join(f"<div>part {j} of {k}</div>" for j in range(k % 4)) + "</div><div>Kept</div></body>") for k in range(40)]
    got = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(40):
        assert got[k].split("\n") == [f"Paragraph {j} of page {k}, as long as others are" for j in range(2 + k % 5)]
        assert got[100 + k].split("\n") == [f"Long part of page {k}, and so on"] * 3 + [f"part {j} of {k}" for j in range(k % 4)]


def test_classes_against_occurrence_vectors(spark):
    """The classes are those that come of comparing whole occurrence vectors."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = ht._pages(pages, "page_id", "url", "html")
    vectors: dict = {}
    hosts: dict = {}
    for r in rows.collect():
        for (token, _, _), times in Counter(ht.Page(r.html or "").tokens).items():
            vectors.setdefault((r.host, token), {})[r.page_id] = times
        hosts[r.host] = hosts.get(r.host, 0) + 1
    groups: dict = {}
    for (host, token), vector in vectors.items():
        if len(vector) - 1 >= (hosts[host] + 1) * ht.SHARE:
            groups.setdefault((host, tuple(sorted(vector.items()))), set()).add(token)
    found = ht.templates(rows).where("class_id is not null").collect()
    want = sorted((host, len(vector)) for host, vector in groups)
    assert want and sorted((r.host, r.pages) for r in found) == want
    assert all(set(r.tokens) <= next(g for (h, _), g in groups.items() if h == r.host and set(r.tokens) <= g) for r in found if r.tokens)
