"""Extraction on markup that misleads simple patterns."""

from career_index.operators import extract as X

LD = '<script type="application/ld+json">'


def page(spark, html):
    return spark.createDataFrame([(1, "https://h.com/", html)], "page_id long, url string, html string")


def test_links_skip_comments_and_scripts_and_keep_quoted_brackets(spark):
    html = ("<!-- <a href='/hidden'>x</a> --><script>a = '<a href=\"/script\">x</a>'</script>"
            '<a title="a > b" href="/x?href=q">Caf&eacute; &#8211; &#x41; &amp;lt; &bogus; &</a><a title="z href=/no">n</a>')
    rows = X.links(page(spark, html)).collect()
    assert [(r.href, r.text, r.title) for r in rows] == [("/x?href=q", "Caf\u00e9 \u2013 A &lt; &bogus; &", "a > b")]


def test_json_ld_repeated_keys_quoted_objects_and_depth(spark):
    nest = '{"n":[' * 6 + '{"@type":["T","JobPosting"],"title":"deep","url":"https://a.com/2"}' + "]}" * 6
    html = (LD + '{"@type":"JobPosting","title":"A","title":"B","url":"https://a.com/1",'
            '"d":"{\\"@type\\":\\"JobPosting\\",\\"title\\":\\"q\\",\\"url\\":\\"https://q.com\\"}"}</script>'
            + LD + nest + "</script>" + LD + "{bad</script>")
    rows = X.job_postings(X.json_ld(page(spark, html))).collect()
    assert sorted((r.title, r.url) for r in rows) == [("B", "https://a.com/1"), ("deep", "https://a.com/2")]


def test_country_must_be_text(spark):
    html = LD + '[{"address":{"addressCountry":7}},{"address":{"addressCountry":" FR "}}]</script>'
    assert [r.country for r in X.json_ld_country(X.json_ld(page(spark, html))).collect()] == ["FR"]


def test_class_is_a_whole_word(spark):
    html = '<table class="infobox-caption"><tr><th>Website</th><td><a href="http://bad.com">b</a></td></tr></table>'
    assert X.infobox_website(page(spark, html)).collect() == []


def test_field_ends_at_the_next_field(spark):
    html = ('<h1>Acme</h1><div class="wpbdp-field-website"><div class="wpbdp-field-value">https://acme.com/x</div></div>'
            '<div class="wpbdp-field-category"><span class="value">France</span></div>')
    r = X.listing_records(page(spark, html)).collect()
    assert [(x.name, x.website, x.country_of_origin) for x in r] == [("Acme", "https://acme.com", "France")]


def test_hidden_markup_is_not_read(spark):
    html = ("<!-- <h1>old</h1><title>oldt</title> --><script>var a = '<title>s</title><h1>s</h1>'</script><title>newt</title><h1>new</h1>"
            '<!-- <h2 class="listing-title"><a href="/directory/listing/hidden">h</a></h2> --><h2 class="listing-title"><a href="/directory/listing/x">x</a></h2>'
            '<!-- <ul><li id="t-homepage"><a href="http://hidden.com">h</a></li></ul> --><li id="t-homepage"><a href="http://shown.com">h</a></li>'
            "<!-- " + LD + '{"url":"https://hidden.com"}</script> --><script>var b = "<!-- "</script>' + LD + '{"a": "<!-- x"}</script><!-- end -->')
    df = page(spark, html)
    r = X.page_text(df).first()
    assert (r.title, r.h1) == ("newt", "new")
    assert [x.url for x in X.listing_urls(df, "https://d.eu/directory/").collect()] == ["https://d.eu/directory/listing/x"]
    assert [x.website for x in X.infobox_website(df).collect()] == ["http://shown.com"]
    assert [x.raw for x in X.json_ld(df).collect()] == ['{"a": "<!-- x"}']
    assert [x.name for x in X.profile_records(spark.createDataFrame([(1, "u", html + "<a href='http://out.com'>o</a>")], df.schema), "s").collect()] == ["new"]


def test_elements_are_balanced(spark):
    inner = "<table><tr><td>in</td><td><a href='http://nested.com'>n</a></td></tr></table>"
    html = (f'<table class="wikitable"><tr><th>Company</th><th>Country</th><th>Website</th></tr>'
            f'<tr><td>Acme <div>x<div>y</div></div></td><td>FR {inner} after</td><td><a href="http://acme.com/">w</a></td></tr>'
            "<tr><td>Beta<td>DE<td></tr></table><p>tail</p>"
            '<div class="listing-title"><div>first</div><span><a href="/directory/listing/late">l</a></span></div><a href="/directory/listing/outside">o</a>'
            '<div class="wpbdp-field-category"><div><p class="value"><b>Fr</b> <span>an<i>ce</i></span></p></div></div>')
    df = page(spark, html)
    rows = {r.name: (r.country, r.website) for r in X.list_rows(df).collect()}
    assert rows["Acme x y"] == ("FR in n after", "http://nested.com")  # cells of a nested row count as cells of the row that holds it
    assert [x.url for x in X.listing_urls(df, "https://d.eu/directory/").collect()] == ["https://d.eu/directory/listing/late"]
    assert df.select(X._field(df.html, "category").alias("c")).first().c == "Fr an ce"


def test_elements_close_as_browsers_do(spark):
    def found(markup, wanted, **kw):
        df = page(spark, markup)
        return [(e.open, e.inner) for e in df.select(X.elements("html", wanted, **kw).alias("e")).first().e]
    assert found("a<i>b<br>c<img src=x>d</i>e</i>", "(?i)^<i") == [("<i>", "b<br>c<img src=x>d")]
    assert found('<p class="x y">1<p class="x">2</p>3</p>4', X.with_class("x")) == [('<p class="x y">', '1<p class="x">2</p>3'), ('<p class="x">', "2")]
    assert found("<ul><li>1<li>2</ul>3<li>4", "(?i)^<li") == [("<li>", "1<li>2"), ("<li>", "2"), ("<li>", "4")]
    assert found("<b>1<u>2</b>3</u>4", "(?i)^<u") == [("<u>", "2")]
    assert found("</b><DIV/><div >x", "(?i)^<div") == [("<div >", "x")]
    assert found("", "(?i)^<div") == [] and found("text < b > c", "(?i)^<b") == []
