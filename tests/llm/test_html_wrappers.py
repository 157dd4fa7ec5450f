from palate.llm.html_wrappers import align, extract, main_text, region, stream, wrappers

SCHEMA = "page_id bigint, url string, html string, host string, text string"
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy.</div><article><h1>A &amp; b</h1><p><b>One<br><p>Two  \n three &lt;x&gt;</p>{more}</article>'
    '<div id="comments"><p>No</p></div><aside>S</aside><form><p>F</p></form><footer>&copy; z</footer></body></html>'
)


def test_main_text():
    assert main_text(PAGE.format(more="<p>Four</p>") if False else PAGE.replace("{more}", "<p>Four</p>"), None) == "A & b\nOne\nTwo three <x>\nFour"
    assert main_text("", None) == "" and main_text("plain &am", None) == "plain &am"
    cut = PAGE.replace("{more}", "<p>Fo")
    assert main_text(cut[: cut.index("Fo") + 2], None) == "A & b\nOne\nTwo three <x>\nFo"


def test_align_is_union_free():
    one = [[x, 0] for x in ("+a", "+b", "+c")]
    assert align(one, [[x, 0] for x in ("+a", "+b", "+b", "+c")]) == [["+a", 0], ["+b", 2], ["+c", 0]]
    assert align([[x, 0] for x in ("+a", "+c")], [[x, 0] for x in ("+a", "+x", "+c")]) == [["+a", 0], ["+x", 1], ["+c", 0]]
    assert region([["-nav", 0], ["+html/body/article/p", 0], ["+html/body/div/p", 2]]) == "html/body/article"


def test_query(spark):
    rows = [(i, f"https://h{i % 2}.org/{i}", PAGE.replace("{more}", f"<p>n{i}</p>" * i), "", "") for i in range(6)]
    rows += [(9, None, None, None, None), (10, "https://h0.org/", "", "", ""), (10, "https://h0.org/", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert len(got) == 9 and wrappers(df).count() == 3
    text = {r[0]: r[2] for r in got}
    assert all(text[i] == "\n".join(["A & b", "One", "Two three <x>", *[f"n{i}"] * i]) for i in range(6))
    assert text[9] == text[10] == "" and all(r[3] == len(r[2]) for r in got)
    assert extract(df.where("false")).collect() == []


def test_blocks_that_differ_from_page_to_page():
    page = '<html><body><div id="top{i}"><p>block {i}</p></div><article><h1>T{i}</h1><p>text {i}</p></article></body></html>'
    plain = '<html><body><div id="top{i}"><p>block {i}</p></div><div class="text"><h2>T{i}</h2><p>text {i}</p><ul><li>{i}</li></ul><h3>x</h3></div></body></html>'
    for form, last in ((page, ""), (plain, "\n{i}\nx")):
        wrapper = []
        for i in range(450):
            other = [[x, 0] for x in stream(form.replace("{i}", str(i)))]
            wrapper = align(wrapper, other) if wrapper else other
        assert len(wrapper) <= 6
        assert main_text(form.replace("{i}", "7"), wrapper) == f"T7\ntext 7{last}".replace("{i}", "7")


def test_an_article_after_many_blocks():
    many = "".join(f'<div class="a{i}"><p>b{i}</p></div>' for i in range(500))
    page = f"<html><body>{many}<article><h1>T</h1><p>text</p></article></body></html>"
    assert len(stream(page)) == 502
    assert main_text(page, [[x, 0] for x in stream(page)]) == main_text(page, [["+html/body/p", 0]]) == "T\ntext"


def test_template_text_is_left_out(spark):
    page = "<html><body><div class='m1'><p>Home</p><p>Shop now</p></div><div><p>Text {i}.</p><p>More of {i}.</p></div><p>All times are UTC</p></body></html>"
    rows = [(i, f"https://t.org/{i}", page.replace("{i}", str(i)), "", "") for i in range(5)] + [(9, "https://u.org/", page, "", "")]
    rows += [(20 + i, "https://same.org/", page, "", "") for i in range(4)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Text {i}.\nMore of {i}." for i in range(5))
    # One page, or copies of one, tell nothing apart.
    assert got[9] == got[20] == "Home\nShop now\nText {i}.\nMore of {i}.\nAll times are UTC"
