import html as pyhtml
import time

from sitelore.functions import contacts as C, language as G, pricing as P, text as T
from sitelore.operators import models
from sitelore.operators.content import colors, section_of


def page(body, head=""):
    return f"<html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_entities_agree_with_the_standard_library(ev):
    texts = ["caf&eacute; &uuml;ber &frac12; &Eacute; &copy 2024 &#38;lt; and &lt; &notit; &ampx; &#150;&#x80; &#0; &#xD800; &#9999999; a&b &hellip;",
             "a &amp;lt; b", "&copy;&middot;&nbsp;x", "&#39;&#x41;&#1662;", "&quot;&unknown;&", "x &amp", "&amp;&amp;amp;", "plain"]
    assert ev(T.unescape("x"), texts) == [pyhtml.unescape(t) for t in texts]


def test_title(ev):
    cases = {
        "<title> A &amp; B </title>": "A & B", "<title></title>": "N/A", "<title> </title>": "",
        "<TITLE lang='x'>y</TITLE>": "y", "<title>a<b>c</b></title>": "N/A", "<p>no</p>": "N/A",
    }
    assert ev(T.page_title("x"), list(cases)) == list(cases.values())


def test_clean_text(ev):
    cases = {
        page("<nav>n</nav><p> a <b>b</b></p><footer>f</footer><form>q</form>"): "a\nb",
        page("a<script>var t='</p><nav>';</script>b"): "a\nb",
        page("<!-- c --><p>\xa0x </p>"): "x", page("1 < 2 and 3 > 2"): "1 < 2 and 3 > 2",
        page("<nav>n1<nav>n2</nav>n3</nav>q<footer><footer><footer>x</footer></footer></footer>"): "q",
        page('<p title="a>b">q</p>'): "q", "<body>a<script>var x = 1; </body>": "a",
        page("a\n\n\n\nb"): "a\n\nb", "<p>no body</p>": "no body", page(""): "", None: None,
    }
    assert ev(T.clean_text("x"), list(cases)) == list(cases.values())


def test_elements_are_dropped_whatever_their_nesting(ev):
    cases = {
        "a<nav>b<nav>c</nav>d</nav>e": "a|e", "a</form>b</form>c": "a</form>b</form>c", "<form>1<form>2</form>3": "<form>1|3",
        "<form>b</form></form>x": "|</form>x", "<nav><nav><nav>x</nav></nav>": "<nav>|", "p<nav>q<form>r</nav>s</form>t": "p|s</form>t",
        "a<nav>1<nav>2</nav>3<form>4<form>5</form>6</form>7</nav>8</nav>9": "a|8</nav>9", "": "", "x": "x", None: None,
        "<NAV a='>'>1<nav>2</NAV >3</nav>4": "|4", "<navy>1</navy><nav>2</nav>": "<navy>1</navy>|",
    }
    assert ev(T.drop_elements("x", T.BOILERPLATE, "|"), list(cases)) == list(cases.values())


def test_long_pages_of_tags_without_partners(ev):
    stray, deep = "<p>t</p></form>" * 60_000, "<form>" * 30_000 + "x" + "</form>" * 29_999
    start = time.perf_counter()
    assert ev(f"length({T.clean_text('x')})", [page(stray), page(deep)]) == [119_999, 0]
    assert time.perf_counter() - start < 60  # quadratic, it would take many minutes


def test_plain_text_keeps_navigation_and_needs_a_body(ev):
    got = ev(T.plain_text("x"), [page("<nav>n</nav><style>s</style>a"), "<p>x</p>"])
    assert got == ["n\na", ""]


def test_texts_are_whole_unless_a_cap_is_given(ev):
    long = page("<p>" + "word " * 30_000 + "</p>")
    assert len(ev(T.clean_text("x"), [long])[0]) == 149_999
    assert len(ev(T.clean_text("x", 40_000), [long])[0]) == 40_000


def test_main_content_tiers(ev):
    text = "This sentence is long enough to count as content."
    cases = {
        page(f"<p>other</p><article><p>{text}</p></article>"): text,
        page(f"<main>short</main><p>{text}</p><li><a href='/'>only a link</a></li>"): f"short\n{text}",
        page("<div>tiny</div>"): "tiny",
        page(f"x<main>{text}<article>B</article>C</main>y"): f"{text}\nB\nC",
        page(f"x<article>A<article>{text}</article>C</article>y<article>D</article>"): f"A\n{text}\nC\nD",
    }
    assert ev(T.main_content("x"), list(cases)) == list(cases.values())


def test_tokens(ev):
    assert ev(T.tokens("x"), [None, "", "a", "abcd", "a" * 11]) == [0, 0, 1, 1, 2]


def test_leading_paragraphs(ev):
    text = "a" * 40 + "\n\n " + "b" * 40 + " \n" + "c" * 400 + "\nd"
    assert ev(T.leading_paragraphs("x", 20), [text]) == ["a" * 40 + "\n" + "b" * 40]
    assert ev(T.leading_paragraphs("x", 5), [text]) == ["a" * 20]
    assert ev(T.leading_paragraphs("x", 5), [""]) == [""]


def test_first_sentences(ev):
    assert ev(T.first_sentences("x", 2), ["One.\nTwo two!  Three?", "no stop", ""]) == ["One. Two two!", "no stop", ""]


def test_faq(ev):
    got = ev(T.faq_pairs("x"), ["Q1?\nA1\nQ2?\nQ3؟\n\n A3 \nQ4?"])[0]
    assert [(r.question, r.answer) for r in got] == [("Q1?", "A1"), ("Q3؟", "A3")]


def test_script_language(ev):
    persian = "این یک متن فارسی است و گچ پژ دارد برای آزمون"
    arabic = "هذا نص عربي طويل بما يكفي للاختبار الاول"
    assert ev(G.script_language("x"), [persian, "هذا نص عربى طوىل بما هو مقبول للاختبار", "سلام", "", None, "text " * 99]) == ["fa", "ar", None, None, None, None]
    assert ev(G.script_language("x"), [persian + " english" * 100]) == [None]
    assert ev(G.script_language("x", 30), [persian + " english" * 100]) == ["fa"]
    assert ev(G.script_language("x"), [arabic])[0] in ("ar", "fa")


def test_stopword_language(ev):
    cases = {"The cat and the dog": "en", "le chat et les chiens": "fr", "der Hund und die Katze": "de",
             "el perro y los gatos": "es", "": "en", "xyz": "en", "der the": "de", "un": "es"}
    assert ev(G.stopword_language("x"), list(cases)) == list(cases.values())


def test_language_name(ev):
    assert ev(G.language_name("x"), ["FA", "nl", "Xx", "", None]) == [
        "Persian (Farsi)", "Dutch", "Xx", "the source language", "the source language"]


def test_contacts(ev):
    text = "Mail a.b@x.example.org, again a.b@x.example.org. Tel +98 21 8877 6655 or ۰۲۱-۸۸۷۷۶۶۵۵; short 12-34-56, long 12345678901234567"
    assert ev(C.emails("x"), [text]) == [["a.b@x.example.org"]]
    assert ev(C.phones("x"), [text]) == [["+98 21 8877 6655", "۰۲۱-۸۸۷۷۶۶۵۵"]]


def test_phones_in_runs_are_those_of_the_whole_text(ev):
    import regex

    from sitelore.functions import vocab as V

    texts = ["(021) 555 44 33x44 55 66 77", "+1 (659) 555-3949 00 44 20 7946 0958 12", "1-2-3 4455 6677 (88) 99 00 11", "99 " * 20]
    pattern = regex.compile(V.PHONE_RE)
    ok = lambda m: 7 <= len(regex.sub(r"\P{Nd}", "", m)) <= 15
    want = [list(dict.fromkeys(m.strip() for m in pattern.findall(t) if ok(m))) for t in texts]
    assert ev(C.phones("x"), texts) == want


def test_contact_context(ev):
    assert ev(C.context("a", "b"), [("x@y.z", ""), ("", ""), (None, "1")], ("a", "b")) == [
        "Emails: x@y.z\nPhones: none", None, "Emails: none\nPhones: 1"]


def test_sections(ev):
    cases = {
        ("https://s/contact/faq", "x"): "contact", ("https://s/faqs/", "x"): "faq", ("https://s/x", "Privacy Policy"): "policies",
        ("https://s/how-to-order", ""): "ordering_payment", ("https://s/پشتیبانی/", ""): "support_howto",
        ("https://s/services/", ""): "products_services", ("https://s/about-us/", ""): "company_overview",
        ("https://about.example/x", "t"): "additional",
    }
    assert ev(section_of("u", "t"), list(cases), ("u", "t")) == list(cases.values())


def test_colors(ev):
    css = "a{background:#FFF}b{background-color: #ffffff}c{background:#000}d{color:#Abc;border:#aabbcc}e{color:#123456}"
    got = ev(colors("x"), [css, "nothing", "body{background:#112233}"])
    pair = lambda x: x and (-x.n, x.code)
    assert [(pair(r.background), pair(r.brand)) for r in got] == [((2, "#ffffff"), (2, "#aabbcc")), (None, None), ((1, "#112233"), None)]


def test_prices(ev):
    names = ["gpt-5", "gpt-5-mini-2025-08-07", "gpt-5-2025", "gpt-4o-mini", "gpt-4", None, ""]
    assert ev(P.price("x", "input"), names) == [1.25, 0.25, 1.25, 0.15, 0.05, 0.05, 0.05]


def test_usd_is_rounded_as_python_does(spark):
    from pyspark.sql import functions as F

    amounts = [0.0, 0.0000005, 0.0000015, 0.0000525, 0.0000125, 1.0000005, 2.5e-7, 1234.5678915] + [i * 0.05 / 1e6 for i in range(500)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "i int, a double")
    got = [r[0] for r in df.orderBy("i").select(F.expr(P.usd("a"))).collect()]
    assert got == [f"{a:.6f}" for a in amounts]


def test_answers(spark):
    good = '{"url": "u", "title_suggestion": "t", "primary_category": " FAQ ", "extracted_chunk": "c"}'
    cases = {
        good: ("u", "t", "faq", "c"), f"x\n```json\n{good}\n```\ny": ("u", "t", "faq", "c"), f"```\n{good}\n```": ("u", "t", "faq", "c"),
        f"```json\n{good}": ("page", "title", "additional", ""), "{bad": ("page", "title", "additional", ""), "": ("page", "title", "additional", ""),
        '{"primary_category": "nope"}': ("page", "title", "additional", ""), '{"extracted_chunk": "only"}': ("page", "title", "additional", "only"),
        "{'url': 'single quotes'}": ("page", "title", "additional", ""), good + ' {"x": 1}': ("page", "title", "additional", ""),
    }
    rows = [(str(i), "page", "title", c) for i, c in enumerate([*cases, None])]
    df = spark.createDataFrame(rows, "request_id string, page_url string, page_title string, content string")
    got = [tuple(r)[1:] for r in models.model_responses(df).orderBy(df.request_id.cast("int")).collect()]
    assert got == [*cases.values(), ("page", "title", "additional", "")]
