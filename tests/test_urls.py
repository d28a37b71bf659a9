from urllib.parse import urljoin, urlparse

from sitelore.functions import urls as U

URLS = [
    "http://A.example.org:8080/a/b;p=1?x=1#f", "https://h/", "https://h", "HTTP://h/x#", "https://h/x?",
    "https://h/x?#f", "mailto:a@b.co", "//h/x", "/a/b", "?q", "#f", "https://h/a;b/c;d", "https://h/?a=b?c#d#e",
]
HREFS = [
    "x", "./x", "../x", "../../../x", "/x/../y", "/x/./y/..", "?q=1", "#f", "", "//o.example/z", "mailto:a@b",
    "http://o.example/a/../b", "a/b/", "a//b", "..", ".", "../", "x?y=../z", "x#a/../b", "/", "HTTPS://o/x",
]
BASES = ["http://h.example/a/b/c.html?q=1#f", "https://h.example/a/b/", "http://h.example", "http://h.example/"]


def test_parts_agree_with_the_standard_library(ev):
    for name in ("scheme", "netloc", "path", "query", "fragment"):
        assert ev(getattr(U, name)("x"), URLS) == [getattr(urlparse(u), name) for u in URLS]


def test_normalize(ev):
    want = [urlparse(u)._replace(fragment="").geturl() for u in URLS]
    assert ev(U.normalize("x"), URLS) == want
    assert ev(U.normalize("x"), want) == want  # idempotent
    assert ev(U.normalize("x"), [None]) == [None]


def test_resolve_agrees_with_the_standard_library(ev):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = ev(U.resolve("base", "href"), pairs, ("base", "href"))
    clean = lambda u: urlparse(u)._replace(fragment="").geturl()
    wrong = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if clean(g) != clean(urljoin(*p))]
    assert not wrong


def test_drop_reason_order(ev):
    site = "s.example"
    cases = {
        None: "invalid", "mailto:a@b": "non_http", "ftp://s.example/x.pdf": "non_http",
        "https://o.example/x.pdf": "offsite", "https://s.example:80/x": "offsite",
        "https://S.example/x": "offsite", "https://s.example/cart/x.PDF": "asset",
        "https://s.example/x.pdf;v=1": "asset", "https://s.example/x.pdf?y": "asset",
        "https://s.example/x?f=a.pdf": "kept", "https://s.example/CART": "transactional",
        "https://s.example/tag/login": "transactional", "https://s.example/tag/x": "archive",
        "https://s.example/tags": "kept", "https://s.example/page/2": "archive",
        "https://s.example/product/1?page=2": "faceted", "https://s.example/product/1": "product",
        "https://s.example/x-p-/1": "kept", "https://s.example/-p-/1": "product",
        "https://s.example/سبد-خرید": "transactional", "https://s.example/محصول/۱": "product",
    }
    got = ev(U.drop_reason(f"'{site}'", "x"), list(cases))
    assert dict(zip(cases, got)) == cases


def test_tier_is_read_off_the_whole_address(ev):
    cases = {
        "https://json.example/guide": "skip", "https://s.example/guide/cart": "skip",
        "https://s.example/category/how-to": "high", "https://s.example/brand/x": "medium",
        "https://s.example/product/x": "low", "https://s.example/x": "medium",
        "https://s.example/آموزش": "high",
    }
    assert ev(U.knowledge_tier("x"), list(cases)) == list(cases.values())
