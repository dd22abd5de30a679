"""Column functions against Python's own URL and regular-expression libraries."""

import random
from urllib.parse import urljoin, urlparse

import regex

from pageloom.functions import html as hx
from pageloom.functions import parsing as px
from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.registry.oracle import CLEANING

SPLIT = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


def plainly_cleaned(text):
    text = text.encode("ascii", "ignore").decode()
    for pattern, by in CLEANING[1:-1]:
        text = regex.sub(pattern, by, text)
    return " ".join(text.split())


PIECES = [
    "http://a.b/c?d", "https://x y", "me@x.org", "@a@b", "a@", "@", "x@@y", "[1]", "[1-3, 5]", "[1,", "[J].", "[j].",
    "2.3mg", "2.30 mg", "1.5e-4", "3.25", "v1.2.3", "Smith", "J.", "D.", "Doe J. 2019 pp 12", "2019", "12345", "A.",
    "AB.", "aA.", "Dr.", "U.S.", "e.g.", "word", "é", "naïve", ",", ".", "!", "?", "...", " ,", " . ", "  ", "\n", "\t",
    "\r\n", "\x1c", "\x85", " ", "　", "mg", "x.y. z", "What? No", "_", "0", "e5",
]


def random_texts(n=600):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_cleaning_equals_the_plain_rules(column):
    texts = random_texts()
    assert column(tx.clean_text, texts) == [plainly_cleaned(t) for t in texts]


def test_cleaning_keeps_null_and_empty(column):
    assert column(tx.clean_text, [None, "", "  "]) == [None, "", ""]


def test_cleaning_rules_one_by_one(column):
    cases = {
        "see http://a.b/c now": "see now",
        "mail me@x.org now": "mail now",
        "so [1-3,5] it": "so it",
        "add 2.3 mg salt": "add salt",
        "p 1.5e-4 q": "p q",
        "Nature [J]. ok": "Nature ok",
        "by Smith J. Doe 2019 vol 12 end": "by end",
        "a ,b .c": "a, b. c",
        "J. D. Roe": "J.D.Roe",
    }
    assert column(tx.clean_text, list(cases)) == list(cases.values())


def test_long_runs_stay_cheap(column):
    texts = [" " * 200_000 + "x", "y" * 200_000 + " z", "@" * 50_000 + "a", "a b" + "\n" * 100_000, "1" * 100_000 + ". A. "]
    assert column(tx.clean_text, texts) == ["x", texts[1], "", "a b", "1" * 100_000 + ". A."]


def test_sentences(column):
    texts = random_texts() + ["Dr. X met U.S. a man. e.g. b? Yes! no. end"]
    expected = [[s.strip() for s in regex.split(SPLIT, t) if s.strip()] for t in texts]
    assert column(tx.split_sentences, texts) == expected


def test_strip_and_counts(column):
    texts = random_texts(200)
    assert column(tx.strip, texts) == [t.strip() for t in texts]
    assert column(tx.token_count, ["a b  c\n", "", "x"]) == [3, 0, 1]


def plain_canonical(url):
    parsed = urlparse(url)
    scheme = "https" if parsed.scheme == "http" else parsed.scheme
    path = parsed.path if parsed.path == "/" else parsed.path.rstrip("/")
    return f"{scheme}://{parsed.netloc.replace('www.', '')}{path}"


URLS = [
    "http://a", "http://a/", "http://a//", "HTTP://A.org/X/", "https://www.www.a.org:8080/x//", "http://awww.b/c", "https://a/x?y#z",
    "https://a/x#z?y", "https://a?q/r", "http://a/x;p=1", "http://a/x;p=1/", "http://a/x;p/y;q", "ftp://www.a/b/", "http://u@www.a/b",
    "  http://a/b \n", "http://a/b\tc", "http://wwww.www.a/", "http://a/www.b/",
]


def test_canonical_url(column):
    assert column(urls.canonical_url, URLS) == [plain_canonical(u) for u in URLS]
    assert column(urls.page_key, URLS) == [plain_canonical(plain_canonical(u)) for u in URLS]


HREFS = [
    "", "x", "./x", "../x", "../../../x", "/x", "//h/x", "?q=1", "#f", "x?q#f", "mailto:a@b", "https://h/y", "HTTPS://h/y", "ftp://h",
    "a//b", "a/./b/../c", "..", ".", "x/..", "/a/../b/./", "x y", "/", "a/b/", "./", "../",
]


def test_resolved_urls(column):
    bases = ["https://h.org", "https://h.org/", "https://h.org/a", "https://h.org/a/b/", "https://h.org/a/b?c=1", "http://h:80/a/b/c"]
    pairs = [(b, h) for b in bases for h in HREFS if not h.lower().startswith("https://")]
    found = column(urls.resolve_url, [b for b, _ in pairs], [h for _, h in pairs])
    wrong = [(b, h, f, urljoin(b, h)) for (b, h), f in zip(pairs, found) if f != urljoin(b, h)]
    assert not wrong


def test_link_predicates(column):
    assert column(urls.has_keyword, ["https://a/Model1", "https://a/model", "https://Results.org/", "https://a/b"]) == [True, False, True, False]
    assert column(urls.same_host, ["https://a:1/x"] * 3, ["https://a:1/y", "https://a/y", "https://A:1/y"]) == [True, False, False]
    parents, children = ["https://a/Team", "https://a/Team", "https://a/", "https://a"], ["https://a/TeamX", "https://a/Tea", "https://a/x", "https://a/"]
    assert column(urls.below_path, parents, children) == [True, False, True, True]


def test_html_text(column):
    cases = {
        "<html><head><title>no</title></head><body><p>a <b>b</b></p><p>c<br>d</p></body></html>": "a b\nc\nd",
        "x<script>var t='</p>';</script>y<style>p{}</style><!-- <p>z --> w": "xy w",
        "a<script>never closed <p>b": "a",
        "1 &lt; 2 &amp;lt; 3 &#233; &#xe9; &#38;lt; &#0; &bogus; &copy;": "1 < 2 &lt; 3 é é &lt; � &bogus; ©",
        "a < b and c > d": "a < b and c > d",
        "<ul>\n <li>one</li>\n <li>two</li></ul>": "one\ntwo",
        "": "",
        None: "",
    }
    assert column(hx.html_text, list(cases)) == list(cases.values())


def test_anchors(column):
    html = """<a href="/x">1</a><A class=k HREF='y?a=1&amp;b=2'>2</A><a href=z>3</a><a name="q">4</a>
      <!-- <a href="no">5</a> --><a data-href="no">6</a><abbr href="no">7</abbr><a\nhref = "w">8</a><a href="">9</a>"""
    assert column(hx.anchor_hrefs, [html]) == [["/x", "y?a=1&b=2", "z", "w", ""]]


def test_completions(column):
    texts = ["Question: a? Answer: b \n", "Question: x Question: y? Answer: b Answer: c", "nothing", "Answer: only", None]
    assert column(px.parsed_question, texts) == ["a?", "y?", "nothing", "", None]
    assert column(px.parsed_answer, texts) == ["b", "c", "nothing", "only", None]


def test_scores(column):
    texts = ["Score: 4", "Score: 4/5", "Score:", "Score: 2 then Score: 3", "none", None, "Score:\n 5\nok", "Score: 4.", "score: 3"]
    assert column(px.parsed_score, texts) == [4, None, None, 2, 0, None, 5, None, 0]


def test_settings(column):
    name = column(px.results_file_name, ["200"], ["hub/model-a.v2"])[0]
    assert name == "rag_chunk_size:200_embeddings:hub-model-a.v2.json"
    assert column(px.short_settings, [name]) == ["200,hub-model-a"]
    text = column(px.encode_config, ["d.parquet"], ["250"], ["hub/gan"])[0]
    assert column(px.decode_config, [text, text + ")", "junk"]) == [("d.parquet", 250, "hub/gan")] * 2 + [(None, None, None)]


def test_all_entities_like_the_standard(column):
    import html
    from html.entities import html5

    names = [n for n in html5 if n.endswith(";")]
    cases = [f"a&{n}b" for n in names] + [
        "&#65;", "&#0000000065;", "&#x0000000041;", "&#X41;", "&amp;lt;", "&amp;#65;", "&#38;lt;", "&nosuch;", "&;", "& &", "a&b;c", "&eacute;&rarr;", "&#1234567890;", "&#xD800;", "&#;", "x&amp",
    ]
    expected = {"&#1234567890;": "�", "&#xD800;": "�", "x&amp": "x&amp"}
    got = column(hx.decode_entities, cases)
    for case, value in zip(cases, got):
        assert value == expected.get(case, html.unescape(case)), case


def test_quoted_ends_of_tags(column):
    cases = ['<a title="a>b" href="q">x</a>', "<a title='>' href='r'>", '<a href="s" title="unclosed>y</a>', "<a href=t>z</a>", '<a\ntitle="</a>"\nhref="u">']
    assert column(hx.anchor_hrefs, cases) == [["q"], ["r"], ["s"], ["t"], ["u"]]
    assert column(hx.html_text, ['<p title="1 > 0">shown</p>', '<img alt="a>b">text', "2 < 3 'and' 4 > 1"]) == ["shown", "text", "2 < 3 'and' 4 > 1"]


def test_rooted_and_empty_references(column):
    from urllib.parse import urljoin

    base = "https://s.org/a/b/c?x=1"
    hrefs = ["/a//b", "//", "https://", "https:", "///p", "a//b", "./a", "/a//../b", "/", "//h.org//x", "https:d", "#f", "?q", "//#f"]
    got = column(urls.resolve_url, [base] * len(hrefs), hrefs)
    for href, value in zip(hrefs, got):
        assert value == urljoin(base, href), href


def test_urls_by_chance_are_those_of_the_plain_rules(column):
    """Against the rules without their guards, and links of a page resolved together against each on its own."""
    from pyspark.sql import functions as F

    deal = random.Random(3)
    bits = ["http:", "//", "www.", "h.org", "/", "a", "..", ".", ";p", "?q=1", "#f", "b;c", " ", "Model", "www.x", " "]
    made = ["".join(deal.choices(bits, k=deal.randint(0, 7))) for _ in range(600)]

    def plain(url):
        for pattern, kept in [(urls._WWW, "$1$2"), (urls._PARAMS, "$1"), (urls._END_SLASHES, "$1")]:
            url = F.regexp_replace(url, F.lit(pattern), F.lit(kept))
        return url

    assert column(urls._settle, made) == column(plain, made)
    bases = ["http://www.h.org" + deal.choice(["", "/", "/a/b", "/a/b/", "/a;p/c;q", "/a/../b?x#y"]) for _ in made]
    one = column(urls.resolve_url, bases, made)
    several = column(lambda b, h: F.array_join(urls.resolve_urls(b, F.array(h, F.lit("c"))), "\n"), bases, made)
    assert [s.rpartition("\n")[0] for s in several] == one
