"""Main text where names only look like those of adverts, and where elements were left open."""
import pytest

from ledgerlens.llm import wrappers

START, END = "<html><body><nav>Menu</nav><article><h1>Head</h1><p>First paragraph here.</p>", "</article><footer>Foot</footer></body></html>"


def text(spark, html):
    pages = spark.createDataFrame([(1, "http://a.example/x", html)], "page_id long, url string, html string")
    return wrappers.main_texts(pages).first()["text"]


@pytest.mark.parametrize("inside, kept", [
    ('<div class="related-work"><p>Work.</p></div>', "Work."),
    ('<section id="ad-hoc-networks"><p>Networks.</p></section>', "Networks."),
    ('<section id="social-structure"><p>Structure.</p></section>', "Structure."),
    ('<div class="ad"><p>Buy.</p></div>', ""), ('<div class="wide related-links"><p>More.</p></div>', ""),
    ('<div id="comments-list"><p>So true.</p></div>', ""), ('<div class="x share_buttons_2"><p>Share.</p></div>', ""),
    ("<p>Let x = <math><mi>2</mi></math> hold.</p>", "Let x = 2 hold."), ("<p>A <canvas>drawn</canvas> line.</p>", "A drawn line."),
    ("<p>One <object data=a>two</object> three.</p>", "One two three."),
    *[(f"<div>Words <{tag}>hidden</div><p>Second paragraph.</p>", "Words\nSecond paragraph.") for tag in
      ("button", "svg", "select", "noscript", "template", "audio", "video")],
    *[(f"<p>Words <{tag}>hidden<p>Second paragraph.</p>", "Words\nSecond paragraph.") for tag in ("button", "svg", "select")],
    ("<div>Words <noscript><div>off</div><p>on</p></noscript> go on.</div>", "Words go on."),
    ("<div>Words <button><div>Press</div></button> go on.</div>", "Words go on."),
    ("<p>Words <svg><title>Icon</title><g><text>T</text></g></svg> go on.</p>", "Words go on."),
])
def test_what_stays(spark, inside, kept):
    want = "\n".join(x for x in ("Head\nFirst paragraph here.", kept, "Last paragraph here.") if x)
    assert text(spark, f"{START}{inside}<p>Last paragraph here.</p>{END}") == want
