"""Pages of which visible text was once lost: formulas, and quotes that don't open a value."""

import pytest

from crawlweave.llm import render

CASES = [
    ("<p title=don't>Hello it's a world</p>", "Hello it's a world"), ('<p class="x"">Hello "you"</p>a', 'Hello "you"\n\na'), ("<p 'a>b'</p>", "b'"),
    ("<a href=it's/>x</a> y's", "x y's"), ("<p a = 'x > y' b=>t", "t"), ("<p ='x'>t'</p>", "t'"), ("<i/>a</i><br/>b", "a\nb"), ("<p title=\"a>b", "<p title=\"a>b"),
    ("<input value=a'b>", "a'b"), ("<input/value='a'/>", "a"),
    ("so <math><mi>x</mi> <mo>=</mo>\n<mn> 2 </mn></math> holds", "so x=2 holds"), ("<math><mi>a</mi><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "a 1 2"),
    ("<math><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup></mrow><annotation encoding='t'>x^2</annotation></semantics></math>.", "x2."),
    ("a<math display=block><mi>y</mi></math>b", "a\ny\nb"), ("<math><mi>x</mi><mspace width='1em'/><mtext>if <b>so</b></mtext></math>", "xif so"), ("<math hidden><mi>x</mi></math>a", "a"),
    ("<svg><g/><path d='m'/></svg>a", "a"), ("<math/>a", "a"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_visible_text(page, text):
    assert render.visible_text(page) == text


def test_unclosed_tags_stay_text():
    assert render.visible_text("<a " * 2_000 + "end").endswith("end")
