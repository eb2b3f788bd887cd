import pytest

from clarispark.llm import html_layout


@pytest.mark.parametrize(("page", "want"), [
    ("<style>@media print{.n{display:none}}</style><p class=n>a", "a"), ("<style>@media (max-width: 600px){.n{display:none}} .m{display:none}</style><p class=n>a<p class=m>b", "a"),
    ("<style>@media screen and (min-width:600px){.n{display:none}}</style><p class=n>a<p>b", "b"), ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>@media not print{.n{display:none}}</style><p class=n>a<p>b", "b"), ("<style>.x{display:none}</style><style>.x{display:block}</style><p class=x>a", "a"),
    ("<style>#i{display:none}.x{display:block}</style><p class=x id=i>a<p>b", "b"), ("<style>.x{display:none!important}.x{display:block}</style><p class=x style='display:block'>a<p>b", "b"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"), ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"), ("<svg><title>t</title><defs/><text>one</text><text>two</text></svg>", "one\ntwo"),
    ("<style>div{visibility:hidden}b{visibility:visible}</style><div>a<b>b</b></div>", "b"),
])
def test_visible_text_is_emitted(page, want):
    assert html_layout.extract(page) == want
