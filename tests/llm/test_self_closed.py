import pytest

from millrace.llm import htmltext


@pytest.mark.parametrize("tag", ["<svg/>", '<svg class="icon" viewBox="0 0 8 8"/>', "<svg class=icon />", "<svg hidden/>", "<math/>", "<svg><path d='M0'/></svg>", "<button><svg/>Press</button>"])
def test_text_after_an_icon(tag):
    page = f"<body><article>{tag}<p>First one here.</p><p>Second one here.</p></article></body>"
    assert [x for x in htmltext.parse(page).text if x] == ["First one here.", "Second one here."]


def test_slash_of_an_unquoted_value():
    assert not any(htmltext.parse("<article><svg class=icon/>drawn</svg></article>").text)
