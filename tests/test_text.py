import pytest

from quire.functions import normalize as N
from quire.functions import text as T
from quire.operators import slicing


@pytest.mark.parametrize(("n", "tokens"), [(0, 0), (1, 1), (27, 20), (2025, 1500)])
def test_token_count(one, n, tokens):
    assert one(T.token_count, "x" * n) == tokens


def test_trailing_context(one):
    assert one(lambda c: T.trailing_context(c, 4), "alpha beta gamma") == "gamma"
    assert one(lambda c: T.trailing_context(c, 8), "alpha beta gamma") == "gamma"
    assert one(T.trailing_context, " short ") == "short"
    assert one(T.trailing_context, None) == ""


def test_vowels(one):
    assert one(T.strip_vowels, "شَدَّة") == "شدة"
    assert one(lambda c: T.strip_vowels(c, True), "شَدَّة") == "شدّة"
    assert one(T.strip_vowels, None) == ""
    assert one(T.strip_vowels, "ٕٓٔ") == "ٕٓٔ"


def test_clean_target(one):
    assert one(T.clean_target, "the presential  knowledge") == "presential knowledge"
    assert one(T.clean_target, '"of the"') == ""
    assert one(T.clean_target, "theory") == "theory"


def test_sanitize(one):
    text = "Wait, look at this\nA line.\n- \"العلم\" -> \"Knowledge\"\nFormatting check:"
    assert one(T.sanitize, text) == "A line.\n> العلم\n\nKnowledge"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("التصـــور والتصديق​", "التصور والتصديق"),
        ("ﻻ ﷲ ﻗﻢ", "لا الله قم"),
        ("‫الكلي‬ والجزئي‎", "الكلي والجزئي"),
        ("كيف تعريف تصنيف", "كيف تعريف تصنيف"),
        (None, ""),
        ("a  b\r\n\r\n\r\n\r\nc ", "a b\n\nc"),
        ("½ ﬁ", "1⁄2 fi"),
        (":الدرس الأول", "الدرس الأول:"),
    ],
)
def test_normalize(one, text, want):
    assert one(N.normalize, text) == want
    assert N.normalized(text) == want


def test_particles(one):
    assert one(N.normalize, "العلم يف الذهن عىل ثالثة كام بني").split() == ["العلم", "في", "الذهن", "على", "ثلاثة", "كما", "بين"]


def test_reversed_lines(one):
    line = "باتكلا ةسردم"
    assert one(N.fix_reversed, line) == line[::-1]
    assert one(N.fix_reversed, "plain (text) 12") == "plain (text) 12"
    assert N.turn_line("(12) ab") == "ba (12)"


def test_page_ranges():
    assert slicing.page_range("10-25") == (9, 16)
    assert slicing.page_range("0-5") == (0, 6)
    assert slicing.page_range("10:") == (9, None)
    assert slicing.page_range(":20") == (0, 20)
    assert slicing.page_range(None, 10, 5) == (10, 5)
    for bad in ("25-10", "invalid_range"):
        with pytest.raises(ValueError):
            slicing.page_range(bad)
