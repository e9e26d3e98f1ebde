"""Very long white space in texts, and comments and quotes of pages as browsers read them."""

import numpy as np
import pytest

from tessera.llm import html, packing


@pytest.mark.parametrize("space", [" ", "\t", "\n", " \n"])
def test_long_white_space(space):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = packing.encoder(path), Tokenizer.from_file(path)
    for text in (space * 3_000_000, f"a word{space * 60_000}and more  words", space * 49_999 + "x", f"{space * 70_000} y{space * 70_000}"):
        got = np.frombuffer(encode(text), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids


def blocks(page):
    return [t for _, t, _ in html.tree(page)[1]]


def test_comments():
    assert blocks("<article><p>A first</p><!--><p>B second</p><p>C third</p></article>") == ["A first", "B second", "C third"]
    assert blocks("<p>A</p><!---><p>B</p><!----><p>C</p><!-- x > <p>no</p> --!><p>D</p><!-- y --><p>E</p><!-- open <p>no</p>") == ["A", "B", "C", "D", "E"]


def test_quotes():
    assert blocks("<p data-x=it's>four</p><p>five</p><p title='>q'>six</p>") == ["four", "five", "six"]
    assert blocks("""<p a="x > y" b = 'z > w' c=d="e f>one</p><p it's>two</p><p a=>three</p><p a='>four</p><p b="y">five</p>""")[:3] == ["one", "two", "three"]
    assert html.tree("<p " + "a=\"x " * 50_000 + ">text</p>")[1][0][1] == "text"


@pytest.mark.parametrize("least,most", [(900, 1501), (600, 1101), (2, 2048), (1000, 1030)])
def test_plans_beat_best_fit(least, most):
    """A plan holds every piece and never needs more sequences than best fit alone."""
    lengths, counts = np.unique(np.random.default_rng(least).integers(least, most, 6000), return_counts=True)
    plan = packing.solve(lengths, counts, 2048)
    assert (sum(p * n for p, n in plan) == counts).all() and all((p * lengths).sum() <= 2048 for p, _ in plan)
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(lengths, counts, 2048))
