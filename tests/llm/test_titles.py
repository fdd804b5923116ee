import pytest
from cadenza.llm.titles import same_title, title_key

SAME = [
    ("Fakasmun's Orchard (Acoustic Session) feat. Joaquim T", "Fakasmuns Orcahrd - Acoustic Session"),
    ("Crimson Señal ft. Mirela (SE)", "crimson senal [Explicit]"),
    ("X Yard (feat. Hik (SE)) (Live)", "x yard - live"),
    ("Meadow in Kidortel, Part 2", "Meadow in Kidortl Pt. 2 - 2015 Remaster"),
    ("Frozen Café (Deluxe Edition)", "frozrn cafe"),
    ("Burning (Live) feat. A", "Burning (Live)"),
    ("Thunder No. II", "Thunder no 2"),
    ("Quiet ft. A and B (Live in the Barn)", "Quiet (Live in the Barn)"),
]
APART = [
    ("Meadow, Pt. 1", "Meadow, Pt. 2"), ("Frozen", "Frozen (Live)"), ("Le Carousel Frozen", "Le Carousel Broken"), ("Frozen (Instrumental)", "Frozen (Acoustic)"),
    ("Thunder No. 7", "Thunder No. 8"), ("Frozen (Night Remix)", "Frozen (Remastered)"), ("Live", "Live (Live)"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert same_title(title_key(a), title_key(b))


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(a, b):
    assert not same_title(title_key(a), title_key(b))


def test_odd_texts():
    for t in ("", " ", "()", "(Live)", "!!!", "feat. X", "- - -", ")(", "[[", "x" * 5000):
        assert title_key(t).count("\x1f") == 2
