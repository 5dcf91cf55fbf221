"""Capitals and letters have one definition for texts of all lengths and scripts."""

import pytest

from docloom.llm.quality_rules import FEATURES, features


@pytest.mark.parametrize("word", ["ПРИВЕТ", "ΚΑΛΗΜΕΡΑ", "Été", "漢字", "नमस्ते", "Word", "x1!", "😀"])
@pytest.mark.parametrize("n", [1, 39, 40, 300])
def test_letters_of_any_script(word, n):
    text = " ".join([word] * n)
    got = dict(zip(FEATURES, features(text)))
    assert (got["n_upper"], got["n_letters"]) == (sum(map(str.isupper, text)), sum(map(str.isalpha, text)))
