import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweave.llm.encoder import Encoder
from llm_helpers import TOKENIZER, messy_rows

WHOLE = Tokenizer.from_file(TOKENIZER)
FAST = Encoder(TOKENIZER)


def same(text):
    return np.frombuffer(FAST.encode([text])[0], "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_byte_level_file_gets_the_fast_path():
    assert FAST.fast is not None


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n b", "a \nb", "it's we'll 'd", "x" * 5000, "ab" * 30000, "a" + "\n" * 5000 + "b",
                                  "12 345,6 %%% ***", "a\tb\t c", " a  ", "a\x1c b", "café naïve"])
def test_edges_match_the_library(text):
    assert same(text)


def test_messy_texts_match_the_library():
    assert all(same(r[1]) for r in messy_rows() if r[1] is not None)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcZ'19 .,\n\t\r éß’€日\U0001f642|<>")), max_size=60))
def test_random_texts_match_the_library(text):
    assert same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_unicode_matches_the_library(text):
    if not any("\ud800" <= c <= "\udfff" for c in text):
        assert same(text)
