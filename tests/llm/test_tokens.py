"""The encoder of the queries gives the ids of the untouched library."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridlens.llm.tokens import encoder
from tests.llm import fixtures as fx
from tests.llm.test_store import NAMES, ODD


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_are_found(name):
    texts = ["end <|endoftext|> begin", "<|startoftext|>a b", "a<|endoftext|>", "<|ENDOFTEXT|> x  y", "<|endoftext| >", *ODD, *fx.odd_texts()]
    library = Tokenizer.from_file(fx.vocabulary(name))
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert encoder(name).encode(texts) == want
