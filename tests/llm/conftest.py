import pytest

from prevuelo.llm.queries import tokenizer


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer("word_bpe_49k.json")
