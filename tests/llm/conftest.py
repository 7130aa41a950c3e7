import pytest


@pytest.fixture(scope="session")
def tokenizer():
    """The tokenizer as its file makes it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
