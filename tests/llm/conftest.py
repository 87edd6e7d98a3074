import pytest

from granary.llm.vocab import vocab_path


@pytest.fixture(scope="session")
def ranks_path():
    import os

    p = vocab_path("byte_bpe_50k.tiktoken")
    if not os.path.exists(p):
        pytest.skip("the public tokenizers are not here")
    return p
