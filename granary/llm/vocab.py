"""Files of public tokenizers: paths are parameters, nothing is copied here."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

TOKENIZER_DIR = "/opt/tokenizers"


def vocab_path(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file; `folder` or $GRANARY_TOKENIZERS override the default place."""
    return os.path.join(folder or os.environ.get("GRANARY_TOKENIZERS", TOKENIZER_DIR), name)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
