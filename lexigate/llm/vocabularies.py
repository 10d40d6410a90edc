"""Where the public vocabulary files are; they are installed, never copied here."""

from __future__ import annotations

import public_tokenizers

PATTERN = public_tokenizers.PATTERN


def vocabulary(name: str) -> str:
    """Path of a vocabulary file on this machine; every executor has the same installation."""
    return public_tokenizers.path(name)
