"""Paths of public vocabulary files; the files themselves are never copied here."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file on this machine; every worker resolves it for itself."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
