"""Byte-level BPE vocabularies of public tokenizers; their files are read on the driver from a path that is a parameter."""

from __future__ import annotations

import base64
import json
from pathlib import Path


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (one base64 token and its rank in each line)."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[str], str]:
    """Of a byte-level BPE tokenizer file: token bytes -> id without added tokens, the added tokens' strings, and the file itself."""
    file = Path(path).read_text(encoding="utf-8")
    data = json.loads(file)
    added = [t["content"] for t in data["added_tokens"]]
    of = _printable_bytes()
    return {bytes(of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}, added, file
