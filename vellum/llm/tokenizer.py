"""Encoders over public vocabulary files, built once per Python worker."""
from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

#: A text may be cut before a space that stands between two ASCII letters or digits: the
#: byte-level pattern starts a new word there, and no special string holds a space.
SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Texts longer than this many characters are cut at safe places.
PIECE_CHARS = 32_768


def resolve(path: str) -> str:
    """``public:NAME`` names a file of the installed vocabulary package on the worker's
    own disk; anything else is a path that every worker can open."""
    if path.startswith("public:"):
        import public_tokenizers
        return public_tokenizers.path(path[len("public:"):])
    return path


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function text -> list of ids.

    ``.tiktoken``: byte-level ranks; ``<|endoftext|>`` inside a text becomes the id after
    the last rank, as the ``.json`` form of the same vocabulary does by default (the two
    give equal ids, see tests/llm/test_tokens.py; the rank encoder is about five times
    faster, and hands texts that it cannot split to the ``.json`` file beside it).  ``.json``: tokenizers; ``.model``: sentencepiece.  None adds begin or end
    tokens, truncates or pads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    file = resolve(path)
    if file.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={"<|endoftext|>": max(ranks.values()) + 1})
        whole = f"{path.removesuffix('.tiktoken')}.json"

        def encode(text: str) -> list[int]:
            try:
                return enc.encode(text, allowed_special="all")
            except ValueError:
                # The word pattern of the rank encoder gives up on runs of about a million
                # characters; the .json form of the vocabulary does not.
                return encoder(whole)(text)
        return encode
    if file.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=file).encode
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(file)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def cuttable(path: str) -> bool:
    """Safe cuts hold for byte-level vocabularies with the word pattern above."""
    return os.path.basename(path).removeprefix("public:").startswith("byte_bpe")


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut at safe places; a stretch
    without one stays whole.  ``"".join(pieces(t)) == t``."""
    at = 0
    while len(text) - at > limit:
        m = SAFE_CUT.search(text, at + limit - 1)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def ids(path: str, text: str) -> list[int]:
    enc = encoder(path)
    if len(text) <= PIECE_CHARS or not cuttable(path):
        return enc(text)
    out: list[int] = []
    for p in pieces(text):
        out += enc(p)
    return out


def length(path: str, text: str) -> int:
    enc = encoder(path)
    if len(text) <= PIECE_CHARS or not cuttable(path):
        return len(enc(text))
    return sum(len(enc(p)) for p in pieces(text))
