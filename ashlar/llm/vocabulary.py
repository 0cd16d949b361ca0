"""A public byte-level BPE vocabulary by the path of its file; loaded once per process."""

from __future__ import annotations

import functools
import json
import os

#: The default place of the vocabulary file; every operator takes another as a parameter.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"

#: White space as the tokenizer sees it, and the split before the merges, in the JVM's dialect.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: A code point that the JVM's Unicode version doesn't know may be a letter to the tokenizer's.
UNKNOWN = r"\p{Cn}"


@functools.lru_cache(maxsize=4)
def whole_words(path: str):
    """The tokenizer without its split: each text is one word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return t


@functools.lru_cache(maxsize=1)
def splitter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def split(text: str) -> list[str]:
    """The words of a text by the tokenizer's own rules."""
    return [text[a:b] for _, (a, b) in splitter().pre_tokenize_str(text)]


def pieces(path: str) -> list[tuple[int, bytes]]:
    """The id and bytes of every piece."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    # the printable stand-ins of the bytes: those that print stand for themselves, the others follow from 256 on
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = data["model"]["vocab"] | {t["content"]: t["id"] for t in data["added_tokens"]}
    special = {t["id"] for t in data["added_tokens"]}
    return [(i, p.encode() if i in special else bytes(byte[c] for c in p)) for p, i in vocab.items()]
