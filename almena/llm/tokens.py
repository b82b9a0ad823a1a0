"""Token counts by a public byte-level tokenizer, and a store that lives as long as a Python worker."""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Callable

#: Vocabulary file (base64 token, space, rank per line); any file of that form may be given.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the memo of piece lengths, after which it starts anew: bounds memory, not results.
MEMO = 400_000
# Fixed value: the characters that the split pattern takes as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def worker_store() -> dict:
    """A dictionary shared by all tasks of one Python worker process."""
    name = "_almena_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].data = {}
    return sys.modules[name].data


def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class _Memo(dict):
    """Token count of a piece of text with a leading blank."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = len(self.encode(" " + piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


def token_counter(path: str = TOKENIZER) -> Callable[[str], int]:
    """Exact token counts of whole texts.

    No token spans the place where a blank follows a visible character and precedes
    another, so a text is counted piece by piece there and the counts of pieces are kept.
    """
    store = worker_store()
    if ("counter", path) not in store:
        encode = load_encoding(path).encode_ordinary
        memo = _Memo(encode)
        beside = re.compile(f" [{WHITE}]|[{WHITE}] ")
        whole = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

        def count(text: str) -> int:
            if beside.search(text):
                return sum(memo[p[1:]] if p[0] == " " and len(p) > 1 else len(encode(p)) for p in whole.findall(text))
            first, *rest = text.split(" ")
            if rest and not first:
                return len(encode(text)) if len(rest) == 1 and not rest[0] else sum(map(memo.__getitem__, rest))
            tail = 1 if rest and not rest[-1] else 0
            if tail:
                rest.pop()
            return (len(encode(first)) if first else 0) + sum(map(memo.__getitem__, rest)) + (len(encode(" ")) if tail else 0)

        store["counter", path] = count
    return store["counter", path]
