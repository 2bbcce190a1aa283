"""Token ids of a byte-level BPE tokenizer file; merges by rank where the file's ids are in the order of its merges."""

from __future__ import annotations

import json
import os
from array import array
from functools import cached_property
from itertools import pairwise

_loaded: dict[str, "ByteBpe"] = {}


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids by the file at ``path``, with special tokens in texts taken as the file's tokenizer takes them."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = self._ranked(spec) if plain else None

    @cached_property
    def exact(self):
        """The file's own tokenizer, loaded when a text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranked(self, spec: dict):
        """The same merges by rank, four times as fast; None unless ids are in the order of merges."""
        import tiktoken
        from public_tokenizers import PATTERN

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        order = [vocab["".join(p)] for p in pairs]
        if any(b <= a for a, b in pairwise(order)) or (order and order[0] < 256):
            return None
        of = byte_of_char()
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token)}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(vocab) else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; texts that hold a special token go to the file's own tokenizer."""
        if self.fast and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()


def load(path: str) -> ByteBpe:
    """The tokenizer at ``path``, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
