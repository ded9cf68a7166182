"""Token ids of a byte-level BPE file as the ``tokenizers`` library gives them.

``tiktoken`` runs the same merges four times as fast: it gets the file's own
vocabulary, in the order of the merges. The two split words by the same pattern
but with Unicode tables of their own, so it is used for texts of characters
whose classes are long settled (``SETTLED``, compared one by one in the tests);
a text with any other character goes to ``tokenizers`` as a whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The word pattern of byte-level BPE files (fixed values).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SETTLED = ("\x00-ɏΑ-ΡΣ-ώЀ-ҁҊ-ӿא-תء-ي‐-‧€▁"
           "、-〃ぁ-ゖァ-ヺ一-龥가-힣！，：；？")
_OTHER = re.compile(f"[^{SETTLED}]")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    ones for themselves, the others in order from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """``ids(text)`` without special tokens around it. ``plain``: the strings of
    special tokens inside a text are ordinary text too."""

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        pre, model = parts.get("pre_tokenizer") or {}, parts["model"]
        if (parts.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or model.get("type") != "BPE"):
            raise ValueError(f"{path}: not a byte-level BPE without normalizer and prefix space")
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in parts.get("added_tokens", ())}
        #: bytes of each token
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in added}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        order = [model["vocab"]["".join(p)] for p in pairs]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.special = None if plain or not added else re.compile("|".join(map(re.escape, added)))
        self.fast = None
        if order == sorted(order) and len(self.bytes) == 256 + len(order):  # ids are ranks
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={}, mergeable_ranks={b: i for i, b in self.bytes.items()})

    def ids(self, text: str) -> np.ndarray:
        """Token ids of the whole text, unsigned 32-bit."""
        if self.fast is None or _OTHER.search(text) or (self.special and self.special.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())
