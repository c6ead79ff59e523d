"""Token ids of whole texts, the same ids as the `tokenizers` file gives.

The file's vocabulary is run by the `tiktoken` engine, which needs about a
fifth of the CPU time. Texts where the two engines could differ - those that
hold a special token's string, or a character beyond Latin Extended-B, where
character classes depend on the Unicode version - go through `tokenizers`, and
so do all texts where the file is anything but plain byte-level BPE.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Fixed value: the split pattern of byte-level BPE as the vocabulary uses it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 16
_FAR = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85]")
#: A blank between two other characters: a token never goes across its left side.
_SEAM = re.compile(r"(?<=[^\s])(?= [^\s])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def simple(said: dict) -> bool:
    """Whether a tokenizer file is what the fast engine runs: byte-level BPE
    that splits by PATTERN, adds nothing, and merges in the order of its ids."""
    model, split = said["model"], said.get("pre_tokenizer") or {}
    if said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback"):
        return False
    own = {t["content"] for t in said.get("added_tokens", [])}
    if not set("".join(t for t in model["vocab"] if t not in own)) <= set(_byte_letters()):
        return False
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return len(made) + 256 == len(set(model["vocab"]) - own) and all(a < b for a, b in zip(made, made[1:]))


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.full = tokenizers.Tokenizer.from_file(path)
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.fast = None
        if simple(said):
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids of one text, no special tokens added."""
        if self.fast is None or _FAR.search(text) or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= CHUNK:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        parts, at = [], 0
        while at < len(text):
            seam = _SEAM.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            end = seam.start() if seam else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[at:end]), "<u4"))
            at = end
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
