"""Ids of a byte-level BPE tokenizer file of the tokenizers library.

``ByteLevel.encode`` gives the ids that the tokenizers library gives for whole texts. Texts of Latin
characters (code points below U+0250, whose Unicode classes no two engines read differently) and
without an added token's string go through tiktoken's merge loop, built from the same file, which
takes a third of the time; all others, and files of any other kind, through the tokenizers library
itself. The two agree because the file's merges are in the order of their ids (checked
when the file is opened) and its pattern is the common one.
"""

from __future__ import annotations

import json
import re

import numpy as np

from siftwork.llm.slices import slices

_OTHER = re.compile("[^\x00-ɏ]")
# Fixed value: the pre-tokenizer's pattern for byte-level files with use_regex.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_AT_ONCE = 1 << 18  # characters


def _byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for
    the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """``plain``: strings of added tokens inside a text are ordinary text."""

    def __init__(self, source: bytes, plain: bool = False):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.plain = Tokenizer.from_buffer(source), plain
        self.tokenizer.encode_special_tokens = plain
        symbols, added = _byte_symbols(), self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: the bytes of each id; an added token's are its text
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, k in vocabulary.items():
            self.bytes[k] = piece.encode("utf-8") if k in added else bytes(symbols[c] for c in piece)
        self.fast = self._merge_loop(json.loads(source), added)

    def _merge_loop(self, file: dict, added: dict):
        """tiktoken's encoding of the same vocabulary, if the file is of the kind it can stand in for."""
        model, first = file["model"], file.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type", "BPE") != "BPE" or not plain or file.get("normalizer") or first.get("type") != "ByteLevel" or not first.get("use_regex") or first.get("add_prefix_space"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            return None
        import tiktoken
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks={self.bytes[k]: k for k in model["vocab"].values() if k not in added}, special_tokens={})

    def _is_fast(self, text: str) -> bool:
        return self.fast is not None and not _OTHER.search(text) and (self.plain or not any(a in text for a in self.added))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids (unsigned 32-bit)."""
        out: list = [None] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if self._is_fast(text):
                got = [self.fast.encode_to_numpy(s, disallowed_special=()) for s in slices(text, _AT_ONCE)]
                out[k] = got[0] if len(got) == 1 else np.concatenate(got)
            else:
                slow.append(k)
        if slow:
            cut = [slices(texts[k], _AT_ONCE) for k in slow]
            flat = iter([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([s for c in cut for s in c], add_special_tokens=False)])
            for k, c in zip(slow, cut, strict=True):
                out[k] = np.concatenate([next(flat) for _ in c])
        return out
