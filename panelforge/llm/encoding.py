"""Exact, fast ids for a byte-level BPE stored in a ``tokenizers`` JSON file."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Outside these code points the two libraries' Unicode tables may be of different ages, so such texts take the slow one.
_PLAIN = re.compile("[^\u0000-ɏͰ-ͷΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞€一-龥]")


def _bytes_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as ``tokenizers`` gives them for the file at ``path``, without added special tokens.

    A byte-level file whose ids follow its merge order is equally a rank file, which ``tiktoken`` encodes several times
    faster; that engine is used for texts of long-settled code points. All other files (other splitting, merges or added tokens that look at what
    surrounds them), and texts outside those, go through ``tokenizers`` itself. A special token's string inside a text is that token, the library's default.
    """

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task is Spark's deal
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._slow = Tokenizer.from_file(path)
        self._slow.no_truncation()
        self._slow.no_padding()
        self._fast = None
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        model, byte = spec["model"], _bytes_of()
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        before = spec.get("pre_tokenizer") or {}
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        plain = (
            model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in odd)
            and not spec.get("normalizer")
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
            and all(c in byte for k in vocab for c in k)
            and sorted(vocab[c] for c in byte if c in vocab) == list(range(256))
            and [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
        )
        if plain:
            ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
            self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, unsigned 32-bit."""
        if self._fast is not None and not _PLAIN.search(text):
            return self._fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    import public_tokenizers

    return Encoder(path, public_tokenizers.PATTERN)
