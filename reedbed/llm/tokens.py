"""Token ids of whole texts with a public word-end BPE vocabulary.

The tokenizer lower-cases a text, drops white space, and encodes runs of letters, single digits, runs of signs and a few
contractions one by one. Texts of Latin-1 characters are split the same way here and each part's ids are looked up in a
table that each worker keeps (a cache: emptied when large); new parts are encoded many at a time and divided at the
ends of words. Any other text is split at spaces and line ends only and its chunks go to the tokenizer as they are.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .words import held

#: White space that separates chunks here; other white space is left to the tokenizer.
CHUNK = re.compile(r"[^ \n\t\r]+")
#: The vocabulary's parts of a text, for lower-cased Latin-1 characters.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Characters that PART holds for: printable Latin-1 and plain white space, without the no-break space.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
LIMIT = 400_000
ID = np.dtype("<u4")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=ID).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str], block: int = 400) -> None:
        for at in range(0, len(parts), block):
            own = parts[at : at + block]
            data = self._ids([" ".join(own)])[0]
            ends = np.flatnonzero(self.ends[np.frombuffer(data, dtype=ID)]) + 1
            if len(ends) == len(own):
                last = 0
                for part, end in zip(own, (ends * 4).tolist(), strict=True):
                    self.parts[part] = data[last:end]
                    last = end
            else:
                self.parts.update(zip(own, self._ids(own), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        split, odd = [], []
        for t in texts:
            if not t:
                split.append([])
            elif plain(t):
                split.append(PART.findall(t.lower()))
            else:
                odd.append(len(split))
                split.append(())
        if len(self.parts) > LIMIT:
            self.parts.clear()
        seen: set[str] = set()
        seen.update(*split)
        self._learn(list(seen.difference(self.parts)))
        out = [b"".join(map(self.parts.__getitem__, parts)) for parts in split]
        for at in odd:
            out[at] = b"".join(self._ids(CHUNK.findall(texts[at])))
        return out


def plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return held(("encoder", path), lambda: Encoder(path))


def some(items: list, size: int):
    for at in range(0, len(items), size):
        yield items[at : at + size]
