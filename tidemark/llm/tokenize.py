"""Byte-pair encoding of whole texts, with fragments encoded once per task: merges by a second BPE library (tiktoken) on the same
vocabulary, rare characters and special tokens by the tokenizers library; tests hold the ids against the latter.

Used by packing (counts and checksums of ids) and by ``bpe`` (ids and decoded texts).
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Most fragments that a task remembers. When full, the memory starts anew; results do not depend on it.
CACHE_ENTRIES = 400_000
#: The pre-tokenizer's pattern of this family of vocabularies (a fixed value).
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The word vocabulary's pattern, for text of the characters that UNSAFE leaves.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zª\xb5º\xdf-\xf6\xf8-\u024f]+|[0-9²³¹¼½¾]|[^\sa-zª\xb5º\xdf-\xf6\xf8-\u024f0-9²³¹¼½¾]+")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_ranks(vocab: dict[str, int], suffix: str = "", end: bytes = b"") -> dict[bytes, int]:
    """Token bytes -> id; ``end`` stands for an end-of-word suffix."""
    of = {c: b for b, c in byte_alphabet().items()}
    ranks = {}
    for token, i in vocab.items():
        ended = bool(suffix) and token.endswith(suffix)
        body = token.removesuffix(suffix) if ended else token
        if all(c in of for c in body):
            ranks[bytes(of[c] for c in body) + end * ended] = i
    return ranks


#: Characters whose Unicode classes have been the same in all versions; other texts take the library's own path.
UNSAFE = re.compile(r"[^\t\n\r -~\xa1-\u024f]")


class ByteLevelEncoder:
    """Ids of a byte-level BPE for whole texts.

    Texts are encoded by a second implementation of the same vocabulary, whose ids are the same (tested) and which is
    several times as fast; texts with special tokens or rare characters go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = tiktoken.Encoding("texts", pat_str=GPT2_PATTERN, mergeable_ranks=byte_ranks(spec["model"]["vocab"]), special_tokens={})

    def encode(self, texts: list[str]) -> list:
        """A uint32 array of ids for each text."""
        import numpy as np

        fast, special, out = self.fast.encode_to_numpy, self.special, []
        for t in texts:
            if UNSAFE.search(t) or any(s in t for s in special):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"))
            else:
                out.append(fast(t, disallowed_special=()).astype("<u4", copy=False))
        return out


@lru_cache(2)
def byte_level(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


END, CUT = "\x01", "\x02"


class ForcedBoundaryEncoder:
    """Encode and decode with a word BPE by cutting where no vocabulary token can reach across.

    A pair of bytes that stands inside no token of the vocabulary is a certain cut: no merge can span it, so both sides
    can be encoded on their own and their ids concatenated. White space stands inside no token, so every text is cut
    there; fragments not met before are also cut at word ends and at the other such pairs. The last fragment of a word
    carries the end-of-word suffix (here the byte END), those before it do not. Fragments with special tokens or rare characters go to
    the library whole.
    """

    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        self.tokenizer = load(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if not suffix or any(c.isspace() for t in self.special for c in t):
            raise ValueError("only vocabularies with an end-of-word suffix and special tokens without white space are supported")
        if spec.get("decoder") is not None:
            raise ValueError("only vocabularies whose decoder joins tokens by spaces are supported")
        ranks = byte_ranks(vocab, suffix, END.encode())
        self.encode_all = tiktoken.Encoding("fragments", pat_str=f"[^{END}{CUT}]+{END}?|{CUT}", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        n = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.ends, self.cut_id = np.zeros(n, bool), vocab[byte_alphabet()[ord(CUT)]]
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.token = [b""] * n
        for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.token[i] = t.encode()
        self.joined = np.zeros((256, 256), bool)
        for t in ranks:
            for x, y in zip(t, t[1:]):
                self.joined[x, y] = True
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def mark_cuts(self, words: list[str]) -> str:
        """The words, each followed by END, with CUT between characters whose bytes stand together in no token."""
        import numpy as np

        raw = np.frombuffer((END.join(words) + END).encode(), np.uint8)
        forced = ~self.joined[raw[:-1], raw[1:]] & (raw[1:] & 0xC0 != 0x80) & (raw[1:] != ord(END)) & (raw[:-1] != ord(END))
        return np.insert(raw, np.flatnonzero(forced) + 1, ord(CUT)).tobytes().decode()

    def learn(self, fragments: list[str]) -> None:
        import numpy as np

        easy, words, counts = [], [], []
        for f in fragments:
            low = f.lower()
            if UNSAFE.search(f) or UNSAFE.search(low) or any(s in f for s in self.special):
                e = self.tokenizer.encode(f, add_special_tokens=False)
                self._keep(f, e.ids)
            else:
                found = WORDS.findall(low)
                easy.append(f)
                words += found
                counts.append(len(found))
        if not words:
            self.known.update(dict.fromkeys(easy, (b"", b"")))
            return
        ids = self.encode_all(self.mark_cuts(words), disallowed_special=())
        ids = ids[ids != self.cut_id]
        ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        assert len(ends) == len(words) + 1
        at, ids = ends[np.append(0, np.cumsum(counts))].tolist(), ids.tolist()
        for f, i, j in zip(easy, at, at[1:]):
            self._keep(f, ids[i:j])

    def _keep(self, fragment: str, ids: list[int]) -> None:
        self.known[fragment] = (array("I", ids).tobytes(), b" ".join([self.token[i] for i in ids]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian uint32 bytes, and the decoded text in UTF-8."""
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new: set[str] = set()
        for ws in split:
            new.update(ws)
        new -= known.keys()
        if new:
            self.learn(list(new))
        out = []
        for ws in split:
            got = [known[w] for w in ws]
            out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])))
        return out


@lru_cache(2)
def forced_boundary(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)
