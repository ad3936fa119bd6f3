"""Token ids of whole texts of any length, equal to the library's, by overlap resynchronisation.

Texts above `chunk` characters are encoded in chunks that overlap, with the offset of every token. Two
neighbours are spliced at the first place of their overlap that both prove to be stable:

* both have a unit that begins there, so from there on both read the same units. Units are what no merge
  crosses: pre-tokens of a byte-level .json file; of a .model file, a space after a visible character, where no
  piece has a space inside. The first unit of the later chunk proves nothing, as it may be cut, nor do the last
  characters of the earlier one, as what follows may change how they are read;
* all tokens that both have from there to the end of what the earlier one proves are the same.

Where no place is proven, the overlap is doubled; where the whole chunk gives none, the chunk is.

Byte-level .json files whose merges are in id order (checked on loading) are encoded by tiktoken with the same
ranks; texts that hold a special string, and other files, by their own library. Other kinds of pre-tokens than
byte-level ones, and .model files that rewrite the text, are encoded whole.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex

#: The byte-level pre-tokens (a fixed value of that format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that a pre-token looks at from its start at least, to tell where it ends.
AHEAD = 3
SPACE = regex.compile(r"(?<=\S) (?=\S)")


def _byte_table() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """ids(text) -> bytes of little-endian unsigned 32-bit ids; count(text) -> int.

    sizes: the bytes that each id stands for, or None where chunks cannot be spliced; lead: bytes that the
    library puts before a text; spliced: overlaps widened and splices made so far.
    """

    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 256):
        self.chunk, self.overlap = chunk, overlap
        self.special, self.sizes, self.fast, self.lead, self.margin = [], None, None, 0, 1
        self.spliced = {"splices": 0, "widened": 0}
        if path.endswith(".model"):
            self._load_pieces(path)
        else:
            self._load_json(path)

    def _load_pieces(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.library = lambda text: sp.encode(text, num_threads=1)
        if not any("▁" in p.lstrip("▁") or " " in p for p in pieces):
            self.sizes = np.array([1 if sp.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)], np.int64)
            self.lead = 1

    def _load_json(self, path: str) -> None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.library = lambda text: own.encode(text, add_special_tokens=False).ids
        spec = json.loads(own.to_str())
        added = spec.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return
        vocab, back = model["vocab"], _byte_table()
        ranks = {bytes(back[c] for c in w): i for w, i in vocab.items() if w not in self.special}
        if not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            self.sizes = np.zeros(own.get_vocab_size(), np.int64)
            for w, i in [*ranks.items(), *((t["content"].encode(), t["id"]) for t in added)]:
                self.sizes[i] = len(w)
            self.margin = max([AHEAD, *map(len, self.special)])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if all(a < b for a, b in zip(made, made[1:])):
            import tiktoken

            self.fast = tiktoken.Encoding("same", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.split, self.named = regex.compile(PRE_TOKENS), regex.compile(names) if names else None

    def _encode(self, text: str) -> bytes:
        """The ids of a stretch that stands alone."""
        if self.fast is not None and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return np.array(self.library(text), "<u4").tobytes()

    def _units(self, text: str) -> list[int]:
        """Where units begin."""
        if self.lead:
            return [0, *(m.start() for m in SPACE.finditer(text))]
        out, at = [], 0
        for name in [*(self.named.finditer(text) if self.named else ()), None]:  # special strings part the text first
            end = name.start() if name else len(text)
            out += [at + m.start() for m in self.split.finditer(text[at:end])]
            if name:
                out.append(end)
                at = name.end()
        return out

    def _view(self, text: str, base: int) -> tuple[np.ndarray, dict[int, int]] | None:
        """(ids, {where a unit begins in the document: its first token}); None if the ids don't spell the text."""
        ids = np.frombuffer(self._encode(text), "<u4")
        offsets = np.r_[0, np.cumsum(self.sizes[ids])] - self.lead
        units = self._units(text)
        places = np.cumsum([0, *(len(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(units, units[1:]))])
        if offsets[-1] != len(text.encode("utf-8", "surrogatepass")):
            return None
        token = np.searchsorted(offsets, places)
        exact = offsets[np.minimum(token, len(ids))] == places
        return ids, {base + u: int(t) for u, t, ok in zip(units, token, exact) if ok}

    def _splice(self, left, right, end: int) -> tuple[int, int] | None:
        """The tokens (of the earlier chunk, of the later one) at the first place that both prove."""
        (a, at_a), (b, at_b) = left, right
        sure = [u for u in at_a if u <= end - self.margin]
        common = [u for u in list(at_b)[1:] if u in at_a and u <= end - self.margin]
        for u in common:
            same = a[at_a[u] : at_a[sure[-1]]]
            if np.array_equal(same, b[at_b[u] : at_b[u] + len(same)]):
                return at_a[u], at_b[u]
        return None

    def _long(self, text: str) -> bytes:
        out: list[bytes] = []
        at, size, first, n = 0, self.chunk, 0, len(text)
        here = self._view(text[:size], 0)
        while here is not None:
            end = at + size
            if end >= n:
                return b"".join([*out, here[0][first:].tobytes()])
            overlap, cut = self.overlap, None
            while cut is None and overlap < size:
                begin = end - overlap
                after = self._view(text[begin : begin + self.chunk + overlap], begin)
                if after is None:
                    return self._encode(text)
                cut = self._splice(here, after, end)
                if cut is not None and cut[0] <= first:
                    cut = None
                self.spliced["widened" if cut is None else "splices"] += 1
                overlap *= 2
            if cut is None:  # a longer chunk; what has been proven of it stays
                size *= 2
                here = self._view(text[at : at + size], at)
            else:
                out.append(here[0][first : cut[0]].tobytes())
                at, size, first, here = begin, end - begin + self.chunk, cut[1], after
        return self._encode(text)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= self.chunk or self.sizes is None:
            return self._encode(text)
        return self._long(text)

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4


_LOADED: dict[tuple, Encoder] = {}


def encoder(path: str, **options) -> Encoder:
    """One encoder for each worker process and file."""
    key = (path, *sorted(options.items()))
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, **options)
    return _LOADED[key]
