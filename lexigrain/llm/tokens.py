"""Exact tokenizer ids at dictionary-lookup cost.

A pre-tokenizer that always breaks at white space makes the ids of a text the
concatenation of the ids of its space-delimited pieces.  :class:`Encoder` remembers the
ids of pieces, sends only new pieces to the tokenizer, and takes the plain way for every
text in which that identity is not certain (rare white space, text that looks like a
special token, or a tokenizer of another kind).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: White space other than blank and newline, C0 separators, and starts of special tokens.
_UNUSUAL = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]|<\\|")
#: Pieces for pre-tokenizers that keep one leading blank with the word.
_LEADING = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
#: Remembered pieces before the memory is emptied.
_MEMORY = 1_200_000


class Encoder:
    """``encode(texts)`` gives, for each text, its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.memory: dict[str, bytes] = {}
        self.kind = self._kind(spec)
        self.separator, self.mark = {"dropped": (" | ", "|"), "leading": ("\n", "\n")}.get(self.kind, ("", ""))
        if self.kind != "plain":
            ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
            self.kind, self.mark_id = (self.kind, ids[0]) if len(ids) == 1 else ("plain", -1)

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"].get("type") != "BPE" or any(a["lstrip"] or a["rstrip"] or not a["content"].startswith("<|") for a in spec["added_tokens"]):
            return "plain"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "leading"
        steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s\\p{L}\\p{N}]+" in first["pattern"].get("Regex", "")
        return "dropped" if steps == ["NFC", "Replace", "Lowercase"] and drops else "plain"

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        odd = [w for w in new if w.isspace() or self.mark in w]
        if odd:
            self.memory.update(zip(odd, self._plain(odd)))
            skip = set(odd)
            new = [w for w in new if w not in skip]
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        for i in range(0, len(groups), 32):
            part = groups[i : i + 32]
            for group, e in zip(part, self.tokenizer.encode_batch_fast([self.separator.join(g) for g in part], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.mark_id)
                raw = ids.tobytes()
                starts, ends = [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(raw)]
                self.memory.update((w, raw[a:b]) for w, a, b in zip(group, starts, ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        usual = [] if self.kind == "plain" else [i for i, t in enumerate(texts) if not _UNUSUAL.search(t)]
        done = set(usual)
        rest = [i for i in range(len(texts)) if i not in done]
        for i, b in zip(rest, self._plain([texts[i] for i in rest])):
            out[i] = b
        split = str.split if self.kind == "dropped" else _LEADING.findall
        at, size, group = 0, 0, []
        while at < len(usual):  # by a few megabytes, so that a batch of long texts stays small
            group, size = [], 0
            while at < len(usual) and size < 4 << 20:
                group.append((usual[at], split(texts[usual[at]])))
                size += len(texts[usual[at]])
                at += 1
            if len(self.memory) > _MEMORY:
                self.memory.clear()
            missed = []
            for i, ws in group:
                try:
                    out[i] = b"".join(map(self.memory.__getitem__, ws))
                except KeyError:
                    missed.append((i, ws))
            if missed:
                self._learn(list(set().union(*(w for _, w in missed)).difference(self.memory)))
                for i, ws in missed:
                    out[i] = b"".join(map(self.memory.__getitem__, ws))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
