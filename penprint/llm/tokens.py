"""Encoding whole texts with a tokenizer file, remembering the ids of words seen before."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

IDS = np.dtype("<u4")
REMEMBERED = 150_000  # words whose ids a worker keeps, about 50 MB; others are encoded each time
LONGEST = 40

#: A run of these characters up to a blank is cut into the same pieces by any text around it: ASCII but for
#: the apostrophe, which joins contractions, and the less-than sign, which opens special tokens, and Latin-1 letters.
PLAIN = re.compile(r"[\n\t\r!-&(-;=-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


# How the known kind of tokenizer normalises and cuts a text, in the words of its file.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def cuts_at_blanks(tokenizer: Tokenizer) -> bool:
    """Whether no token of a tokenizer spans a blank, and pieces of a text may be encoded one by one."""
    told = json.loads(tokenizer.to_str())
    added = [t["content"] for t in told["added_tokens"]]
    return (
        (told["normalizer"] or {}).get("normalizers") == NORMALIZERS and (told["pre_tokenizer"] or {}).get("pretokenizers") == [CUT, BYTES]
        and told["model"]["type"] == "BPE" and told["model"]["end_of_word_suffix"] == "</w>" and not told["model"]["dropout"]
        and all(content.startswith("<") and not re.search(r"\s", content) for content in added)
    )


class WordEncoder:
    """Ids of texts under a lower-casing word tokenizer whose tokens do not span blanks.

    The text is cut at blanks, which no token, special token or normalisation rule of such a tokenizer crosses. A part is looked up among those
    seen before; plain parts are cut on into runs of letters, digits and signs, the units that the
    tokenizer itself works on. What is not known yet goes through the tokenizer. A tokenizer of any other kind, by what its
    file says of normalisation and cutting, encodes whole texts at once.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.split = cuts_at_blanks(self.tokenizer)
        self.parts: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        # The model works on characters that stand for UTF-8 bytes.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {c: spell(chr(c))[0][0] for c in [*range(33, 127), *range(0xC0, 0x100)]}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, IDS).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = np.array([t.id for t in self.tokenizer.model.tokenize(piece.translate(self.spelled))], IDS).tobytes()
            if len(self.pieces) < REMEMBERED and len(piece) < LONGEST:
                self.pieces[piece] = found
        return found

    def _part(self, part: str) -> bytes:
        if PLAIN.fullmatch(part):
            found = b"".join([self._piece(p) for p in PIECE.findall(part.lower())])
        else:
            found = self._direct(part)
        if len(self.parts) < REMEMBERED and len(part) < LONGEST:
            self.parts[part] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; a null text has none."""
        if not text:
            return b""
        if not self.split:
            return self._direct(text)
        words = text.split(" ")
        found = list(map(self.parts.get, words))
        if None in found:
            found = [self._part(w) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker and file; it outlives a task."""
    return WordEncoder(path)


def encoded(path: str, texts: Iterable[str | None]) -> list[bytes]:
    encoder = word_encoder(path)
    return [encoder.encode(t) for t in texts]
