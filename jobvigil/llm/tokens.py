"""Token ids of texts, by the tokenizers library, within tasks.

Most of a text is words seen before. Both vocabularies used here cut a text at fixed
boundaries before they merge anything, so the ids of a text are those of its pieces in
a row. Each worker keeps the ids of pieces it met and asks the library only for new
ones. The cutting is done here only for characters whose class is beyond doubt (Latin
letters, general punctuation); any other text goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

#: A worker keeps the ids of so many pieces, and as many that it met before those: about 150 MB for each half.
KEPT_PIECES = 700_000

_EDGE = chr(0x24F)  # the end of the Latin letters taken here
_S = r"\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_L = rf"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-{_EDGE}"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Fixed: how the byte-level vocabulary cuts a text, and the one with word ends (which lower-cases before it cuts).
_BYTE_LEVEL = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_WORD_ENDS = re.compile(f"'[sStTmMdD]|'[rRvV][eE]|'[lL][lL]|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: The letter whose lower case is two characters is left out.
_PLAIN = re.compile(rf"[\x00-{chr(0x12F)}{chr(0x131)}-{_EDGE}{chr(0x2000)}-{chr(0x206F)}]*")


def _cutter(tokenizer_file: str) -> re.Pattern | None:
    import json

    with open(tokenizer_file, encoding="utf-8") as file:
        about = json.load(file)
    normal, before = about.get("normalizer"), about.get("pre_tokenizer") or {}
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return _BYTE_LEVEL
    steps = [n.get("type") for n in (normal or {}).get("normalizers", [])]
    cuts = [p.get("pattern", {}).get("Regex") for p in before.get("pretokenizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and cuts[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]:
        return _WORD_ENDS
    return None


@lru_cache(maxsize=4)
def encoder(tokenizer_file: str, kept_pieces: int = KEPT_PIECES) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, each as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = True
    cut = _cutter(tokenizer_file)
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def ask(texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(pieces: set[str]) -> None:
        nonlocal known, older
        new = pieces.difference(known)
        if len(known) + len(new) > kept_pieces:  # what is in use moves over from the older half, the rest goes
            known, older = {}, known
            new = pieces
        known.update((p, older[p]) for p in new if p in older)
        unknown = [p for p in new if p not in older]
        known.update(zip(unknown, ask(unknown), strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):  # a few texts at a time, by length
            to, size = at, 0
            while to < len(texts) and size < 1_000_000:
                size, to = size + len(texts[to]), to + 1
            cuts = [cut.findall(t) if cut is not None and _PLAIN.fullmatch(t) else None for t in texts[at:to]]
            learn(set().union(*(c for c in cuts if c)))
            out += [ask([t])[0] if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts[at:to], cuts, strict=True)]
            at = to
        return out

    return encode
