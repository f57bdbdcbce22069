"""Token ids of whole texts by the ``tokenizers`` library, fast on large corpora.

A byte-level BPE splits a text into pieces before it merges bytes, and no piece reaches
over certain places: before a blank that has no other white space beside it, before a
stop or comma that follows a letter or digit, and around a lone line end. A text is cut
at those places and its ids are those of the parts in order. Each part goes through the
library once per worker and is then kept, several times faster than encoding the text as
one string. Tokenizers of another make (a normalizer, another rule) get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

_AT_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: A stop or comma after anything but a letter or digit.
_LOOSE_STOP = re.compile(r"[.,](?<=[\W_].)", re.DOTALL)
#: White space other than blanks and line ends, and the mark that cuts use.
_OTHER_SPACE = re.compile("[\0\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _simple(text: str) -> bool:
    """Whether each blank, line end, stop and comma of ``text`` is a place to cut."""
    return not (text[0] in " \n.," or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _LOOSE_STOP.search(text) or _OTHER_SPACE.search(text))


_LOADED: dict[tuple[str, int, bool], "ChunkEncoder"] = {}


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    ``keep``: chunks that are kept in memory at most, in two generations. ``plain``: ids are
    those of a plain call of the library, in which an added token's name in a text is that
    token; without it the name is ordinary text.
    """

    def __init__(self, path: str, keep: int = 1_600_000, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not plain:
            self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        names = [t["content"] for t in made.get("added_tokens") or [] if plain or not t["special"]]
        self.named = re.compile("|".join(map(re.escape, names))) if names else None
        pre = made.get("pre_tokenizer") or {}
        self.by_chunk = (
            made["model"]["type"] == "BPE"
            and not made.get("normalizer")
            and not made["model"].get("dropout")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self.merges = self.tokenizer.model.tokenize
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.keep = keep // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = _byte_chars()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of ``part`` by itself, kept unless it is long."""
        if not part:
            return b""
        out = self.old.get(part)
        if out is None:
            core = part[1:] if part[0] == " " else part
            if core.isalpha() and max(core) < "ɐ":  # one piece: straight to the merges
                out = array("I", [t.id for t in self.merges(part.encode().decode("latin-1").translate(self.chars))]).tobytes()
            else:
                out = self._whole(part)
        if len(part) <= 64:
            if len(self.young) >= self.keep:
                self.old, self.young = self.young, {}
            self.young[part] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or (self.named and self.named.search(text)):
            return self._whole(text)
        if _simple(text):
            parts = text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").split("\0")
        else:
            parts = _AT_BLANK.split(text)
            parts[1:] = [" " + x for x in parts[1:]]
        got = list(map(self.young.get, parts))
        if None in got:
            for i, known in enumerate(got):
                if known is None:
                    got[i] = self._part(parts[i])
        return b"".join(got)


def encoder(path: str, keep: int = 1_600_000, plain: bool = True) -> ChunkEncoder:
    """The worker's own encoder; it and what it has kept serve all tasks of the worker."""
    if (path, keep, plain) not in _LOADED:
        _LOADED[path, keep, plain] = ChunkEncoder(path, keep, plain)
    return _LOADED[path, keep, plain]


def in_slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches of at most ``rows`` rows: what a worker holds at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)
