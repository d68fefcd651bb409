"""Words of a byte-level BPE tokenizer's pre-tokenizer, and their ids.

The splitter finds the same words as the tokenizer's own pre-tokenizer: a regular expression over letter,
number and space classes for texts whose characters have kept their class since an early Unicode version,
and the pre-tokenizer itself for any other text. Strings of added tokens are words of their own. A text of the
first kind without added tokens can be split and merged in one call, by the same expression.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cache, cached_property

#: Longer words are merged by the tokenizer itself, whose time does not grow with their square.
LONG_WORD = 200
#: Longer texts are encoded word by word, as tiktoken's splitter gives up on a million spaces in a row.
LONG_TEXT = 500_000
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranges(test) -> str:
    """A regular-expression class body of the code points that pass the test."""
    out, start = [], None
    for c in range(0x110000):
        inside = not 0xD800 <= c < 0xE000 and test(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out) + (f"\\U{start:08x}-\\U0010ffff" if start is not None else "")


@cache
def classes() -> tuple[str, str, str]:
    """Class bodies of letters, numbers and spaces."""
    return _ranges(lambda c: unicodedata.category(c)[0] == "L"), _ranges(lambda c: unicodedata.category(c)[0] == "N"), SPACES


def _rust(body: str) -> str:
    """A class body with all that is not a range's hyphen as \\x{...}, for Rust's regular expressions."""
    return re.sub(r"\\U([0-9a-f]{8})|[^-]", lambda m: "\\x{%s}" % (m[1] or "%x" % ord(m[0])), body)


@cache
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """For ASCII texts, for all others, and for characters that the second can't be trusted with."""
    old = unicodedata.ucd_3_2_0.category
    letter, number, _ = classes()
    spaces = SPACES.replace("-", "") + "".join(map(chr, range(0x2000, 0x200B)))
    doubtful = _ranges(lambda c: old(c)[0] != unicodedata.category(c)[0] or old(c) == "Cn" or (c.isspace() and c not in spaces and c > chr(31)))
    form = "'(?:s|t|re|ve|m|ll|d)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
    return (
        re.compile(form.format(L="A-Za-z", N="0-9", S=SPACES[:6])),
        re.compile(form.format(L=letter, N=number, S=SPACES)),
        re.compile(f"[{doubtful}]"),
    )


@cache
def _suspects() -> re.Pattern:
    """For the third of `patterns` and all characters beyond the first 65,536; it is searched several times as fast."""
    ranges = re.findall(r"\\U.{8}-\\U.{8}", patterns()[2].pattern)
    return re.compile("[" + "".join(r for r in ranges if r < r"\U00010000") + r"\U00010000-\U0010ffff]")


def trusted(text: str) -> bool:
    """Whether the patterns find the tokenizer's words."""
    return text.isascii() or _suspects().search(text) is None or patterns()[2].search(text) is None


class Splitter:
    """Cuts texts to words; the tokenizer is that of a vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def marked(self, text: str) -> bool:
        """Whether text has added tokens."""
        return self.cut is not None and any(s in text for s in self.special)

    def words(self, text: str) -> list[str]:
        if self.marked(text):
            return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        plain, wide, doubtful = patterns()
        if text.isascii():
            return plain.findall(text)
        if doubtful.search(text) is None:
            return wide.findall(text)
        return [text[a:b] for _, (a, b) in _merged(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))]

    def whole(self, text: str) -> list[int] | None:
        """Ids of a text that is split and merged in one call, if that is sure to give the tokenizer's; else None."""
        if self._ranked is None or len(text) > LONG_TEXT or self.marked(text) or not trusted(text):
            return None
        return self._texts(text)

    @cached_property
    def _texts(self):
        """Encodes texts by the second of `patterns`, its frequent kinds of words first (words of letters or
        numbers begin like no other kind), written so that those never backtrack."""
        import tiktoken

        letter, number, space = (_rust(c) for c in classes())
        form = " ?[{L}]++| ?[{N}]++|'(?:s|t|re|ve|m|ll|d)| ?[^{S}{L}{N}]++|[{S}]+(?![^{S}])|[{S}]+"
        return tiktoken.Encoding("texts", pat_str=form.format(L=letter, N=number, S=space), mergeable_ranks=self._ranked._mergeable_ranks, special_tokens={}).encode_ordinary

    @cached_property
    def _ranked(self):
        """The same vocabulary for merging by rank, if every id is the rank of its merge; else None. It is
        several times as fast for single words, with the same ids."""
        import tiktoken

        vocab = {p: i for i, p in enumerate(piece_bytes(self.path)) if i not in self.special.values()}
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len(vocab) != 256 + len(merges) or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        return tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=vocab, special_tokens={})

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        if self._ranked is not None:
            merge = self._ranked.encode_ordinary
            long = lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
            return [[self.special[w]] if w in self.special else merge(w) if len(w) <= LONG_WORD else long(w) for w in words]
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in batch(words, add_special_tokens=False)]


def _merged(pieces: list) -> list:
    return [(w, (a, b)) for w, (a, b) in pieces if b > a]


class _Known(dict):
    """Words to the bytes of their ids; a missing word is encoded."""

    def __init__(self, splitter: Splitter):
        self.splitter = splitter

    def __missing__(self, word: str) -> bytes:
        out = self[word] = array("I", self.splitter.encode([word])[0]).tobytes()
        return out


class CachedEncoder:
    """Bytes of the little-endian ids of texts, whole if possible; else each word is encoded once while it is
    remembered. The memory is emptied when it holds `limit` words, which changes no result."""

    def __init__(self, path: str, limit: int = 400_000):
        self.splitter, self.limit = Splitter(path), limit
        self.known = _Known(self.splitter)

    def ids(self, text: str) -> bytes:
        whole = self.splitter.whole(text)
        if whole is not None:
            return array("I", whole).tobytes()
        if len(self.known) > self.limit:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.splitter.words(text)))


@cache
def piece_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes that each id stands for: the id-to-piece table, as large as the vocabulary."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    size = 1 + max([*data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"])])
    table = [b""] * size
    for piece, i in data["model"]["vocab"].items():
        table[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
    for t in data["added_tokens"]:
        table[t["id"]] = t["content"].encode()
    return tuple(table)
