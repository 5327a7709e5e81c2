"""Exact, cached encoding with a byte-pair tokenizer whose words end in `</w>`; any other tokenizer gets whole texts.

White space separates words before anything else, so a text's ids are the ids of its words in order. Each
distinct word is encoded once per worker and kept in a bounded cache. A word of plain Latin letters, digits and
ASCII signs takes a short way through tiktoken's merge loop over the same vocabulary (an id is the rank of its
merge, and each merge is the pair that the loop itself would reach, which `_ranks` proves for the whole
vocabulary); every other word goes through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACE_RUN = re.compile(f"[{SPACES}]+")
_ODD = re.compile("[\x1c-\x1f]")  # space for str.split, not for the tokenizer
# The pattern of the vocabulary file, for lower-case text below U+0180 (checked against the file when loading).
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = b"\xff"  # stands for </w>: no UTF-8 text holds this byte


def split_words(text: str) -> list[str]:
    if _ODD.search(text):
        return [w for w in _SPACE_RUN.split(text) if w]
    return text.split()


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks for tiktoken, or None if this file isn't of the kind for which they give the same ids."""
    model, chars = spec["model"], _byte_chars()
    try:
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    except (KeyError, TypeError):
        return None
    if pattern != FILE_PATTERN or kinds != ["NFC", "Replace", "Lowercase"] or model.get("end_of_word_suffix") != "</w>":
        return None

    def raw(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(chars[c] for c in (token[:-4] if end else token)) + _END * end

    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(ranks) != 512 + len(merges) or any(model["vocab"][a + b] != 512 + i for i, (a, b) in enumerate(merges)):
        return None
    return ranks


def improper_merges(path: str) -> int:
    """Merges whose pair is not the one that merging by rank alone reaches; 0 proves that both ways agree."""
    spec = json.load(open(path))
    ranks, bad = _ranks(spec), 0
    chars = _byte_chars()
    for i, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        end = b.endswith("</w>")
        body = bytes(chars[c] for c in a + (b[:-4] if end else b))
        parts = [body[k : k + 1] for k in range(len(body))]
        if end:
            parts[-1] += _END
        while len(parts) > 2:
            got = [(ranks.get(x + y, 1 << 30), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, k = min(got)
            if rank >= 512 + i:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        left = bytes(chars[c] for c in a)
        bad += len(parts) != 2 or parts[0] != left
    return bad


_PLAIN = "\t-\r\x20-\x7e\x85\xa0-\xac\xae-įĲ-ňŊ-ž"  # NFC as it is; lower case is a matter of single characters
_CLOSE_SIGNS = re.compile(r"[^\w\s]{2}")


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes or, with strings, (count, decimal ids joined by
    spaces, tokens joined by spaces). `words(text)` gives the words to look up, in order."""

    def __init__(self, path: str | None = None, max_words: int = 400_000, strings: bool = False) -> None:
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        assert sys.byteorder == "little" and array("I").itemsize == 4
        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.max_words, self.strings = max_words, strings
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = {i: t for t, i in vocab.items()}
        ranks = _ranks(json.load(open(path)))
        self.core = None
        if ranks:
            core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.core = core.encode_single_piece
            self.plain = re.compile(f"[{_PLAIN}]*").fullmatch
            self.pieces = regex.compile(FILE_PATTERN).findall

    def words(self, text: str) -> list[str]:
        if not self.core:  # white space need not be a boundary
            return [text] if text else []
        if self.plain(text) and "<|" not in text:
            text = text.lower()
            if "_" not in text and not _CLOSE_SIGNS.search(text):  # then each stop or comma is a piece of its own
                text = text.replace(".", " . ").replace(",", " , ")
        return split_words(text)

    def ids(self, word: str) -> list[int]:
        if self.core:
            if word.isascii() and word.isalpha():
                return self.core(word.lower().encode() + _END)
            if self.plain(word) and "<|" not in word:
                core = self.core
                return [i for p in self.pieces(word.lower()) for i in core(p.encode() + _END)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: str):
        ids = self.ids(word)
        if self.strings:
            names = self.tokens
            value = (len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids]))
        else:
            value = array("I", ids).tobytes()
        if len(word) <= 64:  # longer ones seldom come again
            if len(self) >= self.max_words:
                self.clear()
            self[word] = value
        return value

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text)))
