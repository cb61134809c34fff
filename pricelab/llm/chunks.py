"""Tokens of many chunks of text at once, by public tokenizer files (helper of operators 12 and 13).

A text is cut before every space that follows a character other than white
space.  Neither the pattern of a byte-level tokenizer nor a piece of a
SentencePiece model reaches over such a cut, so a text's tokens are those of
its chunks, and each distinct chunk is tokenised once for each worker and
generation of its memory.  New chunks are tokenised in blocks: a block's chunks
stand one after another in one string, and byte lengths cut its tokens again.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

SPACE = "▁"
_INNER_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Characters up to here (Latin) have settled Unicode classes; others go to the file's own library.
LATIN = "ɏ"
#: Chunks longer than this go to the file's own library, whose merges are never quadratic.
LONG_CHUNK = 5000
#: Characters of new chunks that are tokenised as one string.
BLOCK = 20_000


def cut(text: str) -> list[str]:
    """Chunks of a text.  The first is given whole; every other one stands behind a space that is left off."""
    if _INNER_RUN.search(text) is None:
        return text.split(" ")
    first, *rest = _CUT.split(text)
    return [first, *(c[1:] for c in rest)]


def blocks(chunks: list[str], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of ``chunks`` of about ``size`` characters each whose chunks may stand one after
    another: each but the first begins with a space, each but the last ends without white space."""
    i, n, end = 0, 0, ""
    for j, c in enumerate(chunks):
        if j > i and (n >= size or c[:1] != " " or end.isspace()):
            yield i, j
            i, n = j, 0
        n += len(c)
        end = c[-1:]
    if i < len(chunks):
        yield i, len(chunks)


def byte_lengths(chunks: list[str]) -> np.ndarray:
    return np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks))


def byte_alphabet() -> dict[str, int]:
    """Byte-level alphabet: the character that stands for each byte.  Printable Latin-1
    bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class ByteTokens:
    """Ids of chunks by a byte-level BPE file (.json), special strings being plain text.

    A file whose ids follow its merges, as is usual, is also read as a rank
    table, whose merges are faster; both give the same ids (tested).
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.added = [t["content"] for t in spec["added_tokens"]]
        model, alphabet = spec["model"], byte_alphabet()
        self.n_ids = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.token = [b""] * self.n_ids
        for t, i in model["vocab"].items():
            self.token[i] = bytes(alphabet[c] for c in t)
        self.width = np.array([len(t) for t in self.token], np.int64)
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merged))
        cutter = spec["pre_tokenizer"] or {}
        plain = (in_order and spec["normalizer"] is None and cutter.get("type") == "ByteLevel"
                 and cutter.get("use_regex") and not cutter.get("add_prefix_space")
                 and len(model["vocab"]) == 256 + len(merged) and not model.get("ignore_merges"))
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                       mergeable_ranks={self.token[i]: i for i in model["vocab"].values()}) if plain else None

    def _block(self, chunks: list[str]) -> list[int]:
        text = "".join(chunks)
        if self.ranks is not None and max(text, default="") <= LATIN and max(map(len, chunks)) <= LONG_CHUNK:
            return self.ranks.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and each chunk's number of them."""
        ids = [np.array(self._block(chunks[i:j]), np.int64) for i, j in blocks(chunks)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        ends = np.cumsum(self.width[ids])
        last = np.searchsorted(ends, np.cumsum(byte_lengths(chunks)), side="right")
        return ids, np.diff(last, prepend=0)


class PieceTokens:
    """Ids of chunks, each beginning with a space, by a SentencePiece file (.model)."""

    LEAD = "a"

    def __init__(self, path: str):
        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if m.normalize(" A  Å ") != SPACE * 2 + "A" + SPACE * 2 + "Å" + SPACE:
            raise ValueError("this model changes the text or adds no leading space mark")
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(m.vocab_size())]
        if any(SPACE in m.id_to_piece(i).lstrip(SPACE) for i, s in enumerate(special) if not s):
            raise ValueError("a piece of this model crosses from a word into spaces")
        self.n_ids = m.vocab_size()
        self.lead = len(m.encode(self.LEAD, num_threads=1))
        self.token = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i)
                      else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.n_ids)]
        self.width = np.array([len(t) for t in self.token], np.int64)

    def _behind_lead(self, text: str) -> list[int]:
        """Ids of ``text`` as it stands behind another word: a lone space has one too."""
        return self.library.encode(self.LEAD + text, num_threads=1)[self.lead:]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, each chunk's number of them, and whether they give back its bytes."""
        ids, counts, same = [], np.zeros(len(chunks), np.int64), np.ones(len(chunks), bool)
        for i, j in blocks(chunks):
            text = "".join(chunks[i:j])
            got = self._behind_lead(text)
            if b"".join(map(self.token.__getitem__, got)) == text.encode():
                ids.append(np.array(got, np.int64))
                ends = np.cumsum(self.width[ids[-1]])
                last = np.searchsorted(ends, np.cumsum(byte_lengths(chunks[i:j])), side="right")
                counts[i:j] = np.diff(last, prepend=0)
                continue
            for k in range(i, j):                              # some chunk does not come back: one by one
                got = self._behind_lead(chunks[k])
                ids.append(np.array(got, np.int64))
                counts[k] = len(got)
                same[k] = b"".join(map(self.token.__getitem__, got)) == chunks[k].encode()
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), counts, same
