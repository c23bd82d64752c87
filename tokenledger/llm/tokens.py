"""Public tokenizers inside Python tasks: texts cut at boundaries no token crosses, each distinct
unit encoded once in a batch and remembered in a bounded memo."""

from __future__ import annotations

import array
import functools
import itertools
import os
import re
import sys

#: Entries of each of a worker's two memos; one starts anew beyond that.
MEMO_UNITS = 500_000
#: Longer units are encoded, but not remembered.
MEMO_CHARS = 64

#: A Latin letter or digit and then signs: every pattern here starts a token at the first sign. Not after U+0130, whose lower case
#: ends with a combining dot, which joins what follows. Tested for each character of the class.
TAIL_LETTERS, TAIL_SIGNS = "0-9A-Za-zÀ-ÖØ-öø-įı-ɏ", ".,;:!?*#$%&)-"
_TAIL = re.compile(rf"(?<=[{TAIL_LETTERS}])[{re.escape(TAIL_SIGNS)}]+$")

#: White space in any reading of the word, control separators included.
_WHITE = r"\s\x1c-\x1f\u180e\u200b\ufeff"
#: A blank that touches white space or an end of the text.
_ODD = re.compile(rf"[{_WHITE}] | [{_WHITE}]|^ | $")
#: Between a character that is no white space and a single blank before another such one.
_SAFE = re.compile(rf"(?<=[^{_WHITE}])(?= [^{_WHITE}])")


#: Before a blank behind another character, and before a line feed.
_PIECE_CUT = re.compile(r"(?<=[^ ])(?= )|(?=\n)")

#: How byte-level vocabularies cut a text into words. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name_or_path: str) -> str:
    if os.path.isabs(name_or_path):
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


#: What the plain encoding leaves to the other: bytes that begin characters beyond Latin, words of great length.
BEYOND, WORD_BYTES = 0xC9, 2000
PLAIN_CHARS = 1 << 16
#: Texts on which both libraries have to agree before the faster one is used.
PROBES = ("It's a test, isn't it?  WE'LL see.\n\n\tdone ", "x=12.50%; (y)!!\r\n -- caf\xe9 na\xefve \xa0\xab1\xbd\xbb", "a" * 300 + " 1234567890 " + "_-" * 40)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}


def _plain_encoding(told: dict):
    """The same byte-level vocabulary for the faster library, if its ids rise with the merges' ranks; else None."""
    import tiktoken

    if told["normalizer"] or told["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    vocab = told["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    ranks = [vocab.get("".join(m), -1) for m in merges]
    if ranks != sorted(ranks) or len(set(ranks)) < len(ranks):
        return None
    byte_of = _byte_of()
    special = {t["content"] for t in told["added_tokens"]}
    table = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Units:
    """Token ids of texts, as little-endian uint32 bytes, by a ``.json`` vocabulary.

    A vocabulary with word ends ignores white space, so a text may be cut at any blank or line
    feed. A byte-level vocabulary puts one blank in front of a word, so a text may be cut before a
    single blank between two characters that are no white space; texts with other runs of blanks
    are cut at fewer places. Strings of special tokens stand for them, as is the library's default, or
    are ordinary text (``plain_specials``).
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark slot, one thread
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        self.tok.no_padding()
        self.tok.no_truncation()
        import json

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_words = bool(told["model"].get("end_of_word_suffix"))
        self.specials = () if plain_specials else tuple(t["content"] for t in told["added_tokens"])
        self.plain = None if self.by_words else _plain_encoding(told)
        if self.plain and any(self.plain.encode_ordinary(t) != self.tok.encode(t, add_special_tokens=False).ids for t in PROBES):
            self.plain = None  # a version of either library that reads the pattern in another way
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def token_bytes(self) -> list[bytes]:
        """The text of each id of a byte-level vocabulary."""
        byte_of, vocab = _byte_of(), self.tok.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            out[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        return out

    def cut(self, text: str) -> list[str]:
        if self.by_words:
            return text.replace("\n", " ").split(" ")
        if "\x00" not in text and not _ODD.search(text):
            return text.replace(" ", "\x00 ").split("\x00")
        return _SAFE.split(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.plain is None:
            return self._by_units(texts)
        out: list[bytes | None] = [self._plain_ids(t) for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._by_units([texts[i] for i in rest])):
            out[i] = x
        return out

    def _plain_ids(self, text: str) -> bytes | None:
        """Of a text of Latin letters and signs alone, without special strings or very long words: there both
        libraries read the pattern alike, whatever Unicode tables they have."""
        import numpy as np

        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if not len(data):
            return b""
        gaps = np.diff(np.flatnonzero(data <= 32), prepend=-1, append=len(data))
        if data.max() >= BEYOND or gaps.max() > WORD_BYTES or any(s in text for s in self.specials):
            return None
        at, out = 0, []
        while len(text) - at > PLAIN_CHARS:  # long texts in parts
            cut = _SAFE.search(text, at + PLAIN_CHARS)
            if not cut:
                break
            out.append(_packed(self.plain.encode_ordinary(text[at : cut.start()])))
            at = cut.start()
        out.append(_packed(self.plain.encode_ordinary(text[at:] if at else text)))
        return b"".join(out)

    def _by_units(self, texts: list[str]) -> list[bytes]:
        """Units that the memo lacks are encoded in batches, each once."""
        import numpy as np

        parts = [self.cut(t) for t in texts]
        distinct = set().union(*parts)
        new = [u for u in distinct if u not in self.memo]
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.memo = {u: self.memo[u] for u in distinct if u in self.memo}
        memo = self.memo
        halves = [(u, m.start() if (m := _TAIL.search(u)) else len(u)) for u in new]
        pieces = {u[:at] for u, at in halves} | {u[at:] for u, at in halves}
        if len(self.pieces) + len(pieces) > MEMO_UNITS:
            self.pieces = {}
        known = self.pieces
        unknown = [p for p in pieces if p not in known]
        for at in range(0, len(unknown), 20_000):
            part = unknown[at : at + 20_000]
            got = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            flat = np.fromiter(itertools.chain.from_iterable(got), "<u4").tobytes()
            ends = [4 * n for n in itertools.accumulate(map(len, got))]
            known.update(zip(part, map(flat.__getitem__, map(slice, [0, *ends], ends))))
        for u, at in halves:
            memo[u] = known[u[:at]] + known[u[at:]]
        out = [b"".join(map(memo.__getitem__, p)) for p in parts]
        for u in new:
            if len(u) > MEMO_CHARS:
                del memo[u]
        for p in unknown:
            if len(p) > MEMO_CHARS:
                del known[p]
        return out


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@functools.lru_cache(maxsize=4)
def units(path: str, plain_specials: bool = False) -> Units:
    """One per Python worker and vocabulary."""
    return Units(path, plain_specials)


#: Texts on which a model's units have to have the ids of the whole text.
PIECE_PROBES = ("", "a", " a", "a b", "  a   b  \n\n c\n d \n", "\n", "\t x\r\n y\xa0z", "It's 12 \ufb01ne, isn't\u3000it? <s> caf\xe9 \U0001f600", "ab" * 200 + " " + "_-" * 40)


class PieceUnits:
    """Ids of texts, as little-endian uint32 bytes, by a SentencePiece ``.model`` of merges that puts a blank in front.

    No merge crosses a place that no piece of the vocabulary crosses. If that holds for a blank behind another character, and for both
    sides of a line feed, a text is cut before these and each distinct unit is encoded once in a batch: the blank in front of a unit is
    the one that the library adds; a line feed is encoded behind that blank, whose token goes. Other models encode whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tok.id_to_piece(i) for i in range(self.tok.get_piece_size())]
        self.memo: dict[str, bytes] = {}
        self.blank = self.tok.encode("\n")[:1]
        crossed = any("\u2581" in p.lstrip("\u2581") or "\n" in p for p in pieces)
        self.by_units = not crossed and all(self._joined(t) == self.tok.encode(t) for t in PIECE_PROBES if t)

    def cut(self, text: str) -> list[str]:
        text = " " + text
        if "  " not in text and "\x00" not in text:
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")[1:]
        return _PIECE_CUT.split(text)

    def _encoded(self, units: list[str]) -> list[list[int]]:
        got = self.tok.encode([u if u[0] == "\n" else u[1:] for u in units], num_threads=1)
        return [self.blank if u == " " else ids[1:] if u[0] == "\n" else ids for u, ids in zip(units, got)]

    def _joined(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self._encoded(self.cut(text))))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; an empty text has none."""
        if not self.by_units:
            return [_packed(x) for x in self.tok.encode(texts, num_threads=1)]
        own = ["\u2581" in t for t in texts]  # the blank's mark itself: any piece may hold it
        parts = [self.cut(t) if t and not marked else [] for t, marked in zip(texts, own)]
        distinct = set().union(*parts)
        new = [u for u in distinct if u not in self.memo]
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.memo = {u: self.memo[u] for u in distinct if u in self.memo}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.memo.update(zip(part, map(_packed, self._encoded(part))))
        out = [_packed(self.tok.encode(t)) if marked else b"".join(map(self.memo.__getitem__, p)) for t, marked, p in zip(texts, own, parts)]
        for u in new:
            if len(u) > MEMO_CHARS:
                del self.memo[u]
        return out

    def token_bytes(self) -> list[bytes]:
        """The text of each id: a piece with blanks for its marks, or the byte that it stands for."""
        tok = self.tok
        return [bytes([int(tok.id_to_piece(i)[1:-1], 16)]) if tok.is_byte(i) else tok.id_to_piece(i).replace("\u2581", " ").encode() for i in range(tok.get_piece_size())]


@functools.lru_cache(maxsize=2)
def piece_units(path: str) -> PieceUnits:
    """One per Python worker and model."""
    return PieceUnits(path)
