"""Exact, cached encoding of texts with a word-level BPE vocabulary file of the tokenizers library.

The vocabulary drops white space and never merges across it, so the ids of a text are the ids of its
white-space-separated words, one after the other.  A batch of texts is cut into words and its distinct words are found
by Arrow; each distinct word is encoded once per worker by the library and remembered; plain words (ASCII without
apostrophes, Latin-1 letters) are cut into the pieces its own splitting pattern makes of them, and the pieces of many
words are encoded in one call.  All other words go through the complete tokenizer.  Texts that hold the string of one of
the file's added tokens, or other white space than ASCII's, go through it whole, and so does every text if the file's
normalizer or splitting pattern is not the one these rules are made for.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by one worker before it starts afresh, and the longest of them in characters: about 150 MB.
CACHE_WORDS, CACHE_CHARS = 500_000, 48
#: Pieces remembered likewise: about 80 MB.
CACHE_PIECES = 400_000
END_ID = 1
#: Stands between words among the ids of pieces, which have four bytes each.
PART = b"|"

# What the rules below are made for, as the vocabulary file states it.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPACE_RULE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_NOT_PLAIN = re.compile("[^!-&(-~À-ÖØ-öø-ÿ]")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Control signs and white space that are not plain for the word cutter.
ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"

_ENCODERS: dict[str, WordEncoder] = {}


def default_path() -> str:
    """Path of the vocabulary file on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_rules_hold(spec: dict) -> bool:
    """Whether a vocabulary file's texts may be encoded word by word with the rules of this module."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec.get("model") or {}
    return (
        [s.get("type") for s in steps] == NORMALIZERS
        and steps[1] == SPACE_RULE
        and [s.get("type") for s in cut] == ["Split", "ByteLevel"]
        and cut[0].get("pattern") == {"Regex": SPLIT_RULE}
        and bool(model.get("end_of_word_suffix"))
        and (cut[0].get("behavior"), cut[0].get("invert")) == ("Removed", True)
        and not cut[1].get("add_prefix_space")
        and not cut[1].get("use_regex")
        and model.get("type", "BPE") == "BPE"
        and not model.get("dropout")
        and all(
            not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or []
        )
        and spec.get("post_processor") is None
        and spec.get("truncation") is None
    )


class WordEncoder:
    def __init__(self, path: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = path or default_path()
        self.full = Tokenizer.from_file(path)
        self.vocab_size = self.full.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = word_rules_hold(spec)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.whole = "|".join([ODD_SPACE, *added])
        self.pieces = Tokenizer.from_file(path)
        self.pieces.encode_special_tokens = True  # pieces of words are never added tokens
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # signs outside ASCII stand for their bytes
        self.byte_pieces = Tokenizer.from_file(path)
        self.byte_pieces.encode_special_tokens = True
        self.byte_pieces.normalizer = normalizers.Sequence([])
        self.byte_pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.is_last = np.zeros(self.vocab_size, dtype=bool)
        for token, i in self.full.get_vocab(with_added_tokens=False).items():
            self.is_last[i] = bool(suffix) and token.endswith(suffix)
        self.known_pieces: dict[str, bytes] = {"'": PART}
        self.words: dict[str, bytes] = {}
        self.cache_words = CACHE_WORDS

    def _whole_text(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Ids of distinct pieces: a token that ends a piece is known by its mark."""
        ascii_ = [p for p in pieces if p.isascii()]
        for encode, some in (
            *((self.pieces.encode_batch_fast, x) for x in _portions(ascii_, 500)),
            *((self.byte_pieces.encode_batch_fast, x) for x in _portions([p for p in pieces if not p.isascii()], 500)),
        ):
            ids = np.array(encode([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * np.flatnonzero(self.is_last[ids]) + 4).tolist()
            raw = ids.tobytes()
            if len(stops) != len(some):
                raise ValueError("the vocabulary file does not mark the ends of its pieces")
            self.known_pieces.update(zip(some, [raw[i:j] for i, j in zip([0, *stops], stops)], strict=True))

    def _learn(self, unknown: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        out: dict[str, bytes] = {}
        plain, rest = [], []
        for word in unknown:
            if word.isascii() and word.isprintable():
                (rest if "'" in word else plain).append(word)
            else:
                (rest if _NOT_PLAIN.search(word) else plain).append(word)
        known = self.known_pieces
        for some in _portions(plain, 20_000):
            # an apostrophe, which no plain word holds, parts the words
            pieces = _PIECES.findall(" ' ".join(some).lower())
            found = list(map(known.get, pieces))
            new = {p: None for p, x in zip(pieces, found, strict=True) if x is None}
            if new:
                if len(known) > min(CACHE_PIECES, self.cache_words):
                    known.clear()
                    known["'"] = PART
                    new = dict.fromkeys(pieces)
                    new.pop("'", None)
                self._learn_pieces(list(new))
                found = list(map(known.__getitem__, pieces))
                for p in new:
                    if len(p) > CACHE_CHARS:
                        del known[p]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ends = np.cumsum(sizes)
            parts = ends[sizes == len(PART)]
            raw = b"".join(found)
            starts = [0, *parts.tolist()]
            stops = [*(parts - len(PART)).tolist(), len(raw)]
            out.update(zip(some, [raw[i:j] for i, j in zip(starts, stops, strict=True)], strict=True))
        for some in _portions(rest, 1000):
            for word, e in zip(some, self.full.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[word] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _encode_distinct(self, words: list[str]) -> list[bytes]:
        known = self.words
        found = list(map(known.get, words))
        unknown = [w for w, x in zip(words, found, strict=True) if x is None]
        if unknown:
            if len(known) > self.cache_words:
                known.clear()
                unknown = words
            known.update(self._learn(unknown))
            found = list(map(known.__getitem__, words))
            for w in unknown:
                if len(w) > CACHE_CHARS:
                    del known[w]
        return found

    def encode_documents(self, texts: pa.Array | list[str | None], end_id: int | None = END_ID) -> list[np.ndarray]:
        """Ids of each whole text as little-endian unsigned 32-bit integers, with ``end_id`` (unless None) after them.

        None is encoded as an empty text.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.by_word:
            apart = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        else:
            apart = np.arange(len(texts))
        end = np.empty(0, dtype="<u4") if end_id is None else np.array([end_id], dtype="<u4")
        whole = {int(i): np.frombuffer(self._whole_text(texts[int(i)].as_py()) + end.tobytes(), dtype="<u4") for i in apart}
        if whole:
            mask = np.ones(len(texts), dtype=bool)
            mask[apart] = False
            texts = pc.if_else(pa.array(mask), texts, pa.scalar("", pa.large_string()))
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids = self._encode_distinct(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids.append(end.tobytes())
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        # the end id follows each text as one more word
        order = np.insert(words.indices.to_numpy(), ends, len(ids) - 1)
        size = sizes[order]
        upto = np.cumsum(size)
        source = np.repeat(starts[order] - upto + size, size)
        source += np.arange(len(source))
        every = flat[source]
        last = upto[ends + np.arange(len(ends))]
        first = np.concatenate([[0], last[:-1]]) if len(last) else last
        return [whole[i] if i in whole else every[a:b] for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True))]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, without an end id."""
        return self.encode_documents([text], None)[0]

    def encode_document(self, text: str | None, end_id: int = END_ID) -> np.ndarray:
        return self.encode_documents([text], end_id)[0]


def _portions(words: list[str], count: int) -> Iterator[list[str]]:
    return (words[at : at + count] for at in range(0, len(words), count))


def encoder(path: str | None = None, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The worker's encoder for this file, kept between tasks, with at most about so many words and pieces remembered."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path)
    _ENCODERS[key].cache_words = cache_words
    return _ENCODERS[key]


def in_slices(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of texts of about so many bytes."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 50
    upto = np.cumsum(lengths)
    at = 0
    while at < len(texts):
        before = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + size)))
        yield at, texts.slice(at, stop - at)
        at = stop
