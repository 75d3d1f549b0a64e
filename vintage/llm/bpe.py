"""Word-level byte-pair encoding with remembered pieces.

The vocabularies meant here drop white space before merging, so a text's ids are
the concatenated ids of its white-space separated words, and a word's ids those
of its pre-tokens. Both levels repeat heavily: Arrow numbers the distinct words
of a slice of text, plain ones are split into pieces in Arrow too, and each
distinct piece is merged once per worker by the tokenizer library's own model.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Letters below this code point are split and lower-cased here; other words go to the library whole.
SIMPLE_BELOW = "ɐ"
#: Words that Arrow splits: letters of Latin-1, which composition leaves alone, and one run of marks behind them.
LETTERS, MARKS = "a-zß-öø-ÿ", "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"
PLAIN = f"^[A-ZÀ-ÖØ-Þ{LETTERS}]+[{regex.escape(MARKS, special_only=False)}]*$"
#: Pieces that a worker remembers before it starts afresh; affects speed only.
REMEMBERED = 600_000
#: Pieces that go to the library at a time; bounds what it holds.
AT_ONCE = 20_000


def _byte_table() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class WordTokenizer:
    """Splits words into pre-tokens and gives the ids of either, as the library does for whole texts.

    A piece is a normalised pre-token or, where only the library knows (special
    strings, scripts outside Latin), a space and the whole word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(open(path, encoding="utf-8").read())
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError(f"{path}: not a vocabulary that drops white space between lower-cased words")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: The same merges for pieces that are already split, joined by spaces.
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        if not all(b"<|" in s for s in self.specials):
            raise ValueError(f"{path}: special strings of another form than <|...|>")
        self.bytes_to_chars = _byte_table()

    def pieces(self, word: bytes) -> list[str]:
        """The pieces of a word without ASCII white space."""
        text = word.decode("utf-8", "replace")
        if b"<|" in word and any(s in word for s in self.specials):
            return [" " + text]
        if not text.isascii():
            if max(text) >= SIMPLE_BELOW or not unicodedata.is_normalized("NFC", text):
                return [" " + text]
        text = text.lower()  # may bring a mark that is no letter
        return [text] if text.isalpha() else self.pattern.findall(text)

    def _alphabet(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes_to_chars)

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each piece has."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), AT_ONCE):
            some = pieces[at : at + AT_ONCE]
            whole = {i: self.library.encode(p[1:], add_special_tokens=False).ids for i, p in enumerate(some) if p[0] == " "}
            # A whole word holds the place of one id, which its own ids replace.
            found = self.merges.encode(" ".join("a" if i in whole else self._alphabet(p) for i, p in enumerate(some)), add_special_tokens=False)
            ids, n = np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))
            if whole:
                parts = np.split(ids, np.cumsum(n)[:-1])
                for i, own in whole.items():
                    parts[i], n[i] = np.array(own, np.uint32), len(own)
                ids = np.concatenate(parts)
            flat.append(ids)
            lengths.append(n)
        return np.concatenate(flat), np.concatenate(lengths)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i in a row."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Words:
    """The words of some texts by number, and the distinct words' pieces by number.

    ``text_words``: how many words each text has; ``words``: the number of each
    word in order; ``starts``, ``lengths``: where a distinct word's pieces lie in
    ``word_pieces``, which numbers the distinct ``pieces``.
    """

    def __init__(self, tokenizer: WordTokenizer, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.view(pa.string()))
        self.text_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        self.words, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        plain = pc.match_substring_regex(distinct, PLAIN)
        lower = pc.utf8_lower(distinct.filter(plain))
        stems = pc.utf8_rtrim(lower, characters=MARKS)
        marked = pc.not_equal(pc.binary_length(stems), pc.binary_length(lower))
        marks = pc.replace_substring_regex(lower.filter(marked), f"^[{LETTERS}]+", "")
        marked = marked.to_numpy(zero_copy_only=False)
        is_plain = plain.to_numpy(zero_copy_only=False)
        odd = [tokenizer.pieces(w) if w else [] for w in distinct.filter(pc.invert(plain)).view(pa.binary()).to_pylist()]
        self.lengths = np.empty(len(distinct), np.int64)
        self.lengths[is_plain] = 1 + marked
        self.lengths[~is_plain] = odd_lengths = np.fromiter(map(len, odd), np.int64, len(odd))
        self.starts = np.cumsum(self.lengths) - self.lengths
        numbered = pa.concat_arrays([stems, marks, pa.array(chain.from_iterable(odd), pa.string())]).dictionary_encode()
        numbers, self.pieces = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary
        self.word_pieces = np.empty(len(numbers), np.int64)
        own, n = self.starts[is_plain], len(stems)
        self.word_pieces[own] = numbers[:n]
        self.word_pieces[own[marked] + 1] = numbers[n : n + len(marks)]
        self.word_pieces[spans(self.starts[~is_plain], odd_lengths)] = numbers[n + len(marks) :]


class PieceMemory:
    """Ids of pieces by value, in flat arrays: Arrow finds a slice's pieces among those remembered."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def number(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; those given out before no longer hold."""
        if len(self.known) > REMEMBERED:
            self.clear()
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            fresh = pieces.filter(at.is_null())
            flat, lengths = self.tokenizer.ids(fresh.to_pylist())
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])
            missing = at.is_null().to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[missing] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, fresh])
            return at
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def token_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts in a row, and how many each text has."""
        found = Words(self.tokenizer, texts)
        pieces = self.number(found.pieces)[found.word_pieces]
        # First the ids of every distinct word, then those of the words in order.
        piece_lengths = self.lengths[pieces]
        ids = self.flat[spans(self.starts[pieces], piece_lengths)]
        ends = np.concatenate([[0], np.cumsum(piece_lengths)])
        starts, lengths = ends[found.starts], ends[found.starts + found.lengths] - ends[found.starts]
        lengths = lengths[found.words]
        ids = ids[spans(starts[found.words], lengths)]
        ends, bounds = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(found.text_words)])
        return ids, np.diff(ends[bounds])


def memory_for(path: str) -> PieceMemory:
    """One memory per worker process and file; it outlives the task."""
    from .common import remembered

    return remembered(("pieces", path), lambda: PieceMemory(WordTokenizer(path)))
