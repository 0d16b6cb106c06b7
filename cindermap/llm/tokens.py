"""Token ids of whole texts inside tasks: words are encoded once per worker and looked up after that."""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer

_CACHE_WORDS = 400_000  # bounds the memory of a worker; a full cache starts anew and takes over what is met again
_MARKS = ".,;:!?"
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_CUT = re.compile(r"(?<=\S)(?= \S)")  # where a single space stands between two other characters
_ENCODERS: dict[tuple[str, bool, bool], _Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else the next one from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printing)
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of each word after ``before``; a word not seen yet is encoded by the library."""

    def __init__(self, tokenizer: Tokenizer, before: str, lower: bool):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.before, self.lower, self.lead = before, lower, before.encode().decode("latin-1").translate(self.letters)
        self.marks = {m: self._model(m) for m in _MARKS}
        self.former: dict[str, bytes] = {}

    def bound(self) -> None:
        if len(self) > _CACHE_WORDS:
            self.former = dict(self)
            self.clear()

    def _model(self, spelled: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(spelled)])

    def __missing__(self, word: str) -> bytes:
        ids = self.former.get(word)
        if ids is not None:
            pass
        elif word[-1:] in self.marks and _LATIN.fullmatch(word, 0, len(word) - 1):
            ids = self[word[:-1]] + self.marks[word[-1]]  # letters and a mark never merge
        elif not _LATIN.fullmatch(word):
            ids = _packed(self.tokenizer.encode(self.before + word, add_special_tokens=False).ids)
        elif self.lower and not word.islower():
            ids = self[word.lower()]
        else:
            ids = self._model(self.lead + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))
        self[word] = ids
        return ids


class _Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    Both kinds of tokenizer split a text at white space before they merge anything:
    ``leading_space`` ones keep a single space with the word after it, the others drop white space
    and case. Words of Latin letters are a single piece for the library's model, all else goes through its
    whole chain. Texts with other white space than single spaces and line ends are cut
    only where a single space stands alone. With ``special_as_text`` strings of special tokens are ordinary text; without it, as
    the library loads a file, a text that holds the content of an added token goes to the library whole.
    """

    def __init__(self, path: str, leading_space: bool, special_as_text: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        normal = [self.tokenizer.normalizer.normalize_str(c) for c in added] if self.tokenizer.normalizer else []
        # in any case, as a token may be looked for in the text before or after it is brought to lower case
        forms = sorted({*added, *filter(None, normal)})
        self.added = re.compile("|".join(map(re.escape, forms)), re.I) if forms else None
        # what each form begins with before its first letter: a plain search for that is cheaper
        self.begins = {re.match(r"[^\w]*", c)[0] for c in forms}
        self.leading_space = leading_space
        self.first = _Words(self.tokenizer, "", not leading_space)
        self.rest = _Words(self.tokenizer, " ", False) if leading_space else self.first
        self.line_end = _packed(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def _line(self, words: list[str]) -> bytes:
        return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))

    def __call__(self, text: str) -> bytes:
        if self.added and any(b in text for b in self.begins) and self.added.search(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.first.bound()
        self.rest.bound()
        words = text.split()
        if not self.leading_space:
            # the library takes the separators 1C to 1F for letters, Python for white space
            return b"".join(map(self.first.__getitem__, re.split(r"[\t\n\v\f\r ]+", text) if any(c in text for c in _SEPARATORS) else words))
        if text.replace("\n", " ") == " ".join(words):
            return self.line_end.join([self._line(line.split(" ")) for line in text.split("\n")]) if text else b""
        head, *tail = _CUT.split(text)
        return self.first[head] + b"".join([self.rest[piece[1:]] for piece in tail])


def encoder(path: str, leading_space: bool, special_as_text: bool = True) -> _Encoder:
    """The encoder of this worker for the vocabulary file; made once and kept between tasks."""
    key = (path, leading_space, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = _Encoder(*key)
    return _ENCODERS[key]
