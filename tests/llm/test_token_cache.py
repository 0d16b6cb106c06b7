import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cindermap.llm import tokens


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_long_tail_of_words_is_encoded_once(monkeypatch, name, spaced):
    path = str(public_tokenizers.path(name))
    encode = tokens._Encoder(path, spaced, False)
    letters = "abcdefghij"
    words = ["x" + "".join(letters[int(d)] for d in str(i)) for i in range(150_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    first = [encode(t) for t in texts]
    seen, plain = [], tokens._Words.__missing__
    monkeypatch.setattr(tokens._Words, "__missing__", lambda self, word: seen.append(word) or plain(self, word))
    assert [encode(t) for t in texts] == first and not seen
    whole = Tokenizer.from_file(path).encode(texts[7], add_special_tokens=False).ids
    assert first[7] == tokens._packed(whole)


def test_separators_are_letters_for_the_library():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    encode, whole = tokens._Encoder(path, False, False), Tokenizer.from_file(path)
    for text in ("a\x1cb c", "a \x1d b", "\x1e", "one\x1ftwo three"):
        assert encode(text) == tokens._packed(whole.encode(text, add_special_tokens=False).ids)
