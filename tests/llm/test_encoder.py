"""The memo of pieces: how few there are, and that their ids stay the library's."""

import pytest

pytest.importorskip("hopgrid.llm")
pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from hopgrid.llm.token_index import MemoEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(enc, text):
    return enc.tok.encode(text, add_special_tokens=False).ids


def test_final_signs_are_pieces_of_their_own():
    enc = MemoEncoder(VOCABULARY)
    text = "Strange strange!! strange### strange?), 1999!! straße*** strange"
    assert [int.from_bytes(x, "little") for x in _split(enc.encode(text), enc.width)] == plain(enc, text)
    assert set(enc.memo) == {"", "strange", "!!", "###", "?),", "1999", "straße", "***"}


def _split(raw, width):
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def test_signs_of_every_kind_have_the_library_ids():
    enc = MemoEncoder(VOCABULARY)
    ends = [*SIGNS, *(x + y for x in SIGNS for y in SIGNS), "'s", "'s.", "!'re", ".'", "̸.", "≠", "'ll!!"]
    texts = [f"{w}{e}{after}" for e in ends for w in ("word", "é", "½", "7", "Ⅷ", "á", "漢") for after in ("", " next", "\n")]
    for text, raw in zip(texts, enc.encode_all(texts)):
        assert [int.from_bytes(x, "little") for x in _split(raw, enc.width)] == plain(enc, text), text


def test_other_pieces_go_to_the_library_together(monkeypatch):
    enc = MemoEncoder(VOCABULARY)
    texts = [f"k{i}=v{i} 10.{i}.7 a@b{i}.com" for i in range(40)] + ["<|endoftext|> x=1", "p<|q r=2", ""]
    want = [plain(enc, t) for t in texts]
    calls = []
    monkeypatch.setattr(MemoEncoder, "_ids", lambda self, text, f=MemoEncoder._ids: calls.append(text) or f(self, text))
    got = enc.encode_all(texts)
    assert [[int.from_bytes(x, "little") for x in _split(raw, enc.width)] for raw in got] == want
    assert len(calls) < 20
    enc.between = None  # a tokenizer without such a token
    enc.memo, enc.old = {"": b""}, {}
    assert enc.encode_all(texts) == got
