"""Token ids are those of the tokenizer, also where a text holds an added token."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lakewarden.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_texts_with_an_added_token():
    exact = Tokenizer.from_file(PATH)
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"x  {end}  y\n{end}{end} z", "<|endoftext|", f"one two{end[:-1]} {end}'s 12{end}34", "plain text", "", f"é {end}\n\n日本語"]
    ids, at = packing.token_ids(pa.array(texts), PATH)
    got = [ids[a : b - 1].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [exact.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [64, 50256, 65]


def test_a_stretch_is_encoded_once_even_when_others_are_forgotten(monkeypatch):
    exact, seen, encoded = Tokenizer.from_file(PATH), [], packing._encoded
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "_encoded", lambda parts, encoder: seen.append(len(parts)) or encoded(parts, encoder))
    packing._encoder(PATH).known.clear()
    first, more = " ".join(f"w{chr(97 + k)}x" for k in range(26)), " ".join(f"v{chr(97 + k)}y" for k in range(20))
    for text in (first, f"{first} {more}", f"{first} {more}", ""):
        ids, at = packing.token_ids(pa.array([text]), PATH)
        assert ids[: at[1] - 1].tolist() == exact.encode(text, add_special_tokens=False).ids
    assert seen == [26, 20]
    assert packing._values(pa.array([b"a", b"", b"bcd"], pa.large_binary())[1:]) == [b"", b"bcd"] and packing._values(pa.array([], pa.large_binary())) == []
