"""The encoder against the library's ids: code points of every kind, pieces that come and go, long pieces."""

import numpy as np
from tokenizers import Tokenizer

from specloom.llm import tokens


def test_ids_equal_the_library_for_code_points_beside_everything():
    library = Tokenizer.from_file(tokens.tokenizer_path())
    points = [*range(0x800), *range(0x800, 0x110000, 61), 0x558, 0x88F, 0x1DF22, 0x85, 0xA0, 0x2028, 0x180E, 0x3000]
    texts = [f"a{c}'s x{c} 1 {c}b{c} {c}9" for c in (chr(p) for p in points if not 0xD800 <= p <= 0xDFFF)] + ["\U0001DF22's", "", " ", "a ", " a", "a  b", "a \n b", "<|endoftext|> x", "x" * 500 + " " + "y" * 70 + " z"]
    encoder = tokens.Encoder(tokens.tokenizer_path(), cache=300)  # both tables are used and emptied often
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(t), encoder.dtype).tolist() == want.ids, repr(t)
    assert len(encoder.known) <= 310 and all(len(p) <= 64 for p in encoder.known)
