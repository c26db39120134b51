"""Special tokens in any case are encoded as the library does."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pagequarry.llm import tokens

TEXTS = [
    "a <|ENDOFTEXT|> b", "a <|endoftext|> b", "a<|EndOfText|>b", "<|STARTOFTEXT|>", "<|startoftext|>", "", None, "<", "|A", "<|", "Plain Words, and <| others |>",
    "x <|Y", "É <|ENDOFTEXT|> É", "a", "İ <|ENDOFTEXT|>",
]


def test_special_tokens_in_any_case():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = tokens.PartEncoder(path, True).encode(pa.array(TEXTS, pa.string()))
    for text, ids in zip(TEXTS, got):
        assert list(ids) == library.encode(text or "", add_special_tokens=False).ids, text
    assert [list(x) for x in tokens.PartEncoder(path, True).encode(pa.array(["", "a", None], pa.string()))] == [[], library.encode("a", add_special_tokens=False).ids, []]
