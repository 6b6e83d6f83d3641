import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.edges import TEXTS, frame
from tidemark.llm.tokens import merger, token_counts, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
SPECIAL = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b  c", " x \n y\t\tz  ", "don't I'LL 's", "a  b   c \n\n d ", "  ", "😀😀 a😀"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def test_equals_the_library(spark, library):
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(SPECIAL)]
    got = [(r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, rows)).collect()]
    want = [(len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for _, t in rows]
    assert sorted(got) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    lib = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    assert merger(vocabulary_path("byte_bpe_50k.json")).count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_empty_table(spark):
    assert token_counts(frame(spark, [])).count() == 0


def test_clashing_columns(spark):
    assert token_counts(frame(spark, clash=True)).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_memory_of_fragments_is_bounded(monkeypatch):
    import tidemark.llm.tokens as T

    monkeypatch.setattr(T, "REMEMBERED", 100)
    m = T.PairMerger(T.vocabulary_path("byte_bpe_50k.json"))
    want = T.PairMerger(T.vocabulary_path("byte_bpe_50k.json"))
    for text in (*(f"a{i}  b{i} " for i in range(300)), " ".join(f"w{i}" for i in range(1000)), "x  " + " ".join(f"v{i}" for i in range(1000))):
        assert m.count(text) == sum(want.piece(p.encode()) for p in want.pieces.findall(text))
        assert len(m.known) <= 100
