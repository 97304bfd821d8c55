from evidence_engine.llm import packing
from evidence_engine.llm.queries import tokenizer_file


def test_remembered_words_are_few():
    """A worker that packs keeps its memory while it serves other stages."""
    with open(tokenizer_file(), encoding="utf-8") as file:
        ids = packing.WordIds(file.read())
    for at in range(0, 260_000, 20_000):
        ids.encode_all([b" ".join(b"%d," % i for i in range(at, at + 20_000))])
    assert len(ids.words) <= packing.REMEMBERED + 20_000 < 250_000
