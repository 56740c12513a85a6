import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lodestone.llm import common
from lodestone.llm import op5_sentencepiece as op


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op.MODEL)


def test_ids_and_texts_are_the_library_s(library):
    rng, enc = random.Random(5), op.Encoder()
    some = [*" ab\n▁e  tthéß<0x>A中🙂\t́aaaa 　fi\x00", "the ", "<s>", "<0x0A>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["a" * n for n in range(40)] + ["ab" * 50, " " * 37, "the " * 30, "aaaaab" * 9, "", " ", "\n", "x" * 20_000]
    for text, data in zip(texts, enc.ids(texts)):
        ids = [enc.bos, *np.frombuffer(data, "<u4").tolist(), enc.eos]
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids == want, repr(text)
        assert enc.decode(np.array(ids)) == library.decode(want), repr(text)


def test_small_store_gives_the_same(library):
    enc = op.Encoder(cache_units=5)
    texts = ["one two three four", "five  six", "two one seven\neight nine"]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == library.encode(texts)


def test_any_ids_decode(library):
    rng, enc = random.Random(6), op.Encoder()
    for _ in range(500):
        ids = [rng.randrange(3, 300) for _ in range(rng.randint(0, 12))]
        assert enc.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_frames(odd, odd_rows, none, library):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in odd_rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((-1 if i is None else i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode())))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.digests(odd).collect()]
    assert sorted(got) == sorted(want)
    full = op.encode(odd).collect()
    assert sorted(len(r.ids) for r in full) == sorted(w[1] for w in want)
    assert op.digests(none).count() == op.encode(none).count() == 0


def test_workers_keep_little(library, monkeypatch):
    """A batch is cut into units in runs, and a task leaves no stored units behind."""
    monkeypatch.setattr(op, "RUN_CHARS", 50)
    enc, held = op.Encoder(), []
    joined = enc.words.joined
    monkeypatch.setattr(enc.words, "joined", lambda lists: held.append(sum(map(len, lists))) or joined(lists))
    texts = ["one two three four five", "", "six  seven", "eight\nnine"] * 50 + ["ten " * 60]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == library.encode(texts)
    assert enc.ids([]) == [] and max(held) <= 65 and enc.words.young and enc.others.young
    run = common.tidy(lambda batches: (enc.ids(b) for b in batches), enc.forget)
    assert [len(x) for x in run(iter([texts, texts]))] == [201, 201]
    assert not (enc.words.young or enc.words.old or enc.others.young or enc.others.old)
