import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from strandwork.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, VOCABULARY = Tokenizer.from_file(PATH), bpe.load_vocabulary(PATH)


def ids_of(texts):
    ids, ends = bpe.encode_block(VOCABULARY, texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_ids_and_text_equal_the_library(texts):
    got = ids_of(texts)
    assert got == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode_bytes(VOCABULARY, i) for i in got] == texts


def test_hard_texts():
    texts = ["", "a" * 5001, "ab" * 3000 + " " * 70, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "it's I'LL we're 's", "\x1c\x85    z", "😀" * 9 + "é" * 99]
    assert ids_of(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert bpe.decode_bytes(VOCABULARY, [220, 447]) == LIBRARY.decode([220, 447], skip_special_tokens=False)


def test_texts_of_single_spaces_and_others_agree():
    texts = ["a b c", "a  b", " a b", "a b ", "x\n y z", "a\u00a0b c", "\u3000 a b", "a \u2028b", "tab\t b c", "it 's  's we 'll", "  ", " "]
    assert ids_of(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert ids_of([]) == [] and ids_of([None, ""]) == [[], []]


def test_frame_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "hello  world", 5), (2, None, 6), (2, None, 6), (None, "x" * 70000, 7), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in bpe.tokenized(docs, PATH, ids=True).collect())
    want = []
    for doc_id, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert got == sorted(want)
    assert bpe.tokenized(docs.limit(0), PATH).count() == 0
