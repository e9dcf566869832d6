from collections import Counter

import numpy as np
import pyarrow.fs
import pytest
from strandwork.llm import token_output as S

from .test_bpe import LIBRARY, PATH

DOCS = "doc_id bigint, text string, slot int"


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(total):
    got = S.slots(np.arange(total), total, 7)
    assert sorted(got.tolist()) == list(range(total))
    assert (S.slots(np.arange(total), total, 7) == got).all()
    if total > 60:
        assert (S.slots(np.arange(total), total, 8) != got).any() and (np.diff(got) != 1).mean() > 0.8


def test_shards_hold_the_stream_of_each_partition(spark, tmp_path):
    rows = [(i, f"text {i} " * (i * 7 % 90), 0) for i in range(60)] + [(7, "again", 0), (7, "again", 0), (None, None, 0), (61, "", 0)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2)
    out = f"file://{tmp_path}/shards"
    manifest = S.materialised(docs, out, PATH, 50256, length=16, per_shard=32).collect()
    total = len(manifest)
    assert sorted(r.slot for r in manifest) == list(range(total))
    read = list(S.read_sequences(out, 0, total, 16, 32))
    streams = []
    for part in docs.rdd.glom().collect():
        stream = [(d.doc_id, n, x) for d in part for n, x in enumerate([*LIBRARY.encode(d.text or "", add_special_tokens=False).ids, 50256])]
        streams += [stream[at : at + 16] for at in range(0, len(stream), 16)]
    want = Counter((s[0][0], s[0][1], len(s), sum(n == 0 for _, n, _ in s[1:]) + 1, tuple(x for *_, x in s)) for s in streams)
    assert want == Counter((r.doc_id, r.first_token, r.n_tokens, r.n_docs, tuple(read[r.slot][: r.n_tokens].tolist())) for r in manifest)
    assert all((read[r.slot][r.n_tokens :] == 50256).all() and r.offset == r.slot % 32 * 32 and r.shard == r.slot // 32 for r in manifest)
    assert [x.tolist() for x in S.read_sequences(out, 30, 70, 16, 32)] == [x.tolist() for x in read[30:70]]
    files = pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(f"{tmp_path}/shards"))
    assert sorted(f.base_name for f in files) == [S.shard_name(i) for i in range(-(-total // 32))]
    again = f"file://{tmp_path}/again"
    S.materialised(docs, again, PATH, 50256, length=16, per_shard=32)
    assert [x.tolist() for x in S.read_sequences(again, 0, total, 16, 32)] == [x.tolist() for x in read]


def test_empty_table(spark, tmp_path):
    assert S.materialised(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none", PATH, 50256).count() == 0
