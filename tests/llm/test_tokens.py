import random
import zlib

import numpy as np
import pytest

from skein.llm.packing import CapacityTree, best_fit, pack, plan_lengths
from skein.llm.tokenfile import CorruptFrame, Reader, read_documents, token_output, write_token_files
from skein.llm.tokens import Encoder, tokenizer_path

PARTS = ["a", "b", "Z", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "don't", "é", "1", "23", "²", "!", "..", "_", " ", "日本", "😀", "<|endoftext|>", " 's", "ß", "́", "'ve", "\x00", "\x1c"]


def texts(n=400):
    rnd = random.Random(1)
    return [None, "", " ", "\n\n", "word " * 3000, "z" * 20_000, " ".join(str(rnd.random()) for _ in range(15_000)), *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n))]


@pytest.fixture(scope="module")
def tokenizer():
    return Encoder(tokenizer_path()).tokenizer


def test_ids_equal_the_library(tokenizer):
    enc, some = Encoder(tokenizer_path()), texts(2000)
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
    for _ in range(2):  # with an empty table, then with a full one
        assert [ids[o[i - lo] : o[i - lo + 1]].tolist() for lo, hi, ids, o in enc.encode(some) for i in range(lo, hi)] == want


def table(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts())] + [(9, "a", "x"), (9, "a", "x"), (None, "null id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), rows


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    docs, rows = table(spark)
    got = token_output(docs).collect()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    # random access and damage
    folder = f"file://{tmp_path}/tokens"
    part = write_token_files(docs, folder, files=1).collect()[0]
    raw = open(part.path, "rb").read()
    with open(part.path, "rb") as f:
        reader = Reader(f, len(raw))
        assert len(reader.table) > 1
        k = int(np.flatnonzero(reader.index["doc"] == 15)[0])
        assert [ids.tolist() for _, ids in reader.documents([k])] == [[*tokenizer.encode("z" * 20_000, add_special_tokens=False).ids, 0]]
    broken = bytearray(raw)
    broken[int(reader.table[0][0]) // 2] ^= 1
    import io

    with pytest.raises(Exception):
        list(Reader(io.BytesIO(bytes(broken)), len(broken)).documents())
    with pytest.raises(CorruptFrame):
        Reader(io.BytesIO(raw[:-1]), len(raw) - 1)


def test_only_requested_documents_are_read(spark, tokenizer, tmp_path):
    docs, rows = table(spark)
    folder = f"file://{tmp_path}/tokens"
    manifest = write_token_files(docs, folder)
    asked = [0, 9, 15, 18, 300, 301, 10**9, -4, None]
    got = read_documents(manifest, folder, spark.createDataFrame([(i,) for i in asked], "doc_id long")).collect()
    want = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows if r[0] in asked and r[0] is not None]
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted(want)
    assert read_documents(manifest, folder, spark.createDataFrame([], "doc_id long")).collect() == []


def test_packing_is_whole_and_gapless(spark, tokenizer):
    docs, rows = table(spark)
    got = pack(docs, window=256).collect()
    spent, sequences = {}, {}
    for r in got:
        spent.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and s[0].sequence_length == (at if at & (at - 1) == 0 else 256)
    assert sorted(sequences) == list(range(len(sequences)))
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, len(ids[k : k + 256]), crc(ids[k : k + 256]), len(ids)) for k in range(0, len(ids), 256)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=key) == sorted(want, key=key)


def one_by_one(sizes, window):
    """Best-fit decreasing, a piece at a time: contents of the windows."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(window - s)
    return sorted(window - r for r in room)


def test_plan_equals_best_fit_decreasing():
    rnd = random.Random(4)
    for window in (8, 64, 100):
        for _ in range(60):
            sizes = [rnd.randint(1, window) for _ in range(rnd.randint(0, 120))]
            counts = {s: sizes.count(s) for s in set(sizes)}
            plan, content = best_fit(counts, window), {}
            for s, n in counts.items():
                where, offset = plan.place(np.full(n, s), np.arange(n))
                for w, o in zip(where.tolist(), offset.tolist()):
                    content.setdefault(w, []).append((o, s))
            for parts in content.values():
                at = 0
                for o, s in sorted(parts):
                    assert o == at
                    at += s
            assert sorted(sum(s for _, s in p) for p in content.values()) == one_by_one(sizes, window)
            edges, padded = plan_lengths(plan, counts, window)
            for w, p in content.items():
                full = sum(s for _, s in p)
                assert padded[np.searchsorted(edges, w, side="right") - 1] == (full if full & (full - 1) == 0 else window)


def test_capacity_tree():
    tree = CapacityTree(50)
    for c in (3, 17, 50):
        tree.set(c, True)
    assert [tree.tightest(x) for x in (1, 3, 4, 17, 18, 50)] == [3, 3, 17, 17, 50, 50]
    tree.set(50, False)
    assert tree.tightest(18) is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none).collect() == [] and token_output(none).collect() == []
