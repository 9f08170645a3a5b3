import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from loomtext.llm import packing

TEXTS = ["", " ", "a", "a ", "  a", " a\n b", "x\n\n y", "a<|endoftext|>b", "é x　y", "\n", "a\t b", "it's  ok", "tab\there\n\nfoo bar's 123,456 ", "日本語 テスト", "a \n b", "word " * 3000, "end of", "The  the   the"]


def reference(texts):
    t = Tokenizer.from_file(packing.default_tokenizer())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "b ", " ", "\n", "'s", "9", "é", "  ", "\t", ".", "Z"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    want = reference(texts)
    for _ in range(2):  # with and without words that are known
        assert [x.tolist() for x in packing.encode(texts, packing.default_tokenizer())] == want


def test_assignment_places_every_token():
    rng = random.Random(4)
    for sizes in ([1], [1024], [1025, 3], [700, 700, 700], [rng.randint(1, 5000) for _ in range(300)], [1] * 3000):
        got, n = packing.assign(np.array(sorted(sizes, reverse=True)))
        assert n == -(-sum(sizes) // 1024)
        fill, parts = defaultdict(list), defaultdict(list)
        for d, s, k, q, o in got:
            fill[q].append((o, k))
            parts[d].append((s, k))
        for p in fill.values():
            at = 0
            for o, k in sorted(p):
                assert o == at
                at += k
            assert at <= 1024
        for d, p in parts.items():
            at = 0
            for s, k in sorted(p):
                assert s == at
                at += k
            assert at == sorted(sizes, reverse=True)[d]


def test_costs_are_balanced():
    sizes = np.array(sorted([random.Random(5).randint(1, 900) for _ in range(2000)], reverse=True))
    got, n = packing.assign(sizes)
    cost = defaultdict(float)
    for _, _, k, q, _ in got:
        cost[q] += packing.piece_cost(k)
    c = np.array(sorted(cost.values()))
    assert c[-1] <= packing.piece_cost(1024) and c[len(c) // 20] > 0.4 * c.mean()


def test_pieces_of_a_table(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (None, "a", "x", 1), (3, "a ", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3)
    got = packing.pack(df, with_ids=True).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for p in seqs.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, ids in enumerate(reference(TEXTS)):
        if i != 3:
            whole = [x for r in sorted(docs[i], key=lambda r: r.start) for x in r.ids]
            assert whole == ids + [0]
    assert sum(r.length for r in docs[3]) == 2 * (len(reference(["a "])[0]) + 1)
    assert sorted(r.doc_tokens for r in docs[None]) == [1, 2]
    assert len(packing.pack(df.where("false")).collect()) == 0


def test_other_kinds_of_tokenizers(tmp_path, monkeypatch):
    """A tokenizer that doesn't cut at single spaces gets whole texts."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {w: i for i, w in enumerate(["[UNK]", "a", "b", "a b"])}
    t = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    path = str(tmp_path / "t.json")
    t.save(path)
    assert [x.tolist() for x in packing.encode(["a b,b", "a,b", "", "c"], path)] == [[3, 2], [1, 2], [], [0]]
