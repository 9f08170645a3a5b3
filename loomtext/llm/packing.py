"""Cost-balanced packing of token ids into sequences of at most 1024.

A document's ids are cut into full pieces and a rest. A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention
stays inside a piece). Within a window of whole documents of one task, as many sequences as the tokens need are opened,
and pieces go, in descending size, to the sequence of lowest cost among those with room; a piece that fits nowhere is cut
to fill the roomiest. So a window has one sequence with padding at most, and nothing is shuffled or gathered: a lost
task is redone from its own input alone. A window closes after WINDOW tokens (a document is never split between windows).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens of a window: bounds the memory of a task (4 bytes a token, and the pieces).
WINDOW = 4_000_000
#: Bytes of texts that are encoded at once, but for a single longer text.
BATCH = 4_000_000
#: Words whose ids a worker keeps, at about 200 bytes each.
KEPT_WORDS = 600_000

_loaded: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        spec = json.loads(tok.to_str())
        cut = spec.get("pre_tokenizer") or {}
        # Only a plain byte-level BPE cuts at single spaces before anything else.
        led = spec["model"].get("type") == "BPE" and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        named = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or [])
        _loaded[path] = (tok, {}, {}, led, re.compile(named) if named else None)
    return _loaded[path]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """The tokenizer's ids of each whole text, without special tokens added.

    A byte-level BPE cuts texts at single spaces before it merges, so ids of a text are those of its space-led words one
    after another; words are encoded once and kept. Texts with a run of spaces, a space at the end or the opening of a
    special token's name go through the tokenizer whole, as its rules look further there, and so do all texts if the
    tokenizer is of another kind.
    """
    tok, led, first, by_word, named = _tokenizer(path)
    out: list = [None] * len(texts)
    held: list[tuple] = []  # (text, words, places of words not known, their ids)
    whole: list[int] = []
    new_led: set[str] = set()
    new_first: set[str] = set()
    for i, t in enumerate(texts):
        if t and not by_word or "  " in t or "<|" in t or t[-1:] == " " or t[:1] == " " or (named and named.search(t)):
            whole.append(i)
        elif t:
            w = t.split(" ")
            got = list(map(led.get, w))
            got[0] = first.get(w[0])
            held.append((i, w, [k for k, x in enumerate(got) if x is None], got))
            if got[0] is None:
                new_first.add(w[0])
            new_led.update([w[k] for k in held[-1][2] if k])
        else:
            out[i] = np.zeros(0, np.uint32)

    def spelled(words: list[str], lead: str) -> dict[str, bytes]:
        made = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for w, e in zip(part, tok.encode_batch_fast([lead + w for w in part], add_special_tokens=False)):
                made[w] = array("I", e.ids).tobytes()
        return made

    extra_first, extra_led = spelled(list(new_first), ""), spelled(list(new_led), " ")
    for i, w, missing, got in held:
        for k in missing:
            got[k] = extra_led[w[k]] if k else extra_first[w[0]]
        out[i] = np.frombuffer(b"".join(got), np.uint32)
    for known, extra in ((first, extra_first), (led, extra_led)):
        if len(known) + len(extra) <= KEPT_WORDS:
            known.update(extra)
    if whole:
        for i, e in zip(whole, tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
    return out


def piece_cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) for documents of these token counts, and the number of sequences."""
    import heapq

    total = int(sizes.sum())
    n_seq = -(-total // length)
    out, nxt = [], 0
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(sizes.tolist()):
        full = n // length
        for k in range(full):
            out.append((d, k * length, length, nxt, 0))
            nxt += 1
        if n - full * length:
            rest.append((n - full * length, d, full * length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_n = n_seq - nxt
    # heaps[r]: (cost, sequence) of the sequences with exactly r tokens of room; tree: the least cost over ranges of room.
    size = 1 << (length + 1 - 1).bit_length()
    inf = float("inf")
    heaps: list[list] = [[] for _ in range(size)]
    tree = [inf] * (2 * size)

    def touch(r: int) -> None:
        h = heaps[r]
        i = r + size
        tree[i] = h[0][0] if h else inf
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            v = a if a <= b else b
            if tree[i] == v:
                break
            tree[i] = v
            i >>= 1

    def cheapest(least: int) -> int:
        """The room of the cheapest sequence with at least so much room, or -1."""
        lo, hi, best, at = least + size, 2 * size, inf, -1
        while lo < hi:
            if lo & 1:
                if tree[lo] < best:
                    best, at = tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if tree[hi] < best:
                    best, at = tree[hi], hi
            lo >>= 1
            hi >>= 1
        if at < 0:
            return -1
        while at < size:
            at = 2 * at if tree[2 * at] == best else 2 * at + 1
        return at - size

    heaps[length] = [(0.0, nxt + k) for k in range(open_n)]
    touch(length)
    roomiest = length
    for n, d, start in rest:
        while n:
            r = cheapest(n)
            take = n
            if r < 0:
                while not heaps[roomiest]:
                    roomiest -= 1
                r = take = roomiest
            cost, s = heapq.heappop(heaps[r])
            touch(r)
            out.append((d, start, take, s, length - r))
            if r > take:
                heapq.heappush(heaps[r - take], (cost + piece_cost(take), s))
                touch(r - take)
            n -= take
            start += take
    return out, n_seq


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Ids are the tokenizer's, then ``end_id``; a null text is an empty one, so each row has a token at least. Pieces of one
    sequence share sequence_id, and their offsets run without gaps from 0. Repeated rows are packed one by one. Ids may be
    null and other columns are not read. An empty table gives no piece. ``with_ids`` adds each piece's ids.
    """
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        ids: list = []
        toks: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, ids, toks, held
            sizes = np.array([len(t) for t in toks], np.int64)
            order = sorted(range(len(toks)), key=lambda i: (-sizes[i], ids[i] is None, ids[i]))
            got, n = assign(sizes[order], length)
            for at in range(0, len(got), 50_000):
                part = got[at : at + 50_000]
                who = [order[d] for d, *_ in part]
                cuts = [toks[w][s : s + k] for w, (_, s, k, _, _) in zip(who, part)]
                cols = [pa.array([ids[w] for w in who], src_type), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()), pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64()), pa.array(sizes[who], pa.int64()), pa.array([base + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64())]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    cols.append(pa.array([c.tolist() for c in cuts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
            base, ids, toks, held = base + n, [], [], 0

        src_type = None
        for b in batches:
            src_type = b.column(0).type
            # At once some thousand texts, or some MB of them.
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                limit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, side="right"))
                part = b.slice(at, max(1, min(1000, limit - at)))
                at += part.num_rows
                for i, t in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()], path)):
                    t = np.append(t, np.uint32(end_id))
                    ids.append(i)
                    toks.append(t)
                    held += len(t)
                    if held >= WINDOW:
                        yield from flush()
        if toks:
            yield from flush()

    out = src.mapInArrow(run, f"id {kind}, {PIECES}" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)
