import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from assayline.llm import packing
from assayline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_cached_ids_equal_the_tokenizer():
    t, cache, rng = Tokenizer.from_file(PATH), packing.WordCache(PATH, limit=500), random.Random(2)
    al = list("abE'sTé́ß½²😀\0日 \n\t\x85\xa0.,-%12ΣσςİIµª") + ["don't", " I'LL", "<|endoftext|>", "<|", "ªº", "'Re", "word "]
    texts = ["".join(rng.choices(al, k=rng.randrange(30))) for _ in range(1500)]
    for i in range(0, 1500, 50):
        part = texts[i:i + 50]
        want = [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in cache.ids(part)] == want


def check(rows, docs, window=4096):
    """Every id once and in order, windows gapless, padding only where allowed."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append(r)
    for i, ids in docs.items():
        parts = sorted(by_doc[i], key=lambda r: r[1])
        assert b"".join(p[3] for p in parts) == ids and all(p[4] == len(ids) // 4 for p in parts)
    pad = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r[6]):
            assert p[6] == at
            at += p[2]
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad


def test_packer_covers_everything_without_padding():
    rng = random.Random(4)
    docs = {i: np.arange(rng.choice([1, 3, 70, 900, 4095, 4096, 4097, 20000])).astype("<u4").tobytes() for i in range(400)}
    p = packing.Packer(5)
    for i, ids in docs.items():
        p.add(i, ids)
    p.drain()
    assert check(p.taken(), docs) == 0


def test_choice_has_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    for _ in range(400):
        p = packing.Packer(0, window=64, levels=8, cut=int(rng.integers(0, 9)))
        for fill in rng.integers(1, 64, rng.integers(0, 30)).tolist():
            p._put(fill, [])
        size = int(rng.integers(1, 64))

        def total(level):
            n = [0, *map(len, (p.open.get(h, []) for h in range(1, 9)))]
            fill = p.open[level][-1][0] if level else 0
            n[level] -= bool(level)
            rest = fill + size if fill + size <= 64 else fill + size - 64
            if rest < 64:
                n[-(-rest // 8)] += 1
            return sum(x * x for x in n) + p.cut * (fill + size > 64)

        options = [0] + [h for h in range(1, 9) if p.open.get(h)]
        assert total(p.choose(size)) == min(map(total, options))


def test_open_windows_are_few_whatever_the_sizes():
    rng = random.Random(6)
    for sizes in ([2049], [2100, 1], [1400, 2800], [4095], [1], [3000, 3001, 3002], list(range(1, 4096))):
        p = packing.Packer(0)
        for i in range(3000):
            p.add(i, bytes(4 * rng.choice(sizes)))
            assert p.levels.max() <= packing.CUT // 2 + 2
        assert int(p.levels.sum()) <= (packing.LEVELS + 1) * (packing.CUT // 2 + 2)


def test_little_is_left_to_the_end_of_a_partition():
    rng = random.Random(8)
    p = packing.Packer(0)
    total = 0
    for i in range(8000):
        n = int(rng.paretovariate(1.3) * 150) % 9000 + 1
        total += n
        p.add(i, bytes(4 * n))
    p.drain()
    assert p.drained < 0.05 * total


def test_table(spark, odd_docs, no_docs, odd_rows):
    rows = [tuple(r) for r in packing.pack(odd_docs.where("doc_id IS NOT NULL AND doc_id <> 2"), PATH).collect()]
    cache = packing.WordCache(PATH)
    docs = {r[0]: cache.ids([r[1] or ""])[0] + (2).to_bytes(4, "little") for r in odd_rows if r[0] not in (None, 2)}
    assert check(rows, docs) == 0
    whole = packing.pack(odd_docs, PATH).collect()
    assert sum(r.length for r in whole if r.doc_id == 2) == 2 * len(cache.ids([odd_rows[1][1]])[0]) // 4 + 2
    assert all(zlib.crc32(r.ids) >= 0 for r in whole) and packing.pack(no_docs, PATH).count() == 0
