import random

import sentencepiece

from assayline.llm import sentencepiece_codec as spc
from assayline.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ALPHABET = list("ab ▁  \n\té́ß😀\0<>/s日本語 1.,IİΣςσ\x1c\x85\xa0'") + ["<s>", "</s>", "<0x41>", "<unk>", "the ", "  ", "ﬁ", "①", "ｶﾞ", "㍿"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(n)] + ["", " ", "  a  b  ", "▁a"]


def test_ids_and_text_equal_the_library():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), spc.Codec(PATH, limit=300)
    sample = texts(1500, 1)
    want = lib.encode(sample)
    for i in range(0, len(sample), 100):
        for t, w, (ids, _, _) in zip(sample[i:], want[i:i + 100], codec.encode([t.encode() for t in sample[i:i + 100]]), strict=False):
            assert ids.tolist() == w, t
            assert codec.decode(w) == lib.decode(w)


def test_any_ids_decode_as_the_library_does():
    lib, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), spc.Codec(PATH), random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(260) for _ in range(rng.randrange(10))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_spans_tile_the_original_bytes():
    codec = spc.Codec(PATH)
    for t in texts(300, 5):
        data = t.encode()
        (ids, begins, ends), = codec.encode([data])
        if not len(ids):
            assert not data
            continue
        assert begins[0] == 0 and ends[-1] == len(data) and (begins[1:] == ends[:-1]).all()
        for x, b, e in zip(ids.tolist(), begins.tolist(), ends.tolist()):
            if codec.kinds[x] == 1:
                assert codec.surface[x].decode().replace("▁", " ").strip() == data[b:e].decode("utf-8", "replace").replace("▁", " ").strip()


def test_character_map_is_followed_like_the_library():
    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        mine = spc.Normalizer(lib.serialized_normalizer_spec())
        for t in texts(400, 9):
            got, source = mine(t.encode())
            assert got.decode() == lib.normalize(t), t
            assert len(source) == len(got) + 1 and (source[1:] >= source[:-1]).all() and source[-1] <= len(t.encode())


def test_table(odd_docs, no_docs):
    enc = spc.encode(odd_docs, PATH)
    rows = {r.doc_id: r for r in spc.decode(enc, PATH).collect()}
    assert rows[4].ids == [] and rows[5].decoded == "" and enc.count() == odd_docs.count()
    assert {r.doc_id: r.text for r in odd_docs.collect()}[9] == rows[9].decoded
    assert spc.encode(no_docs, PATH).count() == 0 and spc.decode(spc.encode(no_docs, PATH), PATH).count() == 0


def test_a_worker_reads_the_model_once(spark, tmp_path):
    """Both steps of every task of a worker share one codec: the model is parsed once a process, not once a task."""
    def seen(batches):
        import os

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f"{os.getpid()} {spc._codec.cache_info().misses}"])], ["seen"])

    for k in range(3):
        spark.createDataFrame([(k, "some text"), (k + 9, None)], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = spc.decode(spc.encode(docs, PATH), PATH).collect()
        assert sorted((r.doc_id, r.decoded) for r in got) == [(k, "some text"), (k + 9, "")]
    misses = [int(r.seen.split()[1]) for r in spark.range(8, numPartitions=4).mapInArrow(seen, "seen string").collect()]
    assert max(misses) <= 1


def test_null_ids_decode_to_the_empty_text(spark):
    ids = spc.Codec(PATH).segmenter.encode("a few words")
    frame = spark.createDataFrame([(1, ids), (2, None), (3, []), (4, [0, *ids, 2])], "doc_id long, ids array<int>").coalesce(1)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert {r.doc_id: r.decoded for r in spc.decode(frame, PATH).collect()} == {1: lib.decode(ids), 2: "", 3: "", 4: lib.decode([0, *ids, 2])}
