"""Tokenizer-based operators against the libraries themselves."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P

from rowflow.llm import bytelevel, frames, packing, pieces, viterbi
from rowflow.llm.queries import byte_level

BPE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def texts(alphabet, count=1500, longest=50, seed=1):
    rng = random.Random(seed)
    odd = ["", " ", "  a", "a  ", "\n\n x", "it's we'll ''s 'sunny", "x" * 3000, "日本語 😀 a'", "<s> </s> ▁a", "<|endoftext|>"]
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(count)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(BPE)
    found.encode_special_tokens = True
    return found


def test_byte_level_ids(library):
    given = texts("ab '\n\t.,;1２é日strevllmd\x85\x1c\xa0😀") + ["word " * 200_000]
    for text, ids in zip(given, bytelevel.ids_of_texts(given, BPE), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_get_their_ids_as_in_the_library():
    from tokenizers import Tokenizer

    plain, end = Tokenizer.from_file(BPE), "<|endoftext|>"
    given = [f"a {end} b", end, end * 3, f"{end}it's{end} we'll", f"x <|endoftext| {end}>", "none", "", f"word {end}\n" * 30_000]
    given += [x.replace("e", end) for x in texts("ab 'e\n\t.,;|<>é日strl😀", 400)]
    for text, ids in zip(given, byte_level(BPE, 7)(iter(given)), strict=True):
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 7]


def test_piece_ids_spans_and_decoding():
    given = texts("ab  \n\t.,;1é日strevl▁<s>😀\x00")
    model = pieces.model(PIECE)[0]
    for text, ids, spans, back in pieces.encoded(given, PIECE):
        assert ids.tolist() == model.encode(text, add_bos=True, add_eos=True)
        assert back == model.decode(ids.tolist())
        data = text.encode()
        assert b"".join(data[a:b] for a, b in spans) == data


def test_character_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = proto.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    chars = pieces.CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    for text in ("Ａｂｃ①", "ﬁne㍍é", "ｶﾞx", "plain"):
        data, source = chars.apply(text)
        assert data.decode() == library.normalize(text).lstrip("▁")
        assert len(source) == len(data) + 1 and source[-1] == len(text.encode())


def test_viterbi_counts_with_ties():
    from tokenizers import Tokenizer, models

    rng = random.Random(3)
    for _ in range(100):
        names = sorted({"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))})
        vocabulary = [(x, -float(rng.randint(0, 4))) for x in names]
        own, library = viterbi.Counter(vocabulary), Tokenizer(models.Unigram([("\U000f0000", 0.0), *vocabulary], 0, False))
        given = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 15))) for _ in range(20)]
        for text, (n, _) in zip(given, own.counts(given), strict=True):
            assert n == len(library.encode("▁" + text.replace(" ", "▁") if text else "").ids)


ROWS = [(3, "b c"), (1, None), (2, ""), (None, "no id"), (2, "a long one " * 3000), (3, "b c")]


def test_frames_round_trip(spark, library, shared_folder):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, start string").repartition(3)
    manifest = frames.write(docs, byte_level(BPE, 2), frames.folder(spark))
    got = sorted(frames.read(manifest).collect(), key=lambda r: r.start)
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert sorted(tuple(r.ids) for r in got) == sorted((*library.encode(t or "", add_special_tokens=False).ids, 2) for _, t in ROWS)
    assert {r.doc_id for r in frames.read(manifest, lambda i: i == 3).collect()} == {3}


def test_frames_any_zstandard_reader_and_checksums(tmp_path):
    import io

    import pyarrow as pa
    import zstandard

    sink = open(tmp_path / "f", "wb")
    writer = frames.FrameWriter(sink)
    for i in range(5):
        writer.add(i, np.arange(i * 10, dtype=np.uint32))
    writer.close()
    data = (tmp_path / "f").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u4").tolist() == [x for i in range(5) for x in range(i * 10)]
    reader = frames.FrameReader(pa.BufferReader(data))
    assert reader.ids(3).tolist() == list(range(30))
    spoilt = bytearray(data)
    spoilt[int(reader.offset[2]) + 9] ^= 1
    with pytest.raises(Exception):
        frames.FrameReader(pa.BufferReader(bytes(spoilt))).ids(3)


def check_packing(rows, documents, library):
    used, by_doc = {}, {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sorted(used) == list(range(len(used)))
    for doc_id, text in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by_doc[doc_id, len(ids)], key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return sum(r.length for r in rows) / (2048 * len(used))


def test_packing(spark, library):
    rng = random.Random(5)
    documents = [(i, "word " * rng.choice([0, 3, 700, 1300, 1999, rng.randint(0, 6000)])) for i in range(300)] + [(1000, None)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, byte_level(BPE, 1)).collect()
    assert check_packing(rows, documents, library) > 0.98
    assert packing.pack(docs.limit(0), byte_level(BPE, 1)).count() == 0


def test_least_squares_plan():
    rng = np.random.default_rng(2)
    a, b = rng.random((6, 9)), rng.random(6)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-8).all() and abs(slope @ x) < 1e-8
    histogram = rng.integers(0, 50, size=33)
    histogram[0] = 0
    taken = np.zeros(33, dtype=int)
    for pattern, n in packing.plan(histogram):
        assert sum(pattern) == 32 and n > 0
        np.add.at(taken, list(pattern), n)
    assert (taken <= histogram).all() and taken.sum() > 0
