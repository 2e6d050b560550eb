import cProfile
import zlib
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import id_coder, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@cache
def library_of(path):
    return Tokenizer.from_file(path)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())


@pytest.mark.parametrize("segment_ids", [token_files.SEGMENT_IDS, 5000])
def test_against_brute_force(spark, sf_dir, segment_ids):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(token_files.token_index(docs, PATH, segment_ids)) == brute(rows)


def test_edge_cases(spark):
    rows = [(3, None), (1, ""), (2, " \n\t"), (5, "It's  <|endoftext|> ΑΣ ÉÉ a b\x0bc"), (9, "word " * 30000), (4, "日本語 x y 12345 --")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, start int, ids string")
    assert got(token_files.token_index(docs, PATH)) == brute(rows)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    out = token_files.token_index(twice, PATH).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in out] == [(None, 0, 2), (1, 2, 3), (1, 5, 3)]
    assert token_files.token_index(docs.limit(0), PATH).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 700), st.sampled_from([1, 3, 50, 65535]), st.sampled_from([1, 7, 100, 4096]))
def test_coder_round_trip(seed, n, most, block):
    ids = np.random.default_rng(seed).integers(0, most + 1, n)
    blocks = id_coder.encoded(ids, block)
    counts = [min(block, n)] * (len(blocks) - 1) + [n - (len(blocks) - 1) * block]
    assert (id_coder.decoded(blocks, counts) == ids).all()
    if len(blocks) > 1:  # any block alone
        assert (id_coder.decoded(blocks[1:2], counts[1:2]) == ids[block : 2 * block]).all()


def test_repeated_ids_take_little_room():
    assert sum(map(len, id_coder.encoded(np.tile(np.arange(40), 1000)))) < 12_000


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAbt's.,$# \n\u00a0\u0301éÉß日ﬁ1９JHTWYjhtwyİK=<\u030c\u0331\u0308\u030a\u0338"), st.characters(codec="utf-8"))) | st.sampled_from(["a <|endoftext|> b", "A<|endoftext|>", "<|ENDOFTEXT|>"]), max_size=6))
def test_ids_are_those_of_the_library(name, texts):
    path = public_tokenizers.path(name)
    flat, counts = token_files.text_ids(path).of(pa.array(texts, pa.string()))
    library = library_of(path)
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])][: len(texts)] == want


def test_marks_compose_before_letters_are_lowered():
    texts = [a + mark + b for a in "JHTWYjhtwy" for mark in "\u030c\u0331\u0308\u030a" for b in ("", "x", " ", ",X")]
    flat, _ = token_files.text_ids(PATH).of(pa.array(texts))
    assert flat.tolist() == [i for x in texts for i in [*library_of(PATH).encode(x, add_special_tokens=False).ids, 1]]


def test_words_of_letters_in_any_case():
    letters = [chr(i) for i in range(0x41, 0x180) if chr(i).isalpha() or chr(i) in "×÷"]
    texts = [a + b for a in letters for b in ("", "x", "É", "ß", "'S", "\u0301", " ÑANDÚ,", "1Ÿ")] + ["ÀÉ×Õ÷Ö", "Straße ÜBER", "ÇA\u0327"]
    texts += [" ".join(texts), "".join(letters), " ".join(f"é{a}{b}" for a in letters for b in letters)]  # over 200 words at a time
    flat, _ = token_files.TextIds(PATH).of(pa.array(texts))
    assert flat.tolist() == [i for x in texts for i in [*library_of(PATH).encode(x, add_special_tokens=False).ids, 1]]


def test_files_are_smaller_than_those_of_a_plain_compressor():
    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    ids, _ = token_files.text_ids(PATH).of(pa.array(texts))
    size = sum(map(len, id_coder.encoded(ids)))
    assert size < len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert size * 8 < 9.3 * len(ids)


def test_coder_takes_few_steps_and_little_room():
    """Calls for each position of a block, in which all blocks of a segment share, and bits an id."""
    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    ids, _ = token_files.text_ids(PATH).of(pa.array(texts))
    ids = ids[: len(ids) // id_coder.BLOCK * id_coder.BLOCK]
    profile = cProfile.Profile()
    blocks = id_coder.encoded(ids)
    found = profile.runcall(id_coder.decoded, blocks, [id_coder.BLOCK] * len(blocks))
    calls = sum(entry.callcount for entry in profile.getstats())
    assert (found == ids).all()
    assert sum(map(len, blocks)) * 8 < 9.1 * len(ids)
    assert calls < 20 * id_coder.BLOCK


@pytest.mark.parametrize("last", [1, 9, 700, 1999])
def test_coder_round_trip_of_unequal_blocks(last):
    """Blocks that order 0 gives nothing, little or all of, and runs of ids that end within a step."""
    any_ids = np.random.default_rng(5).integers(0, 1 << 16, 6000)
    ids = np.concatenate([np.zeros(2000, dtype=np.int64), any_ids[:2000], np.tile(any_ids[:13], 154)[:2000], any_ids[2000:2003], np.full(1997, 65535), any_ids[4000 : 4000 + last]])
    blocks, counts = id_coder.encoded(ids, 2000), [2000] * 4 + [last]
    assert (id_coder.decoded(blocks, counts) == ids).all()
    for i, n in enumerate(counts):
        assert (id_coder.decoded([blocks[i]], [n]) == ids[2000 * i : 2000 * i + n]).all()


def test_forgotten_words_are_learned_again():
    few, texts = token_files.TextIds(PATH, remembered=5), [["some words here", "some more"], ["some words that are new"], ["words here", "some"]]
    for t in texts * 2:
        flat, _ = few.of(pa.array(t))
        assert flat.tolist() == [i for x in t for i in [*few.tokenizer.encode(x).ids, 1]]


def test_damage_is_noticed():
    flat = np.arange(305)
    payload = bytearray(token_files.packed(pa.array([7, None], pa.int64()), flat, np.array([300, 5])))
    names, ids, counts = token_files.unpacked(bytes(payload))
    assert names.to_pylist() == [7, None] and counts.tolist() == [300, 5] and (ids == flat).all()
    payload[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpacked(bytes(payload))
