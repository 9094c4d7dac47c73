import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vecspark.llm import flatbin, media, packing, tokens
from vecspark.llm.common import scratch

from .helpers import ROWS, clashing, documents, empty

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


LIBRARY = {n: plain(n) for n in NAMES}
PIECES = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "'s", "9", "!", ",", ".", "\u0085", " ", " ", "日", "🎉", "́", "\x1f", "Σ", "<|endoftext|>", "word", "“", "　", " "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=8))
def test_cut_texts_give_the_same_ids(texts):
    for name in NAMES:
        got = tokens.encoder(P.path(name)).encode(pa.array(texts, pa.string()))
        assert [g.tolist() for g in got] == [LIBRARY[name](t) for t in texts]


def test_windows_slices_and_bounded_table(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(80))) for _ in range(300)]
    monkeypatch.setattr(tokens, "WINDOW", 64)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    for name in NAMES:
        own = tokens.Encoder(P.path(name))
        got = list(own.encode(pa.array([None, *texts, "x" * 5000], pa.string()).slice(1)))
        assert [g.tolist() for g in got] == [LIBRARY[name](t) for t in [*texts, "x" * 5000]]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_RADIX", 1)
    monkeypatch.setattr(tokens, "_INVERSE", 1)
    own = tokens.Encoder(P.path(NAMES[0]))
    texts = [" ab ba", " ba ab", " abc cab bca"]
    assert [g.tolist() for g in own.encode(pa.array(texts))] == [LIBRARY[NAMES[0]](t) for t in texts]


def test_flat_files(spark):
    df = documents(spark)
    want = sorted(((i, LIBRARY[NAMES[0]](t) + [0]) for i, t, *_ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    for width in (2, 4):
        manifest = flatbin.write(clashing(df).repartition(3), scratch(spark, "t"), P.path(NAMES[0]), 0, width)
        got = sorted(flatbin.read(manifest).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [i for i, _ in want]
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, x in want)
    assert flatbin.read(flatbin.write(empty(spark), scratch(spark, "t"), P.path(NAMES[0]), 0, 2)).count() == 0
    assert (flatbin.id_width(65_536), flatbin.id_width(65_537)) == (2, 4)


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(spark, length):
    df = documents(spark)
    rows = packing.pack(clashing(df).repartition(3), P.path(NAMES[1]), 1, length).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or k == len(sequences) - 1
    want = sorted(repr((i, LIBRARY[NAMES[1]](t) + [1])) for i, t, *_ in ROWS if i != 8)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in ROWS:
        if i != 8:
            ids, at = LIBRARY[NAMES[1]](t) + [1], 0
            for r in sorted(got[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
                at += r.length
            assert at == len(ids)
    assert len(want) == len(ROWS) - 2
    assert packing.pack(empty(spark), P.path(NAMES[1])).count() == 0


def test_padded_sequences(spark):
    df = documents(spark, [(1, "one two three", "en", "a", 1), (2, "four five", "en", "a", 1)])
    held = packing.tokenise(df.coalesce(1), P.path(NAMES[1]), 1)
    out = packing.sequences(held, packing.cut(held, 4), 9, 4).orderBy("sequence_id").collect()
    flat = [i for t in ("one two three", "four five") for i in LIBRARY[NAMES[1]](t) + [1]]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in out] == [flat[:4], [*flat[4:], 9] if len(flat) == 7 else flat[4:8]]


def test_sequences_of_repeated_and_nameless_rows(spark):
    texts = [(1, "one two three"), (1, "one two three"), (None, "four five"), (None, None), (2, "one two three"), (1, "six")]
    df = documents(spark, [(i, t, "en", "a", 1) for i, t in texts])
    held = packing.tokenise(df.coalesce(1), P.path(NAMES[1]), 1)
    out = packing.sequences(held, packing.cut(held, 4), 9, 4).orderBy("sequence_id").collect()
    flat = [i for _, t in texts for i in LIBRARY[NAMES[1]](t) + [1]]
    assert sum((np.frombuffer(r.ids, "<u4").tolist()[: r.n] for r in out), []) == flat
    assert [r.n for r in out[:-1]] == [4] * (len(out) - 1)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200_000))
def test_transport_round_trip(data):
    stream = media.mux(media.pad(data))
    got = media.demux(stream)
    assert got["payload"] == media.pad(data)
    assert len(stream) % 188 == 0
    assert got["continuity_errors"] == 0
    assert got["pts"] == [media.TICKS * media.UNITS * k for k in range(len(got["pts"]))]
    assert len(got["random_access"]) == len(got["pts"])


def test_damaged_streams():
    stream = media.mux(media.pad(b"x" * 50_000))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert media.demux(b"".join(packets[:10] + packets[11:]))["continuity_errors"] == 1
    twice = media.demux(b"".join(packets[:10] + [packets[9]] + packets[10:]))
    assert (twice["payload"], twice["continuity_errors"]) == (media.pad(b"x" * 50_000), 0)
    assert media.demux(b"".join([*packets[:1], packets[0], *packets[1:]]))["continuity_errors"] == 0
    many = media.mux(media.pad(bytes(range(256)) * 3000))
    tables = [i for i in range(0, len(many), 188) if (many[i + 1] & 31) << 8 | many[i + 2] == media.PAT_PID]
    assert len(tables) > 1
    assert media.demux(many[: tables[1]] + many[tables[1] + 188 :])["continuity_errors"] == 0  # the last table packet: nothing comes after it
    assert media.demux(many[188:] + many[:188])["continuity_errors"] == 1  # its counter steps back
    with pytest.raises(ValueError, match="whole number"):
        media.demux(stream[1:])
    with pytest.raises(ValueError, match="CRC"):
        media.demux(stream[:10] + b"\x00" + stream[11:])
    assert media.crc_mpeg(b"123456789") == 0x0376E6E7


@pytest.mark.parametrize("data", [b"x" * 200_000, bytes(range(256)) * 800])
@pytest.mark.parametrize("lost", [1, 2, 14, 15, 16, 17, 31, 32, 48])
@pytest.mark.parametrize("at", [3, 10, 150, 195, 400])
def test_lost_packets_are_seen_and_nothing_is_made_up(data, lost, at):
    payload = media.pad(data)
    stream = media.mux(payload)
    got = media.demux(stream[: 188 * at] + stream[188 * (at + lost) :])
    assert got["continuity_errors"] + got["uneven_units"] > 0
    assert len(got["payload"]) < len(payload)
    intact = [payload[i : i + media.UNITS * media.BLOCK] for i in range(0, len(payload), media.UNITS * media.BLOCK)]
    held = got["payload"]
    assert held.startswith(intact[0]) or at < 202  # units before the loss are whole
    assert held.endswith(intact[-1]) or at + lost > 188 * len(stream) // 188 - 202


def test_timestamps_go_on_beyond_33_bits():
    wrap = 1 << 33
    last = 0
    for pts in range(wrap - 5000, wrap + 5000, 1080):
        last = media.unwrapped(media.read_timestamp(media.timestamp(pts)), last)
        assert last == pts


def test_media_rows(spark):
    out = media.decode(media.encode(clashing(documents(spark)))).collect()
    want = sorted((repr(i), hashlib.sha256(media.pad((t or "").encode())).hexdigest(), len((t or "").encode())) for i, t, *_ in ROWS)
    assert sorted((repr(r.doc_id), r.payload_sha256, r.n_bytes) for r in out) == want
    assert all(r.tail_crc32 == zlib.crc32(media.pad((t or "").encode())[-32:]) for r in out for i, t, *_ in ROWS if i == r.doc_id)
    assert media.decode(media.encode(empty(spark))).count() == 0
