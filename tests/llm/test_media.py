import struct

import numpy as np
import pytest

from leafmill.llm import media, queries


def blocks(plane):
    """Quantised zigzag coefficients of a grey picture."""
    h, w = plane.shape
    x = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).astype(float) - 128
    return np.rint(media._COS.T @ x @ media._COS).reshape(h // 8, w // 8, 64)[..., media.ZIGZAG].astype(np.int64)


@pytest.mark.parametrize("tables", [True, False])
def test_pictures_round_trip(tables):
    rng = np.random.default_rng(0)
    yy, xx = np.mgrid[:24, :40]
    for plane in (rng.integers(0, 256, (24, 40)), np.full((24, 40), 17), (yy * 5 + xx * 3) % 256, np.where((xx // 4 + yy // 3) % 2, 255, 0)):
        got = media.luma(media.jpeg(blocks(plane), tables))
        assert got.shape == plane.shape and np.abs(got.astype(int) - plane).max() <= 2


def colour(ys, cb, cr, restart=0):
    """A 4:2:0 JPEG of 16 x 16 units with flat chroma, written bit by bit."""
    code = {k: {s: (c, b) for c, b, s in media._codes(*t)} for k, t in (("dc", media._DC), ("ac", media._AC), ("dcc", media._DC_CHROMA), ("acc", media._AC_CHROMA))}
    segments, bits, last = [], "", [0, 0, 0]

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        segments.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"))
        bits = ""

    for m, unit in enumerate(ys):
        if restart and m and m % restart == 0:
            flush()
            last = [0, 0, 0]
        for k, dc in [(0, y) for y in unit] + [(1, cb), (2, cr)]:
            d, last[k] = dc - last[k], dc
            size = abs(d).bit_length()
            c, b = code["dcc" if k else "dc"][size]
            bits += f"{c:0{b}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
            c, b = code["acc" if k else "ac"][0]
            bits += f"{c:0{b}b}"
    flush()
    seg = lambda kind, x: b"\xff" + bytes([kind]) + struct.pack(">H", len(x) + 2) + x
    body = b"".join(s + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(segments) else b"") for i, s in enumerate(segments))
    return (
        b"\xff\xd8" + seg(0xE0, b"AVI1\0") + seg(0xDB, b"\0" + bytes([1] * 64)) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"")
        + seg(0xC0, struct.pack(">BHHB", 8, 16, 16 * len(ys), 3) + b"\1\x22\0\2\x11\0\3\x11\0") + seg(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0") + body + b"\xff\xd9"
    )


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_subsampled_colour_and_restarts(restart):
    ys = [[8 * v for v in (-100, 20, 5, 60)], [8 * v for v in (0, -7, 90, -128)], [8 * v for v in (1, 2, 3, 4)]]
    got = media.luma(colour(ys, 40, -300, restart))
    want = np.concatenate([np.block([[np.full((8, 8), u[0] // 8 + 128), np.full((8, 8), u[1] // 8 + 128)], [np.full((8, 8), u[2] // 8 + 128), np.full((8, 8), u[3] // 8 + 128)]]) for u in ys], 1)
    assert np.abs(got.astype(int) - want).max() <= 1


def film(shots, seed=0, noise=3):
    """Frames of shots of the given lengths, each with its own look, and slow motion."""
    rng = np.random.default_rng(seed)
    out = []
    for k, n in enumerate(shots):
        look = np.clip(rng.normal(30 + (k * 83) % 200, 12, (16, 16)), 0, 255)
        for t in range(n):
            out.append(media.jpeg(blocks(np.clip(look + t * 0.5 + rng.normal(0, noise, look.shape), 0, 255))))
    return out


def test_shots_against_the_film_script():
    for seed in range(6):
        lengths = np.random.default_rng(seed).integers(4, 15, 6).tolist()
        for index in (True, False):
            got = media.clips(media.avi(film(lengths, seed), 16, 16, 20, index))
            assert [c[2] for c in got] == lengths
            assert [c[1] for c in got] == np.cumsum([0, *lengths[:-1]]).tolist()
            assert np.allclose([c[4] for c in got], np.cumsum(lengths) / 20)


def test_index_offsets_from_the_file_and_wrong_ones():
    data = media.avi(film([3, 4]), 16, 16)
    base, at = data.index(b"movi"), data.index(b"idx1") + 8
    entries = [struct.unpack("<4sIII", data[k : k + 16]) for k in range(at, len(data), 16)]
    for move in (base, 6):
        other = data[:at] + b"".join(struct.pack("<4sIII", a, b, c + move, d) for a, b, c, d in entries)
        assert media.frames(other)[1] == media.frames(data)[1]


def test_damage_has_a_defined_result(spark):
    good = film([5, 5])
    broken = good[:2] + [b"", good[3][:60], b"junk"] + good[5:]
    whole = media.avi(good, 16, 16)
    rows = [(1, None), (2, b""), (3, b"RIFF"), (4, whole[:100]), (5, whole), (None, whole), (5, whole), (6, media.avi(broken, 16, 16)), (7, media.avi([b"x"], 16, 16)), (8, media.avi([], 16, 16)), (9, whole[: len(whole) // 2])]
    got = media.clip_rows(spark.createDataFrame(rows, "video_id bigint, data binary").selectExpr("*", "1 AS clip", "2 AS id")).collect()
    by = {}
    for r in got:
        by.setdefault(r.video_id, []).append(r.n_frames)
    assert by[5] == [5, 5, 5, 5] and by[None] == [5, 5] and sum(by[6]) == 10 and sum(by[9]) < 10
    assert set(by) == {5, None, 6, 9}
    assert media.clip_rows(spark.createDataFrame([], "video_id bigint, data binary")).collect() == []


def test_query_against_the_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = {}
    for r in queries.op5_media_clips(spark, sf_dir).collect():
        got.setdefault(r.video_id, set()).add(r.first_frame)
    n = {}
    for r in vectors:
        n[r.vec_id // queries.SHOTS] = n.get(r.vec_id // queries.SHOTS, 0) + 1
    assert set(got) == set(n)
    want = {v: {queries.FRAMES * k for k in range(c)} for v, c in n.items()}
    hits = sum(len(got[v] & want[v]) for v in n)
    assert hits >= 0.9 * sum(map(len, want.values())) and sum(map(len, got.values())) <= 1.02 * sum(map(len, want.values()))


def test_damaged_files_never_raise():
    """Bytes changed, cut out or cut off anywhere, in files and in bare frames: clips or nothing, and no other error."""
    rng = np.random.default_rng(5)
    whole, frame = media.avi(film([2, 2]), 16, 16), media.jpeg(blocks(rng.integers(0, 256, (16, 16))))
    files, bare = [], []
    for n in range(3000):
        data = bytearray(whole if n % 3 else frame)
        for _ in range(int(rng.integers(1, 6))):
            at = int(rng.integers(0, len(data)))
            kind = rng.integers(0, 4)
            if kind < 2:
                data[at] = int(rng.integers(0, 256))
            elif kind == 2:
                del data[at : at + int(rng.integers(1, 9))]
            elif len(data) > 40:
                del data[max(40, at) :]
        (files if n % 3 else bare).append(bytes(data))
    together = media.clips_of(files)
    assert len(together) == len(files) and all(c[2] > 0 for own in together for c in own)
    planes = media.planes(bare)
    assert len(planes) == len(bare) and all(x is None or x.dtype == np.uint8 for x in planes)
    # damage in one leaves the others decoded with it as they are alone
    assert all(media.clips(files[i]) == together[i] for i in range(0, len(files), 25))
    for x, own in list(zip(bare, planes))[::25]:
        try:
            assert (media.luma(x) == own).all()
        except media.Broken:
            assert own is None


def test_wide_quantisation_tables_and_sizes():
    frame = media.jpeg(blocks(np.full((16, 16), 90)))
    at = frame.index(b"\xff\xdb")
    wide = b"\xff\xdb" + struct.pack(">H", 131) + b"\x10" + struct.pack(">64H", *[1] * 64)
    assert (media.luma(frame[:at] + wide + frame[at + 69 :]) == media.luma(frame)).all()
    with pytest.raises(media.Broken):
        media.luma(frame[: at + 4] + b"\x10" + frame[at + 5 :])  # flagged wide, but short
    at = frame.index(b"\xff\xc0")
    with pytest.raises(media.Broken):  # as large as a header can say: refused before any memory is taken
        media.luma(frame[: at + 5] + b"\xff\xff\xff\xff" + frame[at + 9 :])


def test_a_very_long_film():
    shot = film([400, 300], noise=1)
    assert [c[2] for c in media.clips(media.avi(shot * 3, 16, 16))] == [400, 300] * 3
